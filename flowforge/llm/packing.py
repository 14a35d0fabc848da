"""Sequence packing by Karmarkar-Karp multiway differencing.

Every document becomes its token ids with an end id.  A document of at least
one window is cut into full windows and a rest; the rests are dealt to blocks
by a hash of the document, and each block is divided into near-equal windows:

* a *partial partition* is a list of bin sums; each piece starts as one with a
  single filled bin;
* the two partial partitions with the largest imbalance (largest minus smallest
  bin) are merged, the fullest bins of one with the emptiest of the other, until
  one is left;
* the number of windows starts at the least possible and rises whenever the
  fullest window exceeds the capacity.

As documents may be cut anywhere, rests are cut into equal pieces of at most
``PIECE`` tokens; with several pieces a window the differencing ends with windows
of nearly one length, and little padding (0.2 % at 512, 0.6 % at 1024, 2 %
uncut).

Token ids are worked out word by word: the word BPE drops white space, so the
ids of a text are those of its ASCII-space separated chunks in a row, and those
of recent chunks are remembered.  Only (document, start, length, checksum)
crosses the shuffle, unless the ids themselves are asked for.

Defined results: null text is empty; an empty document is its end id alone.
Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowforge.llm.bpe import letter_bytes
from flowforge.llm.common import RecentCache, columns, kept, let_go, shuffle_partitions, utf8, vocabulary_file

CAPACITY = 4096
END = 2
#: Longest piece that shares a window.
PIECE = 512
#: Documents a shuffle partition, and pieces that are differenced together.
DEAL, BLOCK = 1024, 2500

# FIXED VALUES: pre-token pattern of the word vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of the characters up to U+017F.
LATIN = bytes(range(0xC6))
#: A capital whose small letter is two characters, one of them beyond Latin.
DOTTED_I = "\u0130".encode()


class WordEncoder:
    """``ids(text)`` as little-endian 32-bit bytes, equal to the library's
    ``encode(text, add_special_tokens=False)`` without truncation or padding.

    Texts up to U+017F are put in lower case as a whole: there case goes letter
    by letter and nothing is composed, so a chunk is looked up as it is spelled
    for the merges, and its capitalised forms need no entries of their own."""

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.letters = "".join(c for c, _ in sorted(letter_bytes().items(), key=lambda x: x[1]))
        self.find = regex.compile(WORDS).findall
        self.merge = self.library.model.tokenize
        self.packed = [struct.pack("<I", i) for i in range(max(self.library.get_vocab().values()) + 1)]
        self.chunks = RecentCache(self._chunk, limit=500_000)

    def _merged(self, word: bytes) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(charmap_decode(word, "strict", self.letters)[0])])

    def _chunk(self, chunk: bytes) -> bytes:
        if not _latin(chunk):  # classes and case are the library's business
            ids = self.library.encode(chunk.decode(), add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if (low := _lower(chunk)) != chunk:  # of a text with characters beyond Latin
            return self.chunks[low]
        text = chunk.decode()
        if text.isalpha():  # one pre-token
            return self._merged(chunk)
        if text[-1] in ".,;:!?" and text[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.chunks[chunk[-1:]]
        words = self.find(text)
        if words == [text]:
            return self._merged(chunk)
        return b"".join([self.chunks[w.encode()] for w in words])

    def ids(self, text: bytes) -> bytes:
        if any(s in text for s in self.specials):
            ids = self.library.encode(text.decode(), add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if _latin(text):
            text = _lower(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


def _latin(text: bytes) -> bool:
    """Whether all characters are at most U+017F and lower to such ones."""
    return text.isascii() or not text.translate(None, LATIN) and DOTTED_I not in text


def _lower(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode().lower().encode()


def difference(lengths: list[int], bins: int) -> list[list[int]]:
    """Indices of ``lengths`` in ``bins`` near-equal bins.

    A partial partition is (sums in falling order, the pieces of each); empty
    bins are left out.  Where two have fewer filled bins than there are bins,
    nothing needs to share a bin."""
    heap = [(-n, i, [n], [[i]]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    ticket = len(heap)
    while len(heap) > 1:
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        over = max(0, len(sums_a) + len(sums_b) - bins)  # bins that both must share
        # the last `over` of a (its emptiest) take the last of b in opposite order
        keep_a, keep_b = len(sums_a) - over, len(sums_b) - over
        sums = sums_a[:keep_a] + sums_b[:keep_b]
        sets = sets_a[:keep_a] + sets_b[:keep_b]
        for k in range(over):
            sums.append(sums_a[keep_a + k] + sums_b[len(sums_b) - 1 - k])
            sets.append(sets_a[keep_a + k] + sets_b[len(sums_b) - 1 - k])
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, sets = [sums[k] for k in order], [sets[k] for k in order]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == bins else 0)), ticket, sums, sets))
        ticket += 1
    return heap[0][3] if heap else []


def windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; each length is at most that.
    The window count rises whenever the fullest one exceeds the capacity."""
    bins = max(1, math.ceil(sum(lengths) / capacity)) if lengths else 0
    while True:
        found = difference(lengths, bins)
        worst = max((sum(lengths[i] for i in w) for w in found), default=0)
        if worst <= capacity:
            return found
        bins += max(1, math.ceil(bins * (worst - capacity) / capacity / 2))


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the full windows and the pieces of ``n`` tokens."""
    out = [(at, capacity) for at in range(0, n - n % capacity, capacity)]
    at, rest = n - n % capacity, n % capacity
    parts = math.ceil(rest / piece)
    for k in range(parts):
        length = rest // parts + (k < rest % parts)
        out.append((at, length))
        at += length
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pieces(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids (null unless asked
    for; little-endian unsigned 32-bit) of every piece; no shuffle."""
    spec = vocabulary_file(docs.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("packing", len(spec.value), hash(spec.value)), lambda: WordEncoder(spec.value))
        end = struct.pack("<I", END)
        for docs_ids, texts in columns(batches, "doc_id", "text", rows=512):
            out = []
            for doc, text in zip(docs_ids, texts, strict=True):
                ids = encoder.ids(text) + end
                n = len(ids) // 4
                for at, length in cuts(n):
                    part = ids[4 * at:4 * (at + length)]
                    out.append((doc, at, length, zlib.crc32(part), n, part if with_ids else None))
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PACKED.types[:6], strict=True)], names=_PACKED.names[:6])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, _PIECES)


def pack(parts: DataFrame, partitions: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows of ``pieces``.  A task holds one
    block of pieces at a time, however many it is dealt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # the encoder and the chunks it remembers are not needed any more
        first = TaskContext.get().partitionId() << 36
        block: list[tuple] = []

        def place(rows: list[tuple], bins: list[list[int]]):
            nonlocal first
            out = []
            for members in bins:
                at = 0
                for i in sorted(members):
                    out.append((*rows[i], first, at))
                    at += rows[i][2]
                first += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PACKED.types, strict=True)], schema=_PACKED)

        for rows in columns(batches, *_PACKED.names[:6], rows=512):
            rows = list(zip(*rows, strict=True))
            if full := [r for r in rows if r[2] == capacity]:
                yield place(full, [[i] for i in range(len(full))])
            block += [r for r in rows if r[2] < capacity]
            if len(block) >= 2 * BLOCK:
                head, block = block[:BLOCK], block[BLOCK:]
                yield place(head, windows([r[2] for r in head], capacity))
        if block:
            yield place(block, windows([r[2] for r in block], capacity))

    dealt = parts.repartition(partitions, F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "start")
    return dealt.mapInArrow(run, _PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids if asked for.  The windows of ``sequence_id``
    hold their pieces from offset 0 without gaps."""
    partitions = max(1, min(math.ceil(docs.count() / DEAL), shuffle_partitions(docs.sparkSession)))
    packed = pack(pieces(docs, vocabulary_path, id_col, text_col, with_ids), partitions)
    return packed if with_ids else packed.drop("ids")
