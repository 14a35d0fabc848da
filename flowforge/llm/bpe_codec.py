"""BPE encoding by backtracking, and decoding by an offset table.

Encoding: an Aho-Corasick automaton finds all vocabulary tokens in a pre-token
in one pass.  From the left, the longest token at each place is tried; a token
may follow another only if the pair-compatibility table allows it, else the
next shorter token is tried, and if there is none the last token is taken back.
A place found hopeless is never tried again, so the time is linear.  What comes
out is exactly what applying the merges in order gives.

Two tokens are compatible when no merge would join across their border: for
every x among the right ends of the left token and y among the left ends of the
right token, merging (x, y) must come later than the merge that used up x or y
(at equal rank the merge further left comes first).

Decoding: all token strings lie in one byte buffer; an offset table gives the
slice of each id, and whole id arrays are gathered at once.

Defined results: null text is empty: no ids, the digests of the empty string.
Special strings inside a text are their own ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.bpe import Vocabulary
from flowforge.llm.common import BoundedCache, columns, kept, utf8, vocabulary_file

#: Ids decoded at once.
SLICE = 1 << 20
_NEVER = 1 << 60
#: No byte, so in no token.
BETWEEN = "\u2603"


class RecentWords(dict):
    """A memo of words in two generations of up to ``limit``: when one is full, the
    words that it and the one before hold stay at hand, and only those not used
    since are forgotten.  ``make`` gives the values of several words at once."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.before = make, limit, {}

    def of(self, words: list[str]) -> list[bytes]:
        found = list(map(self.get, words))
        if None not in found:
            return found
        unseen = {w for w, v in zip(words, found, strict=True) if v is None}
        if len(self) + len(unseen) > self.limit:
            self.before = dict(self)
            self.clear()
        known = {w: v for w in unseen if (v := self.before.get(w)) is not None}
        self.update(known)
        new = list(unseen - known.keys())
        self.update(zip(new, self.make(new), strict=True))
        return [self[w] if v is None else v for w, v in zip(words, found, strict=True)]


class OffsetTable:
    """Strings by number, all in one buffer, with the place of each."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.buffer = np.frombuffer(b"".join(strings), np.uint8)

    def parts(self, ids: np.ndarray) -> Iterator[bytes]:
        """The strings of ``ids``, joined, in parts of bounded size."""
        for at in range(0, len(ids), SLICE):
            part = ids[at:at + SLICE]
            n = self.lengths[part]
            ends = np.cumsum(n)
            yield self.buffer[np.repeat(self.offsets[part] - ends + n, n) + np.arange(ends[-1])].tobytes()


class Codec:
    def __init__(self, spec: str):
        self.vocabulary = v = Vocabulary(spec)
        self.automaton = ahocorasick.Automaton()
        for i in v.whole():
            word = v.bytes_of[i].decode("latin-1")
            self.automaton.add_word(word, i)
        self.automaton.make_automaton()
        #: the next shorter token that a token starts with, -1 if there is none
        self.shorter = {}
        for word, i in self.automaton.items():
            size = next((k for k in range(len(word) - 1, 0, -1) if word[:k] in self.automaton), 0)
            self.shorter[i] = self.automaton.get(word[:size]) if size else -1
        self._parts = {merged: (rank, a, b) for (a, b), (rank, merged) in v.merges.items()}
        self.compatible = BoundedCache(self._compatible, limit=1_000_000)
        self.words = RecentWords(self._words, limit=250_000)
        n = 1 + max([*v.bytes_of, *v.specials.values()])
        strings = [v.bytes_of.get(i, b"") for i in range(n)]
        for text, i in v.specials.items():
            strings[i] = text.encode()
        self.sizes = [len(s) for s in strings]
        self.four = [i.to_bytes(4, "little") for i in range(n)]
        self.decimal = OffsetTable([b"%d," % i for i in range(n)])
        self.strings = OffsetTable(strings)

    def _ends(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that uses it up) down one side."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            if token not in self._parts:
                return out
            until = self._parts[token][0]
            token = self._parts[token][side]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        merges = self.vocabulary.merges
        for x, x_until in self._ends(pair[0], 2):
            for y, y_until in self._ends(pair[1], 1):
                merge = merges.get((x, y))
                if merge is not None and merge[0] < x_until and merge[0] <= y_until:
                    return False
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self.encode_words([word])[0] if word else []

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens.  One pass of the automaton over all of them, with a
        letter between that no token has, gives the longest matches, left to right.
        Mostly they are compatible as they come; else the search with backtracking
        goes on from the first that isn't."""
        texts = [w.decode("latin-1") for w in words]
        matches = self.automaton.iter_long(BETWEEN.join(texts))
        allowed, out, start = self.compatible, [], 0
        for text in texts:
            last, start = start + len(text) - 1, start + len(text) + 1
            end, before = next(matches)
            ids, fits = [before], True
            while end < last:
                end, token = next(matches)
                if fits and not allowed[before, token]:
                    fits, odd = False, token
                if fits:
                    ids.append(token)
                    before = token
            out.append(ids if fits else self._search(text, ids, odd))
        return out

    def _backtrack(self, text: str) -> list[int]:
        return self._search(text, [], next(self.automaton.iter_long(text))[1])

    def _search(self, text: str, ids: list[int], token: int) -> list[int]:
        """``ids`` are the longest matches so far, each compatible with the one
        before; ``token`` is the longest match behind them."""
        longest, lengths, shorter, allowed = self.automaton.iter_long, self.sizes, self.shorter, self.compatible
        hopeless = set()
        n, at, before = len(text), sum(map(lengths.__getitem__, ids)), ids[-1] if ids else -1
        while True:
            # the longest token here that may follow and doesn't lead to a hopeless place
            while token >= 0 and (hopeless and at + lengths[token] in hopeless or before >= 0 and not allowed[before, token]):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += lengths[token]
                if at == n:
                    return ids
                before, token = token, next(longest(text, at))[1]
            else:
                hopeless.add(at)
                token = ids.pop()
                at -= lengths[token]
                before, token = ids[-1] if ids else -1, shorter[token]

    def _words(self, words: list[str]) -> list[bytes]:
        four = self.four.__getitem__
        return [b"".join(map(four, ids)) for ids in self.encode_words([w.encode() for w in words])]

    def encode(self, text: str) -> tuple[np.ndarray, bytes]:
        """Ids, and the same as decimals joined by commas."""
        ids: list[bytes] = []
        for words, special in self.vocabulary.segments(text):
            ids += self.words.of(words)
            if special is not None:
                ids.append(self.four[special])
        found = np.frombuffer(b"".join(ids), "<u4")
        return found, b"".join(self.decimal.parts(found))[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered through the offset table."""
        return b"".join(self.strings.parts(ids))

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", "replace")


def _codec(spec) -> Codec:
    return kept(("bpe_codec", len(spec.value), hash(spec.value)), lambda: Codec(spec.value))


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of every text."""
    spec = vocabulary_file(docs.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for ids, texts in columns(batches, "doc_id", "text", rows=256):
            found = [codec.encode(t.decode())[0].astype(np.int32) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the text of every id list (null counts as empty)."""
    spec = vocabulary_file(encoded.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for ids, lists in columns(batches, "doc_id", "ids", rows=256):
            texts = [codec.decode_text(np.array(x or [], np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; the
    text is encoded and the ids are decoded in one pass, without a shuffle."""
    spec = vocabulary_file(docs.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for ids, texts in columns(batches, "doc_id", "text", rows=1024):
            out = []
            for t in texts:
                found, decimals = codec.encode(t.decode())
                out.append((len(found), hashlib.sha256(decimals).hexdigest(),
                            hashlib.sha256(codec.decode_text(found).encode()).hexdigest()))
            n, a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
