"""Removal of repeated byte strings with two-stage suffix sorting.

Every ``WINDOW`` bytes of a document that also start earlier (in a document with
a smaller id, or before in the same one) are repeated; each byte that they cover
goes.  Suffixes are sorted in groups that fit a task:

1. *Anchors.*  A window's anchor is the gram of ``GRAM`` bytes within it with the
   smallest hash (leftmost of equals).  Equal windows have equal anchors at equal
   places, so all suffixes that may share ``WINDOW`` bytes meet in the group of one
   gram.  The windows of one anchor (about forty) are one record of a few
   numbers; their bytes together are its *context*.
2. Grams with a single record hold nothing repeated and go (counts are combined
   before the shuffle).  Of records with the same gram and context all but the
   earliest are repeated throughout.
3. Of grams with several contexts one copy of each context is cut from its text.
   Tasks gather whole groups of up to ``GROUP`` contexts, lay them end to end and
   sort their suffixes in two stages: suffixes smaller than their successors are
   sorted directly, the others are induced from them by one scan over the buckets
   of first bytes.  Common prefixes of neighbours give the classes of equal
   windows, and each class its earliest place.
4. A gram with more contexts than that is split further by whole windows, whose
   earliest place is an aggregate combined before the shuffle.

Grams and contexts are told apart by 64-bit hashes each, contexts by both
together; suffixes are compared byte by byte, the windows of step 4 by 128 bits.

Defined results: null and empty texts have no bytes.  Rows without an id lose
nothing and repeat nothing.  Rows that repeat an id and its text are one document
and lose the same.  If an id has several texts, the one with the least hash is the
document; the other rows lose nothing and repeat nothing.  Matches never cross
documents; overlapping repeats count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.common import chosen_texts, columns, hashed_texts, one_text_per_id, utf8, written
from flowforge.session import release_shuffles, written_in_scope

WINDOW, GRAM = 100, 24
#: Contexts of one gram that a task sorts, and bytes of the groups it sorts at once.
GROUP, BATCH = 2048, 1 << 20
#: Window starts that a task looks at together, and the most bytes.
SLICE, PLACES = 1 << 19, (1 << 20) - 1

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20_260).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 512)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def anchors(data: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of pieces of documents laid end to end (``starts`` has the first byte of
    each and the end): gram hash, context hash, piece, first window (in its
    piece), anchor and last window (counted from the first)."""
    n = len(data) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 6
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * power[:len(data)], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * inverse[:len(sums) - gram])
    # the hash's high bits and the place below them: the least is the leftmost of equals
    # (always as many bits, so that equal windows agree wherever they are looked at)
    if len(data) > PLACES:
        raise ValueError("too many bytes at once")
    places = np.uint64(PLACES)
    least, size = (grams & ~places) | np.arange(len(grams), dtype=np.uint64), 1
    while size < window - gram + 1:
        step = min(size, window - gram + 1 - size)
        least, size = np.minimum(least[:len(least) - step], least[step:]), size + step
    best = (least & places).astype(np.int64)
    piece = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    fits = np.arange(n) + window <= starts[piece + 1]
    p, best, piece = np.flatnonzero(fits), best[fits], piece[fits]
    if not len(p):
        return (np.zeros(0, np.int64),) * 6
    first = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (piece[1:] != piece[:-1])))
    last = np.append(first[1:] - 1, len(p) - 1)
    lo, hi, a, d = p[first], p[last], best[first], piece[first]
    context = _mix((sums[hi + window] - sums[lo]) * inverse[lo] + ((a - lo) * 256 + hi - lo).astype(np.uint64))
    return grams[a].view(np.int64), context.view(np.int64), d, lo - starts[d], a - lo, hi - lo


def _records(window: int, gram: int):
    """g, c, doc, loc; loc packs (first window, anchor, last window)."""
    def solved(pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.cumsum([len(t) for *_, t in pieces])])
        g, c, d, lo, a, hi = anchors(np.frombuffer(b"".join(t for *_, t in pieces), np.uint8), starts, window, gram)
        doc, at = (np.array([p[k] for p in pieces], np.int64)[d] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (g, c, doc, ((lo + at) << 16) | (a << 8) | hi)], names=["g", "c", "doc", "loc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for ids, texts in columns(batches, "doc_id", "text", rows=256):
            for doc, text in zip(ids, texts, strict=True):
                for at in range(0, len(text) - window + 1, SLICE):
                    piece = text[at:at + SLICE + window - 1]
                    if held and size + len(piece) > SLICE:
                        yield solved(held)
                        held, size = [], 0
                    held.append((doc, at, piece))
                    size += len(piece)
        if held:
            yield solved(held)
    return run


def _first(loc: str):
    return F.shiftright(loc, 16)


def _last(loc: str):
    return F.shiftright(loc, 16) + F.col(loc).bitwiseAND(255)


def _contexts(window: int, split: bool):
    """Contexts cut from texts: g, c, doc, start, bytes; or, of large groups, a row
    for each window: g, c, doc, start, at, h1, h2 (hashes of the whole window)."""
    names = ["g", "c", "doc", "start", "at", "h1", "h2"] if split else ["g", "c", "doc", "start", "bytes"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "bytes" else pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for ids, texts, wanted in columns(batches, "doc_id", "text", "wanted", rows=64):
            for doc, text, places in zip(ids, texts, wanted, strict=True):
                for r in places:
                    lo, last = r["loc"] >> 16, r["loc"] & 255
                    if not split:
                        out.append((r["g"], r["c"], doc, lo, text[lo:lo + last + window]))
                        continue
                    for k in range(lo, lo + last + 1):
                        digest = hashlib.blake2b(text[k:k + window], digest_size=16).digest()
                        out.append((r["g"], r["c"], doc, lo, k - lo, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
                if len(out) >= 8192:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)
    return run


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later (the
    end is smaller than any byte)."""
    n = len(text)
    following = np.append(text[1:].astype(np.int16), -1)
    differs = np.where(following != text, np.arange(n), n)
    at = np.minimum.accumulate(differs[::-1])[::-1]  # the next place where neighbours differ
    return text[at] < following[at]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` bytes or more,
    by two-stage sorting."""
    n = len(text)
    direct = smaller_than_successor(text)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    views = np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))
    at = np.flatnonzero(direct)
    at = at[np.argsort(np.ascontiguousarray(views[at]).view(f"S{depth}").ravel(), kind="stable")]
    edges = np.searchsorted(text[at], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    end = np.array([n], np.int64)
    for c in range(-1, 256):
        # suffixes that start with c and are larger than their successors come before the others
        front = end if c < 0 else (np.concatenate(queues[c]) if queues[c] else end[:0])
        waves = [front]
        while len(waves[-1]):  # c before what starts with c
            before = waves[-1][waves[-1] > 0] - 1
            waves.append(before[~direct[before] & (text[before] == c)])
        bucket = np.concatenate([*waves, at[edges[c]:edges[c + 1]] if c >= 0 else end[:0]])
        if c >= 0:
            queues[c] = []
            out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~direct[before] & (text[before] != c)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        for part in np.split(before, np.flatnonzero(first[1:] != first[:-1]) + 1):
            if len(part):
                queues[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """How many of the first ``depth`` bytes at two places are equal."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(text) + depth, 8), (1, 1))
    out, live = np.full(len(left), depth, np.int64), np.arange(len(left))
    for k in range(0, depth, 8):
        a, b = (np.ascontiguousarray(words[x[live] + k]).view(np.uint64).ravel() for x in (left, right))
        differ = a != b
        if differ.any():
            unlike = (a[differ] ^ b[differ]).view(np.uint8).reshape(-1, 8) != 0
            out[live[differ]] = np.minimum(depth, k + unlike.argmax(axis=1))
            live = live[~differ]
    return out


def repeats(contexts: list[tuple[int, int, int, int, bytes]], window: int) -> list[tuple[int, int, int, int]]:
    """(g, c, first, last): of contexts (g, c, doc, start, bytes), the maximal runs
    of windows that are also in a context with an earlier place."""
    text = np.frombuffer(b"\0".join(x[4] for x in contexts).translate(_RAISED) + b"\0", np.uint8).copy()
    sizes = np.array([len(x[4]) for x in contexts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text[starts[1:] - 1] = 0  # 0 is between contexts only
    order = suffix_array(text, window)
    who = np.repeat(np.arange(len(contexts)), sizes + 1)
    at = np.arange(len(text)) - starts[who]
    order = order[at[order] + window <= sizes[who[order]]]
    same = common_prefixes(text, order[:-1], order[1:], window) >= window
    first = np.flatnonzero(np.append(True, ~same))
    docs = np.unique(np.array([x[2] for x in contexts], np.int64), return_inverse=True)[1]
    place = (docs[who[order]] << 40) + np.array([x[3] for x in contexts], np.int64)[who[order]] + at[order]
    least = np.repeat(np.minimum.reduceat(place, first), np.diff(np.append(first, len(order))))
    hits = np.sort(order[place > least])
    if not len(hits):
        return []
    first = np.flatnonzero(np.append(True, np.diff(hits) > 1))
    last = np.append(first[1:] - 1, len(hits) - 1)
    return [(*contexts[who[f]][:2], int(at[f]), int(at[k])) for f, k in zip(hits[first], hits[last], strict=True)]


#: UTF-8 has no byte above 0xF4, so all can be raised by one to leave 0 free.
_RAISED = bytes([*range(1, 256), 255])


def _groups(window: int, size: int):
    """Groups of one task: rows come sorted by gram; whole groups of about
    ``size`` bytes are sorted at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def solved() -> pa.RecordBatch:
            found = list(zip(*repeats(held, window), strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["g", "c", "first", "last"])

        for cols in columns(batches, "g", "c", "doc", "start", "bytes"):
            for row in zip(*cols, strict=True):
                if total >= size and held[-1][0] != row[0]:
                    yield solved()
                    held, total = [], 0
                held.append(row)
                total += len(row[4])
        if held:
            yield solved()
    return run


def repeated_byte_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                        group: int = GROUP, batch: int = BATCH) -> DataFrame:
    """doc, h (hash of the document's text), spans (array of (first byte, end byte)):
    of every document with repeated bytes, spans that cover them (they may overlap)."""
    return written_in_scope(docs.sparkSession, "suffix-spans", lambda: _spans(docs, id_col, text_col, window, gram, group, batch))


def _spans(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, group: int, batch: int) -> DataFrame:
    rows = hashed_texts(docs, id_col, text_col)
    chosen = chosen_texts(rows, "suffix-ids")
    base = one_text_per_id(rows, chosen)
    records = base.mapInArrow(_records(window, gram), "g long, c long, doc long, loc long")
    # sides of a join are written first: above an aggregate's exchange a hot gram can't be split
    shared = written(records.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "suffix-grams")
    records = written(records.join(shared, "g"), "suffix-records")
    release_shuffles(docs.sparkSession)  # of steps as large as the input each

    contexts = written(records.groupBy("g", "c").agg(F.min(F.struct("doc", "loc")).alias("m")).select("g", "c", "m.doc", "m.loc"), "suffix-contexts")
    forks = written(contexts.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-forks")
    copies = written(contexts.join(forks, "g"), "suffix-copies")

    def cut(some: DataFrame, split: bool, schema: str) -> DataFrame:
        wanted = some.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("g", "c", "loc")).alias("wanted"))
        return base.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_contexts(window, split), schema)

    runs = written(cut(copies.filter(F.col("n") <= group), False, "g long, c long, doc long, start long, bytes binary")
                   .repartition("g").sortWithinPartitions("g").mapInArrow(_groups(window, batch), "g long, c long, first long, last long"), "suffix-runs")
    release_shuffles(docs.sparkSession)
    large = copies.filter(F.col("n") > group)
    if large.limit(1).count():
        split = written(cut(large, True, "g long, c long, doc long, start long, at long, h1 long, h2 long"), "suffix-windows")
        place = F.struct("doc", (F.col("start") + F.col("at")).alias("place"))
        least = written(split.groupBy("h1", "h2").agg(F.min(place).alias("least")), "suffix-least")
        later = split.join(least, ["h1", "h2"]).filter(place > F.col("least"))
        runs = runs.union(later.select("g", "c", F.col("at").alias("first"), F.col("at").alias("last")))

    known = records.join(contexts.select("g", "c", F.col("doc").alias("m"), F.col("loc").alias("m_loc")), ["g", "c"])
    whole = known.filter("doc > m or loc > m_loc").select("doc", _first("loc").alias("a"), (_last("loc") + window).alias("b"))
    part = contexts.join(runs, ["g", "c"]).select("doc", (_first("loc") + F.col("first")).alias("a"), (_first("loc") + F.col("last") + window).alias("b"))
    spans = whole.union(part).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return spans.join(chosen, F.col("doc") == F.col("doc_id"), "left").select("doc", "low", "spans")


def keep_mask(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes no span covers."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, first, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth)[:n] == 0


def kept_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the
    remaining bytes; a character may be cut through)."""
    return _cleaned(docs, id_col, text_col, lambda b: b, pa.binary(), "kept binary", options)


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _cleaned(docs, id_col, text_col, lambda b: hashlib.sha256(b).hexdigest(), pa.string(), "kept_sha256 string", options)


def _cleaned(docs: DataFrame, id_col: str, text_col: str, of, kind: pa.DataType, column: str, options: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(2)
                offsets, flat = lists.offsets.to_pylist(), lists.values
                a, b = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("a", "b"))
                out = []
                for k, text in enumerate(part.column(1)):
                    raw, some = text.as_py(), slice(offsets[k], offsets[k + 1]) if lists[k].is_valid else slice(0, 0)
                    removed = runs = 0
                    left = raw
                    if some.stop > some.start:
                        data = np.frombuffer(raw, np.uint8)
                        keep = keep_mask(len(data), a[some], b[some])
                        left, removed = data[keep].tobytes(), int(len(data) - keep.sum())
                        runs = int((~keep & np.append(True, keep[:-1])).sum())
                    out.append((len(raw), removed, runs, of(left)))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in cols[:3]], pa.array(cols[3], kind)],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", column.split()[0]])

    spans = repeated_byte_spans(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    here = (F.col("doc_id") == F.col("doc")) & (F.col("low").isNull() | (F.col("low") == F.xxhash64("text")))
    return (rows.join(spans, here, "left").select("doc_id", "text", "spans")
            .mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {column}"))
