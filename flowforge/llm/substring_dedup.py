"""Removal of repeated passages with prefix-partitioned suffix trees of words.

A *window* is ``WINDOW`` consecutive words of a document.  A window is repeated
if its words also start somewhere in a document with a smaller id; every word
that a repeated window covers goes.  In the suffix tree over all word positions
these are the internal nodes at depth ``WINDOW`` or more.  The tree is never
built whole:

1. *Anchors.*  A window's anchor is the gram of ``GRAM`` words within it with
   the smallest hash (leftmost of equals).  Equal windows have equal anchors at
   equal places, so suffixes can be split by the prefix that ends with the
   anchor, and the windows of one anchor (about twenty) travel as one record of
   a few numbers.  The *context* of an anchor is all the words of its windows.
2. Grams that occur in one document only can't lie in a repeated window; their
   records go (counts are combined before the shuffle).
3. Records with the same context: all but those of the smallest document are
   repeated throughout.  A gram with one context needs no more.
4. A gram with several contexts spans a subtree.  Of each context one copy is
   cut from its text; prefixes are dealt to tasks, which gather subtrees of up to
   ``SUBTREE`` contexts and name their nodes at depth 1, 2, 4, ... 32 and
   ``WINDOW`` (two windows have the same name if and only if they are the same
   node).  The smallest document below a node tells which windows are repeated;
   neighbouring ones merge into maximal repeats.
5. A prefix with more contexts than that is lengthened to the whole window,
   where the smallest document per node is an aggregate combined before the
   shuffle.

Words are compared by 64-bit hashes, grams by 64 bits, contexts by 128 (gram and
context together), windows of step 5 by 128; windows within a subtree by the
sequence of their words' hashes.

Defined results: null and empty texts have no words.  Rows without an id lose
nothing.  Ids identify documents: rows that repeat an id and text are treated
alike, and never count as repeats of each other.  If an id has several texts, the
one with the least hash is the document; the other rows lose nothing and repeat
nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.common import WORD_HASHES, chosen_texts, columns, hashed_texts, one_text_per_id, utf8, written

WINDOW, GRAM = 50, 12
#: Contexts of one prefix, and of one batch of prefixes, that a task holds.
SUBTREE = 8192

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16), b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the leftmost least of ``width`` values."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:len(at) - step], at[step:]
        at, size = np.where(values[a] <= values[b], a, b), size + step
    return at


def anchors(h: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end (``starts`` has the first word of each and
    the end): gram hash, context hash, document number, first window (in its
    document), anchor and last window (counted from the first)."""
    power, inverse = _powers(len(h) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:len(h)])])
    grams = _mix((sums[gram:] - sums[:-gram]) * inverse[:len(sums) - gram])
    best = _leftmost_least(grams, window - gram + 1)
    doc = np.searchsorted(starts, np.arange(len(best)), side="right") - 1
    fits = np.arange(len(best)) + window <= starts[doc + 1]
    p, best, doc = np.flatnonzero(fits), best[fits], doc[fits]
    if not len(p):
        return (np.zeros(0, np.int64),) * 6
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(p) - 1]])
    lo, hi, a, d = p[first], p[last], best[first], doc[first]
    context = _mix((sums[hi + window] - sums[lo]) * inverse[lo] + ((a - lo) * 256 + hi - lo).astype(np.uint64))
    return grams[a].view(np.int64), context.view(np.int64), d, lo - starts[d], a - lo, hi - lo


def _anchor_rows(window: int, gram: int):
    """g, c, doc, loc; loc packs (first window, anchor, last window)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text", rows=128):
            hashes = [(i, word_hashes(w)) for i, w in ((i, t.split()) for i, t in zip(ids, texts, strict=True)) if len(w) >= window]
            if hashes:
                starts = np.concatenate([[0], np.cumsum([len(h) for _, h in hashes])])
                g, c, d, lo, a, hi = anchors(np.concatenate([h for _, h in hashes]), starts, window, gram)
                who = np.array([i for i, _ in hashes], np.int64)[d]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, c, who, (lo << 16) | (a << 8) | hi)], names=["g", "c", "doc", "loc"])
    return run


def _first(loc: str):
    return F.shiftright(loc, 16)


def _last(loc: str):
    return F.shiftright(loc, 16) + F.col(loc).bitwiseAND(255)


def _contexts(window: int, hot: bool):
    """Contexts cut from texts: g, c, m, words; or, of prefixes to lengthen, a
    row for each window: g, c, m, at, h1, h2 (hashes of the whole window)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, wanted in columns(batches, "doc_id", "text", "wanted", rows=64):
            out = []
            for doc, text, places in zip(ids, texts, wanted, strict=True):
                h = word_hashes(text.split())
                for r in places:
                    lo, last = r["at"] >> 16, r["at"] & 255
                    part = h[lo:lo + last + window]
                    if not hot:
                        out.append((r["g"], r["c"], doc, part.tobytes()))
                        continue
                    for k in range(last + 1):
                        digest = hashlib.blake2b(part[k:k + window].tobytes(), digest_size=16).digest()
                        out.append((r["g"], r["c"], doc, k, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
                if len(out) >= 4096:
                    yield _batch(out, hot)
                    out = []
            if out:
                yield _batch(out, hot)
    return run


def _batch(rows: list[tuple], hot: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    if hot:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["g", "c", "m", "at", "h1", "h2"])
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["g", "c", "m", "words"])


def window_names(words: np.ndarray, window: int) -> np.ndarray:
    """The node at depth ``window`` below which each suffix lies, by naming
    nodes at depth 1, 2, 4, ... from pairs of names."""
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    names, depth = np.unique(words, return_inverse=True)[1], 1
    while 2 * depth <= window:
        names, depth = pair(names[:-depth], names[depth:]), 2 * depth
    rest = window - depth
    return pair(names[:-rest], names[rest:]) if rest else names


def repeats(contexts: list[tuple[int, int, int, bytes]], window: int) -> list[tuple[int, int, int, int]]:
    """(g, c, first, last): the maximal runs of windows of each context that
    also occur in a document smaller than its own."""
    arrays = [np.frombuffer(w, np.uint64) for *_, w in contexts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    names = window_names(np.concatenate(arrays), window)
    counts = np.diff(starts) - window + 1
    who = np.repeat(np.arange(len(arrays)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    node = names[starts[who] + at]
    docs = np.array([m for _, _, m, _ in contexts], np.int64)
    least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, docs[who])
    hit = least[node] < docs[who]
    out = []
    edges = np.flatnonzero(hit)
    if len(edges):
        new = np.concatenate([[True], (np.diff(edges) > 1) | (np.diff(who[edges]) > 0)])
        firsts = np.flatnonzero(new)
        lasts = np.concatenate([firsts[1:] - 1, [len(edges) - 1]])
        for f, k in zip(edges[firsts], edges[lasts], strict=True):
            g, c, _, _ = contexts[who[f]]
            out.append((g, c, int(at[f]), int(at[k])))
    return out


def _subtrees(window: int, limit: int):
    """Subtrees of one task: rows come sorted by prefix; batches of whole
    prefixes with up to about ``limit`` contexts are solved at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(rows):
            found = repeats(rows, window)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 4)], names=["g", "c", "first", "last"])

        for cols in columns(batches, "g", "c", "m", "words"):
            for row in zip(*cols, strict=True):
                if len(held) >= limit and held[-1][0] != row[0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, limit: int = SUBTREE) -> DataFrame:
    """doc, low (the hash of its text, null if the id has one text only), spans
    (array of (first word, end word)): of every document with repeated words, spans
    that cover them (they may overlap)."""
    texts = hashed_texts(docs, id_col, text_col)
    chosen = chosen_texts(texts, "repeat-ids")
    base = one_text_per_id(texts, chosen)
    rows = base.mapInArrow(_anchor_rows(window, gram), "g long, c long, doc long, loc long")
    # written by itself: a join with an aggregate above its own exchange can't be split at a hot gram
    shared = written(rows.groupBy("g").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("g"), "repeat-grams")
    rows = written(rows.join(shared, "g"), "repeat-anchors")

    contexts = written(rows.groupBy("g", "c").agg(F.min("doc").alias("m"), F.min_by("loc", "doc").alias("at")), "repeat-contexts")
    forks = written(contexts.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"), "repeat-fork-sizes")
    copies = written(contexts.join(forks, "g"), "repeat-forks")

    def cut(some: DataFrame, hot: bool, schema: str) -> DataFrame:
        wanted = some.groupBy("m").agg(F.collect_list(F.struct("g", "c", "at")).alias("wanted")).withColumnRenamed("m", "doc_id")
        return base.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_contexts(window, hot), schema)

    runs = (cut(copies.filter(F.col("n") <= limit), False, "g long, c long, m long, words binary")
            .repartition("g").sortWithinPartitions("g").mapInArrow(_subtrees(window, limit), "g long, c long, first long, last long"))
    long_prefixes = copies.filter(F.col("n") > limit)
    if long_prefixes.limit(1).count():
        nodes = written(cut(long_prefixes, True, "g long, c long, m long, at long, h1 long, h2 long"), "repeat-windows")
        least = written(nodes.groupBy("h1", "h2").agg(F.min("m").alias("least")), "repeat-least")
        runs = runs.union(nodes.join(least, ["h1", "h2"]).filter("least < m").select("g", "c", F.col("at").alias("first"), F.col("at").alias("last")))

    known = rows.join(contexts.select("g", "c", "m"), ["g", "c"])
    whole = known.filter("doc > m").select("doc", _first("loc").alias("a"), (_last("loc") + window).alias("b"))
    part = (known.filter("doc = m").join(runs, ["g", "c"])
            .select("doc", (_first("loc") + F.col("first")).alias("a"), (_first("loc") + F.col("last") + window).alias("b")))
    spans = whole.union(part).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return written(spans.join(chosen, F.col("doc") == F.col("doc_id"), "left").select("doc", "low", "spans"), "repeat-spans")


def keep_mask(n: int, spans: list) -> np.ndarray:
    """Which of ``n`` words no span covers."""
    depth = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(depth, [s["a"] for s in spans], 1)
        np.add.at(depth, [s["b"] for s in spans], -1)
    return np.cumsum(depth)[:n] == 0


def _with_spans(docs: DataFrame, id_col: str, text_col: str, spans: DataFrame) -> DataFrame:
    own = F.col("low").isNull() | (F.col("low") == F.xxhash64(utf8(F.col(text_col))))
    return docs.join(spans, (F.col(id_col) == F.col("doc")) & own, "left").drop("doc", "low")


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, spans in columns(batches, "doc_id", "text", "spans", rows=512):
            out = []
            for doc, text, some in zip(ids, texts, spans, strict=True):
                words = text.split()
                left = [w for w, k in zip(words, keep_mask(len(words), some), strict=True) if k] if some else words
                out.append((doc, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    spans = repeated_spans(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    return _with_spans(rows, "doc_id", "text", spans).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated words removed from the text: of documents that
    lose any, the kept words joined by one space; other rows and columns stay."""
    names = docs.columns
    id_at, text_at = names.index(id_col), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, spans = part.column(text_at), part.column(len(names)).to_pylist()
                if any(spans):
                    out = []
                    for text, some in zip(texts.to_pylist(), spans, strict=True):
                        if some:
                            words = text.encode().split()
                            text = b" ".join([w for w, k in zip(words, keep_mask(len(words), some), strict=True) if k]).decode()
                        out.append(text)
                    texts = pa.array(out, texts.type)
                cols = [texts if n == text_at else part.column(n) for n in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{n}" for n in range(len(names))])

    spans = repeated_spans(docs, id_col, text_col, **options)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(names)])
    joined = _with_spans(plain, f"c{id_at}", f"c{text_at}", spans).select(*plain.columns, "spans")
    return joined.mapInArrow(run, plain.schema).toDF(*names)
