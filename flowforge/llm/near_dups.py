"""Near-duplicates by bottom-k sketches of one hash function.

1. Each document's set of word shingles becomes 64-bit hashes; the ``KEEP``
   smallest are its sketch.  Documents with equal sets (by a digest of the whole
   set) form one class, which its smallest id stands for.
2. Inverted lists: runs of ``RUN`` retained values that follow each other in
   sketch order are the keys.  Two sets above the threshold share very many
   (of ``KEEP`` = 48 and threshold 0.8, none with probability below 1e-7; none
   is impossible while the union fits the sketch), while documents that merely
   share a frequent line or passage share few.
3. Lists of up to ``LIST`` members give all their pairs.  A longer list gives
   only the pairs with its smallest member (a star), so no list makes a number
   of pairs that grows with its square.
4. Pairs are filtered by set size (exact) and by the estimate from the sketch of
   the union, far below the threshold; what is left is verified on whole sets.
5. Components of the verified links.  Members of long lists that are not in the
   component of their star's centre are then compared with the members around that
   centre that are in another component.  Around a centre with more than ``GROUP``
   members, prefixes of whole sets decide which pairs can be linked at all: with the
   group's shingles ordered by how rare they are in the group, two sets above the
   threshold share one of the first ``n - ceil(threshold * n) + 1`` of either.  A
   passage that all members share is in no prefix, so documents that share just that
   give no pairs.
6. Groups of up to ``GROUP`` members, and larger ones whose prefixes meet so often
   that most members are near copies of each other, are compared block by block: a
   block holds about ``BLOCK`` sets on either side and counts all intersections at
   once, returning only verified links.  So no link between lists' members is lost,
   and no task holds a whole group.

Defined results: null and empty texts have the empty set, linked with nothing;
null ids are kept and linked with nothing of their own; rows that repeat an id
and a text are one class, and all are kept with it; an id with several texts is one
document that is linked by any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.common import WORD_HASHES, columns, utf8, written
from flowforge.llm.components import components

KEEP, RUN = 48, 3
LIST = 8
BLOCK, GROUP = 256, 1024
#: The estimate may lie so far below the threshold before a pair is dropped.
MARGIN = 0.4

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of ``words`` words; of fewer
    words, of the whole sequence."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORD_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(h))
    n = len(h) - size + 1
    x = np.full(n, size, np.uint64)
    for i in range(size):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return np.unique(x)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            sets = [shingles(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([s[:KEEP].tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "digest", "sketch"])
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each sketch: runs of RUN values, of the smallest sets (where
    a run might be broken everywhere) pairs too."""
    for reps, sizes, sketches in columns(batches, "rep", "n", "sketch"):
        out_keys, out_reps = [], []
        for rep, n, sketch in zip(reps, sizes, sketches, strict=True):
            s = np.frombuffer(sketch, np.uint64)
            for run in {RUN, 2} if n <= 2 * RUN else {RUN}:
                if len(s) >= run:
                    key = np.full(len(s) - run + 1, run, np.uint64)
                    for i in range(run):
                        key = _mix(key * np.uint64(31) + s[i:len(s) - run + 1 + i])
                    out_keys.append(key.view(np.int64))
                    out_reps += [rep] * len(key)
        if out_keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys)), pa.array(out_reps, pa.int64())], names=["key", "rep"])


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from the bottom-k sketch of the union."""
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:][both[1:] == both[:-1]]
    union = np.unique(both)[:KEEP]
    return float((twice <= union[-1]).sum()) / len(union) if len(union) else 0.0


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, x, y in columns(batches, "a", "b", "x", "y"):
            keep = [estimate(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= least for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).filter(pa.array(keep, pa.bool_())) for c in (a, b)], names=["a", "b"])
    return run


def linked(inter, union, num: int, den: int):
    return inter * den >= union * num


def _verify(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, x, y in columns(batches, "a", "b", "x", "y", rows=256):
            sets: dict[bytes, np.ndarray] = {}
            out = []
            for i, j, p, q in zip(a, b, x, y, strict=True):
                s, t = (sets[k] if k in sets else sets.setdefault(k, shingles(k, words)) for k in (p, q))
                inter = len(np.intersect1d(s, t, assume_unique=True))
                if len(s) and linked(inter, len(s) + len(t) - inter, num, den):
                    out.append((i, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets.  Hashes frequent
    on both sides are counted by a matrix product, the others pair by pair."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return out
    lv, rv = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(lv, rv)
    sides = []
    for values, sets in ((lv, left), (rv, right)):
        who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        hit = common[at] == values if len(common) else np.zeros(len(values), bool)
        at, who = at[hit], who[hit]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], who[order]))
    counts = [np.bincount(at, minlength=len(common)) for at, _ in sides]
    starts = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
    dense = np.flatnonzero(counts[0] * counts[1] > 64)
    for k in range(0, len(dense), 4096):
        some = dense[k:k + 4096]
        place = np.full(len(common), -1)
        place[some] = np.arange(len(some))
        grids = []
        for (at, who), n in zip(sides, out.shape, strict=True):
            col = place[at]
            grid = np.zeros((n, len(some)), np.float32)
            grid[who[col >= 0], col[col >= 0]] = 1
            grids.append(grid)
        out += np.rint(grids[0] @ grids[1].T).astype(np.int64)
    sparse = np.flatnonzero(counts[0] * counts[1] <= 64)
    for k in range(0, len(sparse), 50_000):
        some = sparse[k:k + 50_000]
        a, b = counts[0][some], counts[1][some]
        n = a * b
        which = np.repeat(np.arange(len(some)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = sides[0][1][starts[0][some][which] + nth // b[which]]
        j = sides[1][1][starts[1][some][which] + nth % b[which]]
        out += np.bincount(i * out.shape[1] + j, minlength=out.size).reshape(out.shape)
    return out


def _compare(words: int, num: int, den: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        l_text, l_label, a = (left.column("l_" + c).to_pylist() for c in ("text", "label", "rep"))
        r_text, r_label, b = (right.column("r_" + c).to_pylist() for c in ("text", "label", "rep"))
        ls, rs = [shingles(t, words) for t in l_text], [shingles(t, words) for t in r_text]
        inter = intersections(ls, rs)
        sizes = np.add.outer(np.array([len(s) for s in ls], np.int64), np.array([len(s) for s in rs], np.int64))
        differ = np.not_equal.outer(np.array(l_label, np.int64), np.array(r_label, np.int64))
        i, j = np.nonzero(linked(inter, sizes - inter, num, den) & differ)
        return pa.table({"a": pa.array(np.array(a, np.int64)[i]), "b": pa.array(np.array(b, np.int64)[j])})
    return run


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    found = labels.select(F.col("node").alias(column), F.col("label").alias("_l"))
    return rows.join(found, column, "left").withColumn(name, F.coalesce("_l", column)).drop("_l")


def _apart(long_lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members around each centre (center, rep, label, apart: not in the centre's
    component), and the size of the groups with members apart (m, u of them)."""
    groups = long_lists.select("center", "rep").distinct()
    groups = _labelled(_labelled(groups, labels, "rep", "label"), labels, "center", "center_label")
    groups = written(groups.withColumn("apart", F.col("label") != F.col("center_label")).drop("center_label"), "near-groups")
    sizes = groups.groupBy("center").agg(F.count("*").alias("m"), F.sum(F.col("apart").cast("long")).alias("u")).filter("u > 0")
    return groups, written(sizes, "near-group-sizes")


def _blocks(rows: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Verified links between members of different components, block by block;
    ``rows`` are the members of whole groups with m and u."""
    rows = rows.withColumn("cl", F.ceil(F.col("u") / BLOCK).cast("long")).withColumn("cr", F.ceil(F.col("m") / BLOCK).cast("long"))
    spread = F.xxhash64("rep")
    left = (rows.filter("apart").withColumn("i", F.pmod(spread, F.col("cl")))
            .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cr") - 1))))
    right = rows.withColumn("j", F.pmod(spread, F.col("cr"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cl") - 1)))
    names = ["center", "i", "j", "rep", "label", "text"]
    left, right = (side.join(texts.withColumnRenamed("id", "rep"), "rep").select(*[F.col(c).alias(end + c) for c in names])
                   for side, end in ((left, "l_"), (right, "r_")))
    return (left.groupBy("l_center", "l_i", "l_j").cogroup(right.groupBy("r_center", "r_i", "r_j"))
            .applyInArrow(_compare(words, num, den), "a long, b long"))


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for centers, reps, apart, texts in columns(batches, "center", "rep", "apart", "text", rows=256):
            sets = [shingles(t, words).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(centers, pa.int64()), pa.array(reps, pa.int64()), pa.array(apart, pa.bool_()),
                                              pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["center", "rep", "apart", "n", "set"])
    return run


def prefixes(members: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """center, shingle, rep, apart, n: the members' prefixes, shingles ordered by
    how many members of the group have them; shingles that only one has can be in
    no other prefix and go."""
    sets = members.select("center", "rep", "apart").join(texts.withColumnRenamed("id", "rep"), "rep").select("center", "rep", "apart", "text") \
        .mapInArrow(_sets(words), "center long, rep long, apart boolean, n long, set array<long>")
    each = written(sets.select("center", "rep", "apart", "n", F.explode("set").alias("shingle")), "near-members")
    held = written(each.groupBy("center", "shingle").agg(F.count("*").alias("held")), "near-held")
    ordered = (each.join(held, ["center", "shingle"]).groupBy("center", "rep", "apart", "n")
               .agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("all")))
    # of sets of n, the part that a linked partner must meet: n - ceil(n * num / den) + 1
    size = F.col("n") - F.floor((F.col("n") * num + (den - 1)) / den) + 1
    first = ordered.select("center", "rep", "apart", "n", F.explode(F.slice("all", F.lit(1), size.cast("int"))).alias("x"))
    return first.filter("x.held > 1").select("center", F.col("x.shingle").alias("shingle"), "rep", "apart", "n")


def _pairs(postings: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members of one prefix shingle in different components, one
    of them apart from the centre."""
    rows = _labelled(postings, labels, "rep", "label")
    other = rows.select("center", "shingle", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("label").alias("label_b"))
    rows = rows.filter("apart").select("center", "shingle", F.col("rep").alias("a"), F.col("n").alias("na"), "label")
    pairs = rows.join(written(other, "near-prefix-sides"), ["center", "shingle"]).filter(
        (F.col("label") != F.col("label_b")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _unsettled(long_lists: DataFrame, links: DataFrame, labels: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Labels with all links around centres between different components."""
    groups, sizes = _apart(long_lists, labels)
    if not sizes.limit(1).count():
        return labels
    rows, found = groups.join(sizes, "center"), []
    blocks = rows.filter(F.col("m") <= GROUP)
    if sizes.filter(F.col("m") > GROUP).limit(1).count():
        postings = written(prefixes(rows.filter(F.col("m") > GROUP), texts, words, num, den), "near-prefixes")
        lists = postings.groupBy("center", "shingle").agg(F.count("*").alias("m"), F.sum(F.col("apart").cast("long")).alias("u"))
        dense = lists.groupBy("center").agg(F.sum(F.col("m").cast("double") * F.col("u")).alias("pairs"), F.sum("m").alias("postings"))
        dense = written(dense.filter(F.col("pairs") > LIST * F.col("postings")).select("center"), "near-dense")
        blocks = blocks.unionByName(rows.filter(F.col("m") > GROUP).join(dense, "center", "left_semi"))
        found.append(verified(_pairs(postings.join(dense, "center", "left_anti"), labels, num, den), texts, words, num, den))
    found.append(_blocks(blocks, texts, words, num, den))
    for more in found:
        links = links.union(more)
    return written(components(links), "near-labels")


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked."""
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(_verify(words, num, den), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, num: int = 85, den: int = 100,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.  Documents
    are linked when ``den * intersection >= num * union`` of their sets."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    sets = written(base.mapInArrow(_sketches(words), "doc_id long, n long, digest binary, sketch binary"), "near-sets")
    classes = written(sets.filter("n > 0 and doc_id is not null").groupBy("digest", "n", "sketch").agg(F.min("doc_id").alias("rep")), "near-classes")

    postings = classes.select("rep", "n", "sketch").mapInArrow(_keys, "key long, rep long")
    # written by itself: a join with an aggregate above its own exchange can't be split at a hot key
    lists = written(postings.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("center")).filter("size > 1"), "near-list-sizes")
    shared = written(postings.join(lists, "key"), "near-lists")
    long_lists = shared.filter(F.col("size") > LIST)
    short = (shared.filter(F.col("size") <= LIST).groupBy("key").agg(F.array_sort(F.collect_list("rep")).alias("m"))
             .select("m", F.posexplode("m").alias("at", "a")).select("a", F.explode(F.slice("m", F.col("at") + 2, F.size("m"))).alias("b")))
    stars = long_lists.filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b"))
    pairs = short.union(stars).filter("a < b").distinct()

    half = classes.select("rep", "n", "sketch")
    for end, size, sketch in (("a", "na", "x"), ("b", "nb", "y")):
        pairs = pairs.join(half.select(F.col("rep").alias(end), F.col("n").alias(size), F.col("sketch").alias(sketch)), end)
    fitting = pairs.filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    likely = written(fitting.select("a", "b", "x", "y").mapInArrow(_likely(num / den - MARGIN), "a long, b long"), "near-pairs")

    wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).union(long_lists.select("rep")).distinct()
    texts = written(base.join(wanted, "doc_id").withColumnRenamed("doc_id", "id"), "near-texts")
    links = written(verified(likely, texts, words, num, den), "near-links")

    labels = _unsettled(long_lists, links, written(components(links), "near-labels"), texts, words, num, den)

    home = _labelled(classes.select("digest", "rep"), labels, "rep", "component").select("digest", "component")
    out = sets.join(home, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
