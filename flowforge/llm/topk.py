"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

1. Components become whole numbers, ``floor(scale * x)``; scores are exact.
2. A rotation onto the principal axes is fitted on a bounded sample (at most
   ``SAMPLE`` vectors by hash of the id; any rotation gives the same results).
3. All vectors are range-partitioned and sorted by falling length, and packed
   into blocks of ``BLOCK`` rows; the queries likewise into blocks of
   ``QUERIES`` rows.  The ``SEEDS`` longest vectors, a bounded set, give each
   query a first lower bound of its k-th score.
4. Each query block goes to the partitions it may still profit from, by an
   equi-join.  In a pair of blocks, vectors are visited by falling length; a
   query stops at the first group whose greatest length can't reach its bound.
   For the rest, the inner product over the leading rotated components plus
   Cauchy-Schwarz for the remainder is an upper bound; only pairs that reach the
   query's bound (ties included) are multiplied out, in whole numbers.
5. A window keeps the k best of what the blocks return.

The work per task is one pair of blocks; no task holds all queries or vectors.

Defined results: vectors that are null or hold null or non-finite components,
and rows without id, take no part.  Vectors of unequal length compare as if the
shorter ended in zeros.  Scores beyond 64 bits stop at the largest or least
64-bit number.  Rows that repeat both id and vector count once; a query
never meets a row of its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowforge.llm.common import written

SAMPLE, SEEDS = 20_000, 2048
BLOCK, QUERIES = 8192, 512
#: Rotated components in the partial sums, and vectors visited at once.
HEAD, GROUP = 16, 1024
#: Components within this are multiplied in doubles without rounding.
EXACT = 1 << 20


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v (array of whole doubles), norm2 of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(fine)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def rotation(rows: DataFrame) -> np.ndarray:
    """Principal axes (as columns), from at most ``SAMPLE`` vectors."""
    sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    if not sample:
        return np.eye(1)
    matrix = _matrix(sample)
    return np.linalg.svd(matrix.T @ matrix)[0]


def _matrix(lists: list, width: int = 0) -> np.ndarray:
    width = max([width, *map(len, lists)])
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def _rotated(v: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated components, and the length of the remainder."""
    head = v[:, :len(axes)] @ axes[:v.shape[1], :HEAD]
    rest = (v * v).sum(1) - (head * head).sum(1)
    return head, np.sqrt(np.maximum(rest, 0))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact row-wise inner products."""
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    if width == 0 or not len(q):
        return np.zeros(len(q), np.int64)
    if max(np.abs(q).max(), np.abs(v).max()) <= EXACT and width <= 4096:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, v, strict=True)]
    return np.array([max(-2**63, min(2**63 - 1, s)) for s in big], np.int64)


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, k: int):
        self.ids, self.bounds, self.k = ids, bounds.astype(float), k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores >= self.bounds[rows]) & (ids != self.ids[rows])
        for r, s, i in zip(rows[keep].tolist(), scores[keep].tolist(), ids[keep].tolist(), strict=True):
            self.found[r].append((-s, i))
        for r in set(rows[keep].tolist()):
            best = self.found[r] = sorted(self.found[r])[:self.k]
            if len(best) == self.k:
                self.bounds[r] = max(self.bounds[r], -best[-1][0])


def search(q: np.ndarray, best: Best, ids: np.ndarray, v: np.ndarray, axes: np.ndarray) -> None:
    """Adds to ``best`` from vectors sorted by falling length."""
    q_norm, v_norm = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
    q_head, q_rest = _rotated(q, axes)
    v_head, v_rest = _rotated(v, axes)
    for at in range(0, len(v), GROUP):
        part = slice(at, at + GROUP)
        slack = 1e-9 * q_norm * v_norm[at] + 1e-6
        live = np.flatnonzero(q_norm * v_norm[at] + slack >= best.bounds)
        if not len(live):
            return  # all later vectors are shorter
        bound = q_head[live] @ v_head[part].T + q_rest[live, None] * v_rest[None, part]
        rows, cols = np.nonzero(bound + slack[live, None] >= best.bounds[live, None])
        rows, cols = live[rows], cols + at
        for k in range(0, len(rows), 200_000):
            a, b = rows[k:k + 200_000], cols[k:k + 200_000]
            best.add(a, _scores(q[a], v[b]), ids[b])


_PACKED = "part int, top double, n int, width int, ids binary, v binary"


def _pack(rows_per_block: int):
    """Sorted (id, v, norm2) rows as blocks; repeated rows lie side by side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, last = TaskContext.get().partitionId(), [], None

        def flush():
            m = _matrix([v for _, v in block])
            top = float(np.sqrt((m * m).sum(1).max()))
            ids = np.array([i for i, _ in block], np.int64)
            out = [[part], [top], [len(ids)], [m.shape[1]], [ids.tobytes()], [m.tobytes()]]
            block.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                names=["part", "top", "n", "width", "ids", "v"])

        for batch in batches:
            ids, vectors = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "v"))
            for row in zip(ids, vectors, strict=True):
                if row != last:
                    block.append(row)
                    last = row
                    if len(block) == rows_per_block:
                        yield flush()
        if block:
            yield flush()
    return run


def top_inner_products(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                       k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every
    row that fulfils ``queries`` (a condition on the columns of ``vectors``);
    ties go to the smaller id."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vec_col, scale)
    axes = spark.sparkContext.broadcast(rotation(rows))
    by_length = [F.desc("norm2"), "id", "v"]
    seeds = [(r.id, r.v) for r in rows.orderBy(*by_length).limit(SEEDS).collect()]
    seeds = [s for n, s in enumerate(seeds) if not n or s != seeds[n - 1]]
    seed_ids = spark.sparkContext.broadcast(np.array([s[0] for s in seeds], np.int64))
    seed_rows = spark.sparkContext.broadcast(_matrix([s[1] for s in seeds]) if seeds else np.zeros((0, 1)))

    blocks = written(rows.repartitionByRange(F.desc("norm2"), "id").sortWithinPartitions(*by_length).mapInArrow(_pack(BLOCK), _PACKED), "topk-vectors")
    tops = blocks.groupBy("part").agg(F.max("top").alias("part_top"))

    asked = whole_vectors(vectors.filter(queries), id_col, vec_col, scale)
    q_blocks = asked.repartitionByRange(F.desc("norm2"), "id").sortWithinPartitions(*by_length).mapInArrow(_pack(QUERIES), _PACKED)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, q = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["v"]).reshape(r["n"], r["width"])
                best = Best(ids, np.full(len(ids), -np.inf), k)
                search(q, best, seed_ids.value, seed_rows.value, axes.value)
                # a query reaches a partition if its bound lies within length x length
                norm = np.sqrt((q * q).sum(1))
                need = np.where(norm > 0, best.bounds / np.maximum(norm, 1e-300), np.where(best.bounds > 0, np.inf, -np.inf))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((r["n"], pa.int32()), (r["width"], pa.int32()), (r["ids"], pa.binary()), (r["v"], pa.binary()),
                                                   (best.bounds.tobytes(), pa.binary()), (float(need.min()), pa.float64()))],
                    names=["qn", "qwidth", "qids", "q", "bounds", "need"])

    q_blocks = written(q_blocks.mapInArrow(bounds, "qn int, qwidth int, qids binary, q binary, bounds binary, need double"), "topk-queries")
    # one row per partition of vectors (as many as shuffle partitions), each with its greatest length
    parts = tops.agg(F.collect_list(F.struct("part", "part_top")).alias("parts"))
    sent = (q_blocks.crossJoin(F.broadcast(parts)).withColumn("p", F.explode("parts"))
            .filter(F.col("p.part_top") * (1 + 1e-9) + 1e-6 >= F.col("need")).drop("parts")
            .withColumn("part", F.col("p.part")).drop("p", "need"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                q_ids = np.frombuffer(r["qids"], np.int64)
                best = Best(q_ids, np.frombuffer(r["bounds"]), k)
                search(np.frombuffer(r["q"]).reshape(r["qn"], r["qwidth"]), best, np.frombuffer(r["ids"], np.int64),
                       np.frombuffer(r["v"]).reshape(r["n"], r["width"]), axes.value)
                out = [(int(i), j, -s) for i, found in zip(q_ids, best.found, strict=True) for s, j in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    pairs = blocks.select("part", "n", "width", "ids", "v").join(sent, "part")
    found = pairs.mapInArrow(compare, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""
