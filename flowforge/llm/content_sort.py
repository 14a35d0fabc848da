"""Exact dedup by content sort.

Sampled splitters range-partition the rows by their normalised bytes, each
partition is sorted externally (Spark's spilling sort) so equal texts become
adjacent, and full comparisons of neighbours find the groups.

* Normalised text: the text without any character of ``[\\x20\\x09-\\x0D]``.
* The sort key is (first bytes of the normalised text, its SHA-256, most code
  points first, smallest id first).  The key has a bounded size, so the
  splitters that Spark samples stay small however long texts are; and since it
  ends in the id, one huge group of copies is spread over many partitions.
* A group that crosses partition borders is put together again from one small
  record per partition; the two texts at each border are compared in full.

Defined results: null text counts as empty; all empty texts form one group;
null ids sort last; of rows that repeat text and id one is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowforge.llm.common import SPACE_PATTERN, SPACES, utf8, written

#: Bytes of normalised text at the head of the sort key.
PREFIX = 24

def _sorted(docs: DataFrame, id_col: str, text_col: str, payload: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, SPACE_PATTERN, "")
    keyed = docs.select(
        F.substring(utf8(norm), 1, PREFIX).alias("k1"), F.unhex(F.sha2(norm, 256)).alias("k2"),
        (-F.char_length(text)).alias("k3"), F.col(id_col).cast("long").alias("k4"), utf8(F.col(text_col)).alias("k5"),
        *([F.struct(*[F.col(f"`{c}`") for c in payload]).alias("row")] if payload else []))
    order = ["k1", "k2", "k3", F.col("k4").asc_nulls_last()]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


def _neighbours(batch: pa.RecordBatch, last: bytes | None) -> Iterator[tuple[int, bytes, bool]]:
    """(row of batch, normalised text, differs from the text before?) in sort order."""
    texts = batch.column(batch.schema.get_field_index("k5"))
    for i in range(batch.num_rows):
        norm = texts[i].as_py().translate(None, SPACES)
        yield i, norm, last is None or norm != last
        last = norm


_ROW = pa.schema([("pid", pa.int32()), ("run", pa.int64()), ("doc_id", pa.int64()), ("keep_id", pa.int64()),
                  ("group_size", pa.int64()), ("head", pa.bool_()), ("sha", pa.binary()), ("edge_text", pa.binary()),
                  ("last_run", pa.bool_())])
_ROW_DDL = "pid int, run long, doc_id long, keep_id long, group_size long, head boolean, sha binary, edge_text binary, last_run boolean"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its run within the partition, the run's head and its size.  Only
    ids of the current run are held.  The text of a partition's first and last
    run goes along once each, for the comparison across borders."""
    pid, run, ids, norm, out = TaskContext.get().partitionId(), -1, [], b"", []

    def close(last: bool) -> None:
        sha = hashlib.sha256(norm).digest()
        out.extend((pid, run, d, ids[0], len(ids), n == 0, sha, norm if n == 0 and (last or run == 0) else None, last)
                   for n, d in enumerate(ids))

    def flush():
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ROW.types, strict=True)], schema=_ROW)

    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("k4"))
        for i, text, fresh in _neighbours(batch, norm if run >= 0 else None):
            if fresh:
                if run >= 0:
                    close(False)
                    if len(out) >= 8192:
                        yield flush()
                run, ids, norm = run + 1, [], text
            ids.append(keys[i].as_py())
    if run >= 0:
        close(True)
        yield flush()


def _stitch(rows: DataFrame) -> DataFrame:
    """Joins runs that continue over partition borders.  The driver sees one
    record of digests and counts per partition, never texts or rows."""
    spark = rows.sparkSession
    edge = rows.filter("head and (run = 0 or last_run)").select("pid", "run", "last_run", "keep_id", "group_size", "sha")
    parts: dict[int, dict] = {}
    for r in edge.collect():
        p = parts.setdefault(r.pid, {})
        if r.run == 0:
            p["first"] = r
        if r.last_run:
            p["last"] = r
    order = sorted(parts)
    near = [(a, parts[a]["last"].run, b) for a, b in zip(order, order[1:], strict=False)
            if parts[a]["last"].sha == parts[b]["first"].sha]
    texts = rows.filter("head and edge_text is not null").select("pid", "run", "edge_text")
    pairs = spark.createDataFrame(near or [(-1, 0, -1)], "a int, run_a long, b int")
    same = {(r.a, r.b) for r in F.broadcast(pairs)
            .join(texts.select(F.col("pid").alias("a"), F.col("run").alias("run_a"), F.col("edge_text").alias("ta")), ["a", "run_a"])
            .join(texts.filter("run = 0").select(F.col("pid").alias("b"), F.col("edge_text").alias("tb")), "b")
            .filter("ta = tb").select("a", "b").collect()}
    chains: list[list[tuple]] = []
    for a, b in zip(order, order[1:], strict=False):
        if (a, b) in same:
            tail = (a, parts[a]["last"].run)
            if not chains or chains[-1][-1] != tail:
                chains.append([tail])
            chains[-1].append((b, 0))
    fixed = []
    for chain in chains:
        runs = [parts[p]["last"] if n == parts[p]["last"].run else parts[p]["first"] for p, n in chain]
        size = sum(r.group_size for r in runs)
        fixed += [(p, n, runs[0].keep_id, size, k > 0) for k, (p, n) in enumerate(chain)]
    return spark.createDataFrame(fixed or [(-1, 0, None, 0, False)], "pid int, run long, keep_all long, size_all long, continues boolean")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row kept of each group of equal texts has the most code points in its
    original text, then the smallest id."""
    rows = written(_sorted(docs, id_col, text_col, []).mapInArrow(_groups, _ROW_DDL), "content-sort")
    whole = rows.join(F.broadcast(_stitch(rows)), ["pid", "run"], "left")
    return whole.select(
        "doc_id", F.when(F.col("size_all").isNull(), F.col("keep_id")).otherwise(F.col("keep_all")).alias("keep_id"),
        F.coalesce("size_all", "group_size").alias("group_size"),
        (F.col("head") & ~F.coalesce("continues", F.lit(False))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns whole."""
    names = docs.columns
    rows = _sorted(docs, id_col, text_col, names)
    schema = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("first", T.BooleanType()),
                           T.StructField("last", T.BooleanType()), T.StructField("edge_text", T.BinaryType()),
                           T.StructField("row", rows.schema["row"].dataType, True)])

    def heads(batches):
        pid, first, tail = TaskContext.get().partitionId(), True, None
        for batch in batches:
            take, firsts, edges = [], [], []
            for i, norm, fresh in _neighbours(batch, tail):
                tail = norm
                if fresh:
                    take.append(i)
                    firsts.append(first)
                    edges.append(norm if first else None)
                    first = False
            if take:
                row = batch.column(batch.schema.get_field_index("row")).take(pa.array(take))
                n = len(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pid] * n, pa.int32()), pa.array(firsts, pa.bool_()), pa.array([False] * n, pa.bool_()),
                     pa.array(edges, pa.binary()), row], names=["pid", "first", "last", "edge_text", "row"])
            shape = batch.schema.field("row").type
        if not first:
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid], pa.int32()), pa.array([False]), pa.array([True]), pa.array([tail], pa.binary()),
                 pa.array([None], shape)], names=["pid", "first", "last", "edge_text", "row"])

    kept = written(rows.mapInArrow(heads, schema), "content-sort-rows")
    spark = docs.sparkSession
    marks = kept.filter("first or last").select("pid", "first", F.sha2("edge_text", 256).alias("sha"))
    at: dict[int, dict] = {}
    for r in marks.collect():
        at.setdefault(r.pid, {})["first" if r.first else "last"] = r.sha
    order = sorted(at)
    near = [(a, b) for a, b in zip(order, order[1:], strict=False) if at[a]["last"] == at[b]["first"]]
    same = (F.broadcast(spark.createDataFrame(near or [(-1, -1)], "a int, b int"))
            .join(kept.filter("last").select(F.col("pid").alias("a"), F.col("edge_text").alias("ta")), "a")
            .join(kept.filter("first").select(F.col("pid").alias("b"), F.col("edge_text").alias("tb")), "b")
            .filter("ta = tb").select(F.col("b").alias("pid"), F.lit(True).alias("first")))
    stay = kept.filter(~F.col("last")).join(F.broadcast(same), ["pid", "first"], "left_anti")
    return stay.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
