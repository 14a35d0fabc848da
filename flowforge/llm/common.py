"""Helpers shared by the operators: reading text columns, bounded caches,
vocabulary files and written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.session import ensure_checkpoint_dir, scratch_path, ship_package

#: The characters of ``[\x20\x09-\x0D]``, which separate words.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]"


def prepare(spark: SparkSession) -> None:
    """Register the shared folder and make this package importable in tasks."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: cuts
    the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: Column) -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(column.cast("binary"), F.lit(b""))


def hashed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (UTF-8), h (the text's hash) of all rows with an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text")).filter("doc_id is not null")
    return rows.withColumn("h", F.xxhash64("text"))


def chosen_texts(rows: DataFrame, name: str) -> DataFrame:
    """doc_id, low: of ids with several texts the least hash, whose text counts."""
    return written(rows.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high").select("doc_id", "low"), name)


def one_text_per_id(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text: ``rows`` without other texts of an id than the chosen one."""
    return rows.join(chosen, "doc_id", "left").filter("low is null or low = h").select("doc_id", "text")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 2048) -> Iterator[tuple]:
    """Slices of at most ``rows`` rows, as one Python list per column."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)


class BoundedCache(dict):
    """A memo of ``make(key)`` that starts afresh when ``limit`` entries are
    held, so a task's memory does not grow with the number of distinct keys."""

    def __init__(self, make, limit: int = 400_000, always: dict | None = None):
        super().__init__(always or {})
        self.make, self.limit, self.always = make, limit, always or {}

    def __missing__(self, key):
        if len(self) >= self.limit + len(self.always):
            self.clear()
            self.update(self.always)
        value = self[key] = self.make(key)
        return value


class RecentCache(dict):
    """A memo of ``make(key)`` that holds at most twice ``limit`` entries.  When
    ``limit`` are reached, they become the older half; what is asked for again
    is taken from there, so frequent keys are not made anew."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


#: 64-bit hashes of recent words, one memo per Python worker for all operators.
WORD_HASHES = BoundedCache(xxhash.xxh64_intdigest, limit=150_000)

#: Tables built from a vocabulary, kept by Python workers between tasks.
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make):
    """``make()``, built once per Python worker for ``key``."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Gives back what this Python worker keeps, for tasks that follow those
    which need it."""
    _KEPT.clear()


def vocabulary_file(spark: SparkSession, path: str):
    """A broadcast of the text of a vocabulary file (a few MB whatever the
    corpus), read on the driver."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
