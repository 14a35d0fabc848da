"""The corpus pipeline: five operators of ``flowforge.llm`` one after another.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet under the shared folder and reads it back as the next
one's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.llm import content_sort, near_dups, packing, substring_dedup, toxicity
from flowforge.llm.common import prepare
from flowforge.llm.queries import tokenizer_path
from flowforge.session import remove_folder, scratch_path, scratch_scope, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go."""
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal normalised text stays."""
    prepare(spark)
    return content_sort.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (shingles of five
    words, similarity of 0.8 or more)."""
    prepare(spark)
    gone = (near_dups.near_duplicates(docs, words=5, num=80, den=100).filter(~F.col("kept"))
            .select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out;
    n_chars follows the text.  A document that loses nothing stays as it is."""
    prepare(spark)
    cut = substring_dedup.drop_repeats(docs)
    if "n_chars" not in cut.columns:
        return cut
    return cut.withColumn("n_chars", F.char_length("text").cast(cut.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    prepare(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: The classifier and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote is deleted when the next one is written."""
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            result = stage(spark, docs, sf_dir)
            schema = result.schema
            result.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
