"""The row-level labelling jobs on a stream of arriving flow files.

The original tooling labels files in chunks as they are produced; here new
CSV files dropped into a directory are labelled incrementally with a file
stream source.  The transformation is the same narrow projection as the
batch job (header binding by name, topological label), so the stream is
stateless: no watermark or state store is needed, and exactly-once output
comes from the file sink's commit log plus the checkpoint.

The checkpoint lives under the session's shared checkpoint folder unless a
location is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import clean
from ..functions.columns import canonical_dns, normalise_names, source_ip_column, topology_label
from ..functions.schema import C_META_COLUMNS, DEFAULT_ATTACKER, NA_TOKENS
from ..session import qualify, scratch_path
from ..sources.catalogue import path_meta
from ..sources.flows import CSV_OPTIONS, _string_schema, too_long


def flow_stream(spark: SparkSession, input_dir: str, raw_header: Sequence[str],
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of flow rows from CSV files that share ``raw_header``
    (all strings, P1 names, long rows dropped, ``source_file`` attached)."""
    n = len(raw_header)
    names = normalise_names(raw_header)
    reader = (spark.readStream.schema(_string_schema(n)).options(**CSV_OPTIONS)
              .option("header", "true").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.csv"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.csv(input_dir)
    df = df.select("*", F.col("_metadata.file_path").alias("source_file"))
    df = df.filter(~too_long(n))
    return df.select(*[F.col(f"_c{i}").alias(names[i]) for i in range(n)], "source_file")


def label_stream(stream: DataFrame, root: str,
                 attackers: str | Sequence[str] = DEFAULT_ATTACKER,
                 style: str = "A") -> DataFrame:
    """B3 / B5 row logic on a stream (same expressions as the batch job)."""
    spark = stream.sparkSession
    meta = path_meta(F.col("source_file"), qualify(spark, root))
    df = stream.select("*", *[meta[k].alias(k) for k in ("extractor", "day", "attack")])
    src = source_ip_column(df.columns)
    if src is None:
        raise ValueError("stream has no source-address column")
    if style == "C":
        data = [c for c in df.columns if c not in ("source_file", "extractor", "day", "attack")]
        df = clean.null_tokens(df, NA_TOKENS, data)
        df = clean.scrub(df, columns=data)
        keep = set(C_META_COLUMNS) | {"source_file", "extractor", "day", "attack"}
        df = clean.coerce_numeric(df, keep=[c for c in df.columns if c in keep])
        if "label" in df.columns:
            df = df.withColumnRenamed("label", "_extractor_label")
        df = df.withColumn("attack", canonical_dns(F.col("attack")))
    att = [attackers] if isinstance(attackers, str) else list(attackers)
    return df.withColumn("label", topology_label(F.col(src), att, F.col("attack")))


def start_labelling(spark: SparkSession, input_dir: str, raw_header: Sequence[str],
                    out: str, attackers: str | Sequence[str] = DEFAULT_ATTACKER,
                    style: str = "A", checkpoint: str | None = None,
                    available_now: bool = False) -> StreamingQuery:
    """Run the labelling stream into partitioned Parquet (K1 layout)."""
    labelled = label_stream(flow_stream(spark, input_dir, raw_header), input_dir,
                            attackers, style)
    writer = (labelled.writeStream.format("parquet")
              .option("path", out)
              .option("checkpointLocation", checkpoint or scratch_path(spark, "label-stream"))
              .partitionBy("extractor", "day", "attack")
              .outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
