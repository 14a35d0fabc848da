"""Running per-run resource summary (A1) over arriving sample files.

Sample files (``monitor_*.csv``) that appear under a folder feed a stateful
streaming aggregation keyed by the sample file: max CPU and RAM and exact
fixed-point sums for the means (integer units, so the result does not depend
on how samples are split across micro-batches).  Each micro-batch replaces
the summary table with the complete current state (idempotent overwrite via
``foreachBatch``), which makes a restarted query converge to the same table.
State and progress live under the shared checkpoint folder unless given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.schema import SAMPLE_SCHEMA
from ..operators.stats import fixed_units
from ..session import scratch_path


def sample_stream(spark: SparkSession, root: str) -> DataFrame:
    """Rows of every sample file arriving under ``root``, keyed by file."""
    s = (spark.readStream.schema(SAMPLE_SCHEMA).option("header", "true")
         .option("recursiveFileLookup", "true").option("pathGlobFilter", "monitor_*.csv")
         .csv(root))
    return s.select("*", F.col("_metadata.file_path").alias("monitor_key"))


def running_summary(stream: DataFrame, decimals: int = 2) -> DataFrame:
    """Streaming A1: max and (exact) mean of CPU and RAM per sample file."""
    def units(c):
        return fixed_units(F.nanvl(F.col(c), F.lit(None).cast("double")), decimals)

    agg = stream.groupBy("monitor_key").agg(
        F.max(F.nanvl(F.col("cpu_percent"), F.lit(None).cast("double"))).alias("max_cpu"),
        F.max(F.nanvl(F.col("ram_mb"), F.lit(None).cast("double"))).alias("max_ram"),
        F.sum(units("cpu_percent")).alias("_cs"), F.count(units("cpu_percent")).alias("_cn"),
        F.sum(units("ram_mb")).alias("_rs"), F.count(units("ram_mb")).alias("_rn"),
        F.count(F.lit(1)).alias("n_samples"))
    return agg


def _finish(summary: DataFrame, decimals: int = 2) -> DataFrame:
    scale = F.lit(10.0 ** decimals)

    def mean(s, n):
        return F.round(F.when(F.col(n) > 0, F.col(s).cast("double") / (F.col(n) * scale)), 2)

    return summary.select("monitor_key", "max_cpu", mean("_cs", "_cn").alias("avg_cpu"),
                          "max_ram", mean("_rs", "_rn").alias("avg_ram"), "n_samples")


def start_summary(spark: SparkSession, root: str, out: str, checkpoint: str | None = None,
                  available_now: bool = False) -> StreamingQuery:
    """Keep ``out`` (Parquet) equal to the summary of all samples seen."""

    def publish(batch: DataFrame, _epoch: int) -> None:
        _finish(batch).write.mode("overwrite").parquet(out)

    writer = (running_summary(sample_stream(spark, root)).writeStream
              .outputMode("complete")
              .option("checkpointLocation", checkpoint or scratch_path(spark, "monitor-stream"))
              .foreachBatch(publish))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
