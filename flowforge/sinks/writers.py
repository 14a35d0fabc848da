"""Sinks (K1-K5).

Every sink is a distributed DataFrame write: partitioned directories, no
single-file funnel, overwrite limited to the partitions being written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import DETAIL_COLUMNS


OPEN_FILES = 4
_OPEN = "spark.sql.maxConcurrentOutputFileWriters"


def write_labelled(df: DataFrame, path: str,
                   partition_cols: Sequence[str] = ("extractor", "day", "attack"),
                   fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K1: labelled flows, one directory per (extractor, day, attack).

    No shuffle before the write: every task writes the partitions its rows
    belong to (flow files map to one partition each, so tasks open few
    files), and a hot attack is written by as many tasks as read it instead
    of being funnelled into one.  Only the partitions present are replaced.
    A task keeps the files of up to ``OPEN_FILES`` partitions open, so that it
    sorts its rows by partition only where it meets more.
    """
    cols = [c for c in partition_cols if c in df.columns]
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if cols:
        writer = writer.partitionBy(*cols)
    if fmt == "csv":
        writer = writer.option("header", "true")
    conf = df.sparkSession.conf
    before = conf.get(_OPEN)
    conf.set(_OPEN, str(max(int(before), OPEN_FILES)))
    try:
        writer.format(fmt).save(path)
    finally:
        conf.set(_OPEN, before)


def write_run_logs(runs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: one JSON object per run (attack, tool, total_packets,
    time_seconds, pps, monitor_file), partitioned by tool."""
    cols = ["attack", "tool", "total_packets", "time_seconds", "pps", "monitor_file"]
    runs.select(*cols).write.mode(mode).partitionBy("tool").json(path)


def detail_table(detail: DataFrame) -> DataFrame:
    """Report column names of the detail table, ordered by (extractor, attack)."""
    named = detail.select(
        F.col("extractor").alias("Extractor"), F.col("attack").alias("Attack"),
        F.col("packets").alias("Packets"), F.col("time_s").alias("Time (s)"),
        F.col("pps").alias("Throughput (PPS)"), F.col("avg_cpu").alias("Avg CPU (%)"),
        F.col("std_cpu").alias("Std CPU"), F.col("var_cpu").alias("Var CPU"),
        F.col("max_ram").alias("Max RAM (MB)"), F.col("std_ram").alias("Std RAM"),
        F.col("var_ram").alias("Var RAM"))
    return named.select(*DETAIL_COLUMNS).orderBy("Extractor", "Attack")


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """K3: a CSV report with header; an empty subset writes nothing.  An ordered
    report is written in as many part files as its sort has partitions; their
    names keep the order."""
    if df.isEmpty():
        return False
    df.write.mode(mode).option("header", "true").csv(path)
    return True


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4: model metrics rounded to six decimals."""
    out = metrics.select(
        "Extractor", "Attack",
        *[F.round(F.col(c), 6).alias(c) for c in ("F1-Score", "Precision", "Recall")])
    out.coalesce(1).write.mode(mode).option("header", "true").csv(path)


def write_consolidated(df: DataFrame, path: str, attack_col: str = "attack",
                       mode: str = "overwrite") -> None:
    """K5: consolidated flow table, one partition directory per attack."""
    write_labelled(df, path, partition_cols=[attack_col], fmt="csv", mode=mode)
