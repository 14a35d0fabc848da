"""Run logs, resource samples and report re-reads.

CSV inputs are read by the names in their own headers (one scan per distinct
header, S4), whatever the order of the columns; a file that lacks a needed column
is reported or an error, never bound by position.  A run log that is no JSON
object of the expected types is kept out of the runs and listed with its path and
reason.  The key that ties a run to its samples is the fully qualified path of the
sample file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import attack_from_log_name, infer_tool
from ..functions.schema import DETAIL_COLUMNS, METRICS_SCHEMA, RUN_LOG_SCHEMA, SAMPLE_SCHEMA
from ..session import qualify
from .catalogue import catalogue, file_path
from .flows import header_groups, read_header_csv

_BROKEN = "_broken"
REJECTS_SCHEMA = "path string, reason string"


def read_named_csv(spark: SparkSession, root: str, schema: T.StructType, glob: str = "*.csv",
                   skipped: list[tuple[str, str]] | None = None, files: DataFrame | None = None) -> DataFrame:
    """The columns of ``schema`` from every CSV under ``root``, found by name in
    each file's header, plus ``source_file``; cells that don't parse are null.
    A file without one of them goes to ``skipped`` with the reason; without that
    list it is an error.  ``files``, a catalogue of just these, spares the listing."""
    out = None
    for raw, paths in header_groups(catalogue(spark, root, glob=glob, exclude_prefixes=()) if files is None else files):
        names = [c.strip() for c in raw]
        absent = [f.name for f in schema if f.name not in names]
        if absent:
            reason = "no column " + ", ".join(absent)
            if skipped is None:
                raise ValueError(f"{paths[0]} and {len(paths) - 1} more: {reason}")
            skipped.extend((p, reason) for p in sorted(paths))
            continue
        df = read_header_csv(spark, paths, raw, names=[f"_{i}" for i in range(len(raw))])
        df = df.select(*[F.col(f"_{names.index(f.name)}").try_cast(f.dataType).alias(f.name) for f in schema], "source_file")
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("source_file", T.StringType())]))
    return out


def scan_logs(spark: SparkSession, root: str, multi_line: bool = True, glob: str = "benchmark_*.json") -> DataFrame:
    """Every record of the run logs under ``root``, broken ones too."""
    schema = T.StructType([*RUN_LOG_SCHEMA.fields, T.StructField(_BROKEN, T.StringType())])
    logs = (spark.read.schema(schema)
            .option("columnNameOfCorruptRecord", _BROKEN)
            .option("multiLine", "true" if multi_line else "false")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .json(root))
    return logs.select("*", file_path().alias("log_path"))


def _judged(condition: Column) -> Column:
    # asks for every column, whatever is selected later: Spark judges a record
    # against the columns it parses
    return condition & (F.length(F.to_json(F.struct(*[f.name for f in RUN_LOG_SCHEMA]))) > 0)


def read_runs(spark: SparkSession, root: str, base_dir: str | None = None,
              multi_line: bool = True, glob: str = "benchmark_*.json", logs: DataFrame | None = None) -> DataFrame:
    """S5 + P12 + P13: every ``benchmark_*.json`` under ``root`` that is a JSON
    object of the expected types (see ``rejected_runs`` for the others).

    Missing keys are null, then defaulted: tool from the log path, attack
    from the log's file name.  ``monitor_key`` is the sample file's
    qualified path; relative ``monitor_file`` values are resolved against
    ``base_dir`` (default: the current directory, as the logs were written).
    ``multi_line`` reads one pretty-printed object per file; ``False`` reads
    JSON lines (as the run-log sink writes them).  ``logs``, from ``scan_logs``
    of the same folder, spares listing it again.
    """
    base = qualify(spark, base_dir or ".")
    logs = scan_logs(spark, root, multi_line, glob) if logs is None else logs
    logs = logs.filter(_judged(F.col(_BROKEN).isNull()))
    mf = F.col("monitor_file")
    absolute = mf.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") | mf.startswith("/")
    local_abs = F.concat(F.lit(base.split(":", 1)[0] + ":"), mf)
    relative = F.concat(F.lit(base + "/"), F.regexp_replace(mf, r"^(\./)+", ""))
    key = (F.when(mf.isNull(), F.lit(None).cast("string"))
           .when(mf.startswith("/"), local_abs)
           .when(absolute, mf)
           .otherwise(relative))
    return logs.select(
        infer_tool(F.col("tool"), F.col("log_path")).alias("extractor"),
        attack_from_log_name(F.col("attack"), F.col("log_path")).alias("attack"),
        "total_packets", "time_seconds", "pps", "monitor_file",
        key.alias("monitor_key"), "log_path")


def rejected_runs(spark: SparkSession, root: str, multi_line: bool = True,
                  glob: str = "benchmark_*.json", logs: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """``path, reason`` of run logs that ``read_runs`` keeps out: text that is no
    JSON object of the expected types (one row per record), and files of white
    space only.  ``logs`` as in ``read_runs``, ``files`` a catalogue of just these."""
    logs = scan_logs(spark, root, multi_line, glob) if logs is None else logs
    broken = logs.filter(_judged(F.col(_BROKEN).isNotNull())).select(
        F.col("log_path").alias("path"),
        F.concat(F.lit("not a run log: "), F.substring(F.regexp_replace(_BROKEN, r"\s+", " "), 1, 60)).alias("reason"))
    seen = logs.select(F.col("log_path").alias("path"), "attack").select("path").distinct()
    files = catalogue(spark, root, glob=glob, exclude_prefixes=()) if files is None else files
    blank = (files.select("path").join(seen, "path", "left_anti")
             .withColumn("reason", F.lit("no JSON object")))
    return broken.unionByName(blank)


def read_samples(spark: SparkSession, root: str, skipped: list[tuple[str, str]] | None = None,
                 files: DataFrame | None = None) -> DataFrame:
    """Every ``monitor_*.csv`` under ``root``, columns by name, keyed by the
    file's qualified path.  A header-only or missing file has no rows."""
    samples = read_named_csv(spark, root, SAMPLE_SCHEMA, "monitor_*.csv", skipped, files)
    return samples.withColumnRenamed("source_file", "monitor_key")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics table written by the model benchmark."""
    return read_named_csv(spark, path, METRICS_SCHEMA).drop("source_file")


# The detail table's columns under the names that the jobs use.
_DETAIL_NAMES = ["extractor", "attack", "packets", "time_s", "pps", "avg_cpu", "std_cpu", "var_cpu",
                 "max_ram", "std_ram", "var_ram"]
_DETAIL_TYPES = {"extractor": T.StringType(), "attack": T.StringType(), "packets": T.LongType()}


def read_detail(spark: SparkSession, path: str) -> DataFrame:
    """The per-run detail table written by the report job."""
    schema = T.StructType([T.StructField(c, _DETAIL_TYPES.get(n, T.DoubleType()))
                           for c, n in zip(DETAIL_COLUMNS, _DETAIL_NAMES, strict=True)])
    d = read_named_csv(spark, path, schema)
    return d.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(DETAIL_COLUMNS, _DETAIL_NAMES, strict=True)])
