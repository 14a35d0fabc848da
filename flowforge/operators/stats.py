"""Report aggregates (A1-A6, A12-A15), the run/sample join (J1), the
collapse view (J5) and run-quality gates (F11, F12).

Samples are always aggregated *below* the join: the join then sees one row
per monitor file, and the big side never shuffles on a skewed key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mb_to_gb, to_millions, zero_round
from ..functions.schema import LOG_ALERT_PHRASES, SUCCESS_RATIO


def _finite(c: Column) -> Column:
    """NaN and infinity poison max and avg: such samples count as missing."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def fixed_units(x: Column, decimals: int) -> Column:
    """Fixed-point value in integer units of ``10^-decimals`` (nearest;
    plain double arithmetic, no per-value decimal object)."""
    return F.floor(x * F.lit(10.0 ** decimals) + F.lit(0.5)).cast("bigint")


def _moment_sums(x: Column, name: str) -> list[Column]:
    """Aggregates of one metric: count, exact sums of hundredths and of their
    squares (decimals: no overflow at any number of rows), how many samples
    are finer than hundredths, and the floating-point moments for those."""
    u = fixed_units(x, 2)
    d = u.cast("decimal(19,0)")
    return [F.count(x).alias(f"_{name}_n"), F.try_sum(d).cast("decimal(38,0)").alias(f"_{name}_s1"),
            F.try_sum(d * d).cast("decimal(38,0)").alias(f"_{name}_s2"),
            F.count_if(u.cast("double") / F.lit(100.0) != x).alias(f"_{name}_finer"),
            F.avg(x).alias(f"_{name}_avg"), F.var_samp(x).alias(f"_{name}_var")]


def _mean_var(name: str) -> tuple[Column, Column]:
    """Mean and sample variance.  Samples written with two decimals, as the
    sampler does, give exactly rounded results on any partitioning (a float
    ``var_samp`` changes with the merge order, which moves values that sit on a
    rounding tie); finer samples use the floating-point aggregates."""
    n, s1, s2 = (F.col(f"_{name}_{p}") for p in ("n", "s1", "s2"))
    exact_mean = F.when(n > 0, s1.cast("double") / (n.cast("double") * F.lit(100.0)))
    spread = F.try_subtract(F.try_multiply(n.cast("decimal(19,0)"), s2), F.try_multiply(s1, s1))
    exact_var = F.when(n > 1, spread.cast("double") / (n.cast("double") * (n - 1).cast("double")) / F.lit(10000.0))
    plain = F.col(f"_{name}_finer") == 0
    mean = F.coalesce(F.when(plain, exact_mean), F.col(f"_{name}_avg"))
    return mean, F.coalesce(F.when(plain, exact_var), F.col(f"_{name}_var"))


def sample_summary(samples: DataFrame, key: str = "monitor_file",
                   cpu: str = "cpu_percent", ram: str = "ram_mb") -> DataFrame:
    """A1: max and mean CPU and RAM per run (means printed at 2 dp); a run
    without samples has no row."""
    agg = samples.select(key, _finite(F.col(cpu)).alias("_c"), _finite(F.col(ram)).alias("_r")).groupBy(key).agg(
        F.max("_c").alias("max_cpu"), F.max("_r").alias("max_ram"), F.count(F.lit(1)).alias("n_samples"),
        *_moment_sums(F.col("_c"), "c"), *_moment_sums(F.col("_r"), "r"))
    return agg.select(key, "max_cpu", F.round(_mean_var("c")[0], 2).alias("avg_cpu"),
                      "max_ram", F.round(_mean_var("r")[0], 2).alias("avg_ram"), "n_samples")


def sample_stats(samples: DataFrame, key: str = "monitor_file",
                 cpu: str = "cpu_percent", ram: str = "ram_mb") -> DataFrame:
    """A2: per-run max RAM, mean CPU, sample std/var (ddof 1) of CPU and RAM.
    One sample gives a null std/var, zeroed later by the report rounding."""
    agg = samples.select(key, _finite(F.col(cpu)).alias("_c"), _finite(F.col(ram)).alias("_r")).groupBy(key).agg(
        F.max("_r").alias("max_ram"), F.count(F.lit(1)).alias("n_samples"),
        *_moment_sums(F.col("_c"), "c"), *_moment_sums(F.col("_r"), "r"))
    (c_mean, c_var), (_, r_var) = _mean_var("c"), _mean_var("r")
    return agg.select(key, "max_ram", c_mean.alias("avg_cpu"),
                      F.sqrt(c_var).alias("std_cpu"), c_var.alias("var_cpu"),
                      F.sqrt(r_var).alias("std_ram"), r_var.alias("var_ram"),
                      "n_samples")


def run_throughput(packets: Column, seconds: Column) -> Column:
    """A4 for one run: packets / elapsed, 0 when elapsed is not positive."""
    return F.when(seconds > 0, packets / seconds).otherwise(F.lit(0.0))


METRIC_COLUMNS = ["avg_cpu", "std_cpu", "var_cpu", "max_ram", "std_ram", "var_ram"]


def run_detail(runs: DataFrame, stats: DataFrame, run_key: str = "monitor_file",
               stats_key: str = "monitor_file",
               keep: Sequence[str] = ()) -> DataFrame:
    """J1 + P14: every run with its sample statistics; a run whose sample file
    is missing or empty gets zeros.  ``runs`` carries ``extractor``,
    ``attack``, ``total_packets``, ``time_seconds``, ``pps``."""
    s = stats.select(F.col(stats_key).alias("_skey"), *METRIC_COLUMNS,
                     "n_samples")
    j = runs.join(s, F.col(run_key) == F.col("_skey"), "left")
    return j.select(
        *keep,
        F.col("extractor"), F.col("attack"),
        F.coalesce(F.col("total_packets"), F.lit(0)).cast("bigint").alias("packets"),
        zero_round(F.col("time_seconds")).alias("time_s"),
        zero_round(F.col("pps")).alias("pps"),
        *[zero_round(F.col(m)).alias(m) for m in METRIC_COLUMNS],
        F.coalesce(F.col("n_samples"), F.lit(0)).alias("n_samples"),
    )


def extractor_rollup(detail: DataFrame, weighted: bool = False) -> DataFrame:
    """A3 + A4: per extractor, summed packets and time, mean of the per-run
    means/std/var (unweighted unless ``weighted``), max of max RAM, and
    throughput as total packets over total time (null when time is 0).

    The inputs are 4-dp report values, so sums and means are taken over
    exact integer units of 10^-4 (a float sum of many large values moves the
    4th decimal with the summation order)."""
    def exact_sum(c):
        # report values carry 4 decimals: sum them as integers of 10^-4
        return F.sum(fixed_units(F.col(c), 4).cast("decimal(38,0)")).cast("double") / F.lit(1e4)

    if weighted:
        w = F.col("n_samples").cast("double")

        def mean(c):
            return F.try_divide(F.sum(F.col(c) * w), F.sum(w))
    else:
        def mean(c):
            return F.try_divide(
                F.sum(fixed_units(F.col(c), 4).cast("decimal(38,0)")).cast("double"),
                F.count(c).cast("double") * F.lit(1e4))
    agg = detail.groupBy("extractor").agg(
        F.sum("packets").cast("bigint").alias("total_packets"),
        exact_sum("time_s").alias("_time"),
        mean("avg_cpu").alias("avg_cpu"), mean("std_cpu").alias("std_cpu"),
        mean("var_cpu").alias("var_cpu"), F.max("max_ram").alias("max_ram"),
        mean("std_ram").alias("std_ram"), mean("var_ram").alias("var_ram"))
    return agg.select(
        "extractor", "total_packets",
        F.round(F.col("_time"), 4).alias("time_s"),
        F.round(F.try_divide(F.col("total_packets").cast("double"), F.col("_time")), 4)
        .alias("pps"),
        *[F.round(F.col(m), 4).alias(m) for m in METRIC_COLUMNS])


def flow_counts(flows: DataFrame, keyword: str, file_col: str = "file_name",
                key: str = "extractor") -> DataFrame:
    """Parsed flow rows per extractor over every file whose name
    contains ``keyword`` (case-insensitive), all days together."""
    hit = F.lower(F.col(file_col)).contains(keyword.lower())
    return (flows.filter(hit).groupBy(key)
            .agg(F.count(F.lit(1)).alias("flows")))


def subset_contains(df: DataFrame, column: str, needle: str) -> DataFrame:
    """rows whose ``column`` contains ``needle`` ignoring case; null -> out."""
    return df.filter(F.coalesce(F.lower(F.col(column)).contains(needle.lower()),
                                F.lit(False)))


def collapse_view(flow_counts_df: DataFrame, detail: DataFrame,
                  packet_totals_df: DataFrame | None, extractors: Sequence[str],
                  keyword: str = "Syn") -> DataFrame:
    """J5 + A12 + A13 + P16: per extractor, flows (millions), peak RAM over
    days (GB) and the scenario's packet total (millions; from the captures
    when given, else summed from the detail table)."""
    ext = detail.sparkSession.createDataFrame([(e,) for e in extractors], "extractor string")
    sub = subset_contains(detail, "attack", keyword)
    peak = sub.groupBy("extractor").agg(F.max("max_ram").alias("_peak"))
    out = (ext.join(flow_counts_df, "extractor", "left")
           .join(peak, "extractor", "left"))
    # Two scalar totals (one aggregate row each): captures first, detail table
    # as the fallback; no placeholder constants when both are missing.
    total = sub.agg(F.sum("packets").alias("_total"))
    if packet_totals_df is not None:
        cap = packet_totals_df.agg(F.sum("total_packets").alias("_cap"))
        total = total.crossJoin(F.broadcast(cap)).select(  # one row each
            F.coalesce(F.nullif("_cap", F.lit(0)), "_total").alias("_total"))
    out = out.crossJoin(F.broadcast(total))
    return out.select(
        "extractor",
        to_millions(F.coalesce(F.col("flows"), F.lit(0))).alias("flows_m"),
        F.coalesce(mb_to_gb(F.col("_peak")), F.lit(0.0)).alias("peak_ram_gb"),
        (F.col("_total").cast("double") / F.lit(1e6)).alias("packets_m"))


def success_gate(status: DataFrame, key: str, ok: str,
                 ratio: float = SUCCESS_RATIO) -> DataFrame:
    """A15 + F11: per run, succeeded and total chunks; runs below ``ratio``
    are withheld.  Returns the passing runs with their counts."""
    agg = status.groupBy(key).agg(
        F.count_if(F.col(ok)).alias("ok_chunks"),
        F.count(F.lit(1)).alias("chunks"))
    return agg.filter(F.col("ok_chunks") >= F.lit(ratio) * F.col("chunks"))


# A line that is not only whitespace (space, tab, line breaks, form feed,
# vertical tab), as a stripped log is non-empty.
NON_BLANK = "[^ \\t\\n\\r\\f\\x0B]"


def log_triage(lines: DataFrame, key: str = "file", text: str = "value",
               phrases: Sequence[str] = LOG_ALERT_PHRASES) -> DataFrame:
    """per log file, ``alert`` when any line holds a truncation phrase,
    ``warning`` when the log is merely non-empty, else ``clean``."""
    alert = None
    for p in phrases:
        hit = F.col(text).contains(p)
        alert = hit if alert is None else (alert | hit)
    agg = lines.groupBy(key).agg(
        F.max(F.coalesce(alert, F.lit(False)).cast("int")).alias("_alert"),
        F.max(F.coalesce(F.col(text), F.lit("")).rlike(NON_BLANK).cast("int"))
        .alias("_nonempty"))
    return agg.select(
        key,
        F.when(F.col("_alert") == 1, F.lit("alert"))
        .when(F.col("_nonempty") == 1, F.lit("warning"))
        .otherwise(F.lit("clean")).alias("severity"))
