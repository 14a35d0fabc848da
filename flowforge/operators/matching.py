"""Catalogue logic: name filters (F1-F7), the scenario grid (J2), keyword
matching of files (J3, W2), train/test pairing (J4), and unions (U1-U3).

The scenario grid is a constant (12 keywords x 3 extractors); it is built by
exploding literal arrays -- no join -- and broadcast to the theta join with
the file catalogue, which is then narrow over the catalogue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import ATTACK_KEYWORDS, EXTRACTORS, TEST_DAY, TRAIN_DAY


def exclude_names(catalogue: DataFrame, name_col: str = "file_name",
                  prefixes: Sequence[str] = ("monitor_", "benchmark_"),
                  contains: Sequence[str] = ("semlabel",),
                  exact: Sequence[str] = ()) -> DataFrame:
    """drop side files (monitor / run-log / semantic-label) by name."""
    name = F.col(name_col)
    keep = F.lit(True)
    for p in prefixes:
        keep = keep & ~name.startswith(p)
    for c in contains:
        keep = keep & ~F.lower(name).contains(c.lower())
    if exact:
        keep = keep & ~name.isin(list(exact))
    return catalogue.filter(keep)


def keyword_hit(name: Column, keyword: Column) -> Column:
    """case-insensitive containment with ``drdos_`` stripped from the
    keyword; keyword ``udp`` rejects names containing ``lag``."""
    kw = F.regexp_replace(F.lower(keyword), "drdos_", "")
    low = F.lower(name)
    return low.contains(kw) & ~((kw == F.lit("udp")) & low.contains("lag"))


def scenario_grid(spark: SparkSession, attacks: Sequence[str] = ATTACK_KEYWORDS,
                  extractors: Sequence[str] = EXTRACTORS) -> DataFrame:
    """Every (attack, extractor) pair, keyword order kept in ``a_ord``."""
    a = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("v"))
                  for i, x in enumerate(attacks)])
    e = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("v"))
                  for i, x in enumerate(extractors)])
    return (spark.range(1).select(F.explode(a).alias("a"))
            .select("a", F.explode(e).alias("e"))
            .select(F.col("a.v").alias("attack"), F.col("e.v").alias("extractor"),
                    F.col("a.i").alias("a_ord"), F.col("e.i").alias("e_ord")))


def match_files(grid: DataFrame, catalogue: DataFrame,
                name_col: str = "file_name", path_col: str = "path",
                scope: Column | None = None) -> DataFrame:
    """J3 + W2: for every scenario, the first catalogue file (smallest path)
    whose name matches the keyword.  Unmatched scenarios keep a null path.

    ``scope`` narrows the catalogue (e.g. one day) before matching and must
    refer to catalogue columns.  The grid is a bounded constant and is
    broadcast; the nested-loop join streams the catalogue once.
    """
    cat = catalogue if scope is None else catalogue.filter(scope)
    first = _hits(grid, cat, name_col, path_col).groupBy("attack", "extractor").agg(F.min("_c_path").alias("match_path"))
    return grid.join(F.broadcast(first), ["attack", "extractor"], "left").select(
        *grid.columns, "match_path")


def _hits(grid: DataFrame, catalogue: DataFrame, name_col: str, path_col: str, *more: str) -> DataFrame:
    """``attack, extractor, _c_path, *more`` of every file that matches a
    scenario; the catalogue streams once past the broadcast grid (inner: an
    outer join could only broadcast the catalogue)."""
    cat = catalogue.select(F.col("extractor").alias("_c_ext"), F.col(name_col).alias("_c_name"),
                           F.col(path_col).alias("_c_path"), *more)
    cond = ((F.col("extractor") == F.col("_c_ext"))
            & keyword_hit(F.col("_c_name"), F.col("attack")))
    return cat.join(F.broadcast(grid.select("attack", "extractor")), cond, "inner").select(
        "attack", "extractor", "_c_path", *more)


def matches(grid: DataFrame, catalogue: DataFrame, name_col: str = "file_name", path_col: str = "path") -> DataFrame:
    """``extractor, attack, n``: how many files match each scenario."""
    return _hits(grid, catalogue, name_col, path_col).groupBy("extractor", "attack").agg(F.countDistinct("_c_path").alias("n"))


def pair_train_test(grid: DataFrame, catalogue: DataFrame,
                    day_col: str = "day", name_col: str = "file_name",
                    path_col: str = "path", train_day: str = TRAIN_DAY,
                    test_day: str = TEST_DAY,
                    anywhere_test_for: Sequence[str] = ("AL",)) -> DataFrame:
    """train = training-day file, else any file; test = test-day file,
    else (for ``anywhere_test_for`` extractors) any file.  ``strategy`` is
    ``Real`` when both exist and differ, else ``Split``; scenarios without a
    training file are dropped."""
    path, day = F.col("_c_path"), F.col("_day")
    best = (_hits(grid, catalogue.withColumn("_day", F.col(day_col)), name_col, path_col, "_day")
            .groupBy("attack", "extractor")
            .agg(F.min(F.when(day == train_day, path)).alias("_tr"), F.min(path).alias("_any"),
                 F.min(F.when(day == test_day, path)).alias("_te")))
    j = grid.join(F.broadcast(best), ["attack", "extractor"], "left")   # one row per scenario
    train = F.coalesce(F.col("_tr"), F.col("_any"))
    test = F.when(F.col("_te").isNotNull(), F.col("_te")).when(
        F.col("extractor").isin(list(anywhere_test_for)), F.col("_any"))
    out = j.select(*grid.columns, train.alias("train_path"), test.alias("test_path"))
    out = out.filter(F.col("train_path").isNotNull())
    return out.withColumn(
        "strategy",
        F.when(F.col("test_path").isNotNull() & (F.col("test_path") != F.col("train_path")),
               F.lit("Real")).otherwise(F.lit("Split")))


def union_fragments(frames: Sequence[DataFrame], strict: bool = False) -> DataFrame:
    """Union by column name; columns missing from a fragment are
    null.  ``strict`` raises when the fragments' columns or their order differ."""
    if not frames:
        raise ValueError("no fragments to union")
    if strict:
        first = list(frames[0].columns)
        for f in frames[1:]:
            if list(f.columns) != first:
                raise ValueError(f"fragment columns differ: {f.columns} vs {first}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=not strict)
    return out


def capture_directories(catalogue: DataFrame, dir_col: str = "parent_dir") -> DataFrame:
    """Distinct directories that hold at least one capture, sorted."""
    return catalogue.select(dir_col).distinct().orderBy(dir_col)


def dns_directories(catalogue: DataFrame, path_col: str = "path",
                    dir_col: str = "parent_dir", needle: str = "DNS") -> DataFrame:
    """directories holding a capture whose path contains ``needle``
    (case-sensitive); every capture of such a directory is then selected.
    The directory list is distinct (one row per directory) and semi-joined."""
    dirs = catalogue.filter(F.col(path_col).contains(needle)).select(dir_col).distinct()
    return catalogue.join(dirs, dir_col, "left_semi")
