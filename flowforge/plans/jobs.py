"""End-to-end jobs (B1-B12) composed from sources, operators and sinks.

Each job returns DataFrames (lazy) and writes only when given an output
path.  Driver-side loops are over bounded metadata only: header groups (one
per distinct header line) and the scenario grid (12 x 3).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.columns import (align, binary_target, canonical_dns, feature_columns,
                                 label_column, normalise_names, q, scenario_name, source_ip_column,
                                 topology_label)
from ..functions.schema import (ATTACK_KEYWORDS, B_SOURCE_POSITION, C_META_COLUMNS,
                                DEFAULT_ATTACKER, EXTRACTORS, F1_VIEW_TARGETS,
                                HEAD_TO_HEAD, MASTER_HEADER, NA_TOKENS, PACKET_BATCH)
from ..operators import encoding, matching, model, ranking, sampling, scoring, stats
from ..session import cut_lineage, qualify
from ..sinks import writers
from ..sources import pcap
from ..sources.catalogue import catalogue, file_path, parse_header, read_first_line
from ..sources.flows import (attach_path_meta, header_groups, read_header_csv,
                             read_positional_flows)
from ..sources.runs import REJECTS_SCHEMA, read_runs, read_samples, rejected_runs, scan_logs

ROW_META = ["source_file", "extractor", "day", "attack", "file_name"]


# --- B1 capture inventory ------------------------------------------------------

def capture_inventory(spark: SparkSession, root: str,
                      split_bytes: int = pcap.SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """B1: per-file packet counts (with status) and packets per attack
    (P5 name of the capture directory).  Unreadable files count 0.  Files
    beyond ``split_bytes`` are read by several tasks."""
    files = pcap.read_capture_files(spark, root, split_bytes=split_bytes)
    per_attack = (files.groupBy("attack")
                  .agg(F.sum(F.when(F.col("status") == "ok", F.col("packets"))
                             .otherwise(0)).cast("bigint").alias("total_packets"),
                       F.count(F.lit(1)).alias("files"),
                       F.count_if(F.col("status") != "ok").alias("failed_files")))
    return files, per_attack


def run_logs(per_attack: DataFrame, timings: DataFrame) -> DataFrame:
    """K2's rows: packet totals of the inventory joined to the measured runs
    (``attack, tool, time_seconds, monitor_file``), throughput by A4; a run
    without captures has no packets, and failed files are carried along."""
    totals = per_attack.select(F.col("attack").alias("_attack"), "total_packets", "failed_files")
    joined = timings.join(totals, F.col("attack") == F.col("_attack"), "left")
    packets = F.coalesce("total_packets", F.lit(0)).cast("bigint")
    return joined.select("attack", "tool", packets.alias("total_packets"), "time_seconds",
                         stats.run_throughput(packets, F.col("time_seconds")).alias("pps"), "monitor_file",
                         F.coalesce("failed_files", F.lit(0)).alias("failed_files"))


def packet_batches(spark: SparkSession, root: str, batch_rows: int = PACKET_BATCH,
                   split_bytes: int = pcap.SPLIT_BYTES) -> DataFrame:
    """W5 on captures: a directory's packets merged in time order
    (ts, file, ordinal) and cut into consecutive batches of ``batch_rows``."""
    from ..operators.ranking import fixed_batches
    # Parse the binary headers once: the numbering reads its input twice
    # (range bounds, checkpoint of the ranged copy).
    packets = cut_lineage(pcap.read_packets(spark, root, split_bytes=split_bytes))
    return fixed_batches(packets, ["ts_sec", "ts_frac", "file", "ordinal"], batch_rows,
                         group_cols=["directory"])


# --- B2 consolidation ------------------------------------------------------------

def consolidate_fragments(spark: SparkSession, root: str, out: str | None = None,
                          strict: bool = False, ordered: bool = False) -> DataFrame | None:
    """B2: every CSV fragment under ``root`` (side files excluded) as one
    table per attack directory; columns matched by name (U1).

    ``ordered`` adds ``_file_seq`` (the fragment's rank by path within its directory,
    from 1; W6) and ``_row_seq`` (the row's place in its fragment, from 1): sorted by
    both, an attack's rows are in the order of its fragments laid end to end,
    however the files were split.  ``strict`` raises unless all fragments have the
    same columns in the same order."""
    cat = catalogue(spark, root, exclude_prefixes=("monitor_", "benchmark_"))
    # an earlier result that lies beside its fragments is no fragment
    cat = cat.filter(F.lower("file_name") != F.lower(F.concat("attack", F.lit(".csv"))))
    frames = [read_header_csv(spark, paths, list(raw), ordered=ordered) for raw, paths in header_groups(cat)]
    if not frames:
        return None
    merged = attach_path_meta(matching.union_fragments(frames, strict=strict),
                              qualify(spark, root))
    if ordered:
        rank = F.row_number().over(Window.partitionBy("parent_dir").orderBy("path"))  # one row per file
        files = cat.select(F.col("path").alias("_path"), rank.alias("_file_seq"))
        merged = ranking.exact_row_number(merged, ["_block", "_place"], ["source_file"], out="_row_seq").drop("_block", "_place")
        merged = merged.join(files, F.col("source_file") == F.col("_path"), "left").drop("_path")
    if out:
        writers.write_consolidated(merged.drop("file_name", "day", "extractor"), out)
    return merged


# --- B3 / B4 / B5 labelling ----------------------------------------------------------

@dataclass
class LabelResult:
    flows: DataFrame | None
    skipped: list[tuple[str, str]]  # (path, reason)
    observed: list[Observation] = field(default_factory=list)  # one per scan

    def row_counts(self) -> dict[str, int]:
        """``rows`` read and ``rejected`` (more fields than their file's header or
        width), counted while the flows were written or first read; waits for that.
        No second scan."""
        found = [o.get for o in self.observed]
        return {k: sum(f[k] for f in found) for k in ("rows", "rejected")}


def _attackers(attackers: str | Sequence[str]) -> list[str]:
    return [attackers] if isinstance(attackers, str) else list(attackers)


def label_header_flows(spark: SparkSession, root: str,
                       attackers: str | Sequence[str] = DEFAULT_ATTACKER,
                       style: str = "A", out: str | None = None) -> LabelResult:
    """B3 (style ``A``) and B5 (style ``C``): header CSVs under ``root``.

    A: names normalised, label = attack directory when the source address
    is an attacker, else BENIGN (an existing label column is overwritten).
    C: additionally missing-value tokens -> null, text artefacts -> '0' in
    every column, non-metadata columns coerced to numbers (bad -> 0), DNS
    directories canonicalised, the extractor's own label kept aside.
    Files without a source-address column are skipped and reported.
    """
    att = _attackers(attackers)
    base = qualify(spark, root)
    cat = catalogue(spark, root)
    out_df, skipped, observed = None, [], []
    for raw, paths in header_groups(cat):
        if source_ip_column(normalise_names(raw)) is None:
            skipped.extend((p, "no source-address column") for p in paths)
            continue
        observed.append(Observation())
        df = read_header_csv(spark, paths, list(raw), observation=observed[-1])
        src = source_ip_column(df.columns)
        df = attach_path_meta(df, base)
        attack = F.col("attack")
        if style == "C":
            data_cols = [c for c in df.columns if c not in ROW_META]
            df = clean.null_tokens(df, NA_TOKENS, data_cols)
            df = clean.scrub(df, columns=data_cols)
            keep = set(C_META_COLUMNS) | set(ROW_META)
            numbers = [c for c in df.columns if c not in keep]
            df = clean.coerce_numeric(df, keep=[c for c in df.columns if c in keep])
            df = clean.downcast(df, numbers)
            if "label" in df.columns:
                df = df.withColumnRenamed("label", "_extractor_label")
            attack = canonical_dns(attack)
            df = df.withColumn("attack", attack)
        labelled = topology_label(F.col(src), att, F.col("attack"))
        df = df.withColumn("label", labelled)
        out_df = df if out_df is None else out_df.unionByName(df, allowMissingColumns=True)
    if out and out_df is not None:
        writers.write_labelled(out_df.drop("file_name"), out)
    return LabelResult(out_df, skipped, observed)


def label_positional_flows(spark: SparkSession, root: str,
                           attackers: str | Sequence[str] = DEFAULT_ATTACKER,
                           out: str | None = None) -> LabelResult:
    """Headerless CSVs, plain or gzip-compressed, bound to the positional
    header; the source address is position 2; the extractor's dummy label is dropped."""
    skipped: list[tuple[str, str]] = []
    observed: list[Observation] = []
    cat = catalogue(spark, root, glob="{*.csv,*.csv.gz}")
    flows = read_positional_flows(spark, cat, skipped=skipped, observed=observed)
    if flows is None:
        return LabelResult(None, skipped)
    flows = attach_path_meta(flows, qualify(spark, root))
    src = MASTER_HEADER[B_SOURCE_POSITION]
    flows = flows.withColumn("label", topology_label(F.col(src), _attackers(attackers),
                                                     F.col("attack")))
    if out:
        writers.write_labelled(flows.drop("file_name"), out)
    return LabelResult(flows, skipped, observed)


# --- B6 training-set preparation ------------------------------------------------------

@dataclass
class Prepared:
    data: DataFrame            # features (double) + target (int) + _rowkey
    features: list[str]
    categorical: list[str]
    dictionary: DataFrame | None
    kinds: dict[str, str]


def prepare_training_set(flows: DataFrame, max_train_rows: int | None = None,
                         exclude: Sequence[str] = ROW_META, seed: str = "",
                         dictionary: DataFrame | None = None,
                         kinds: dict[str, str] | None = None,
                         float32: bool = True, materialize: bool = True, keyed: bool = True) -> Prepared | None:
    """P9 label, P8 pruning, T4, T2 kinds, T7 codes, T6, T5, P10 target;
    M1 sampling to ``max_train_rows`` (never for rows that are scored).  None
    when no label column.  ``_rowkey`` is unique per row and follows from the
    rows alone, so samples, splits and forests do not depend on how the files
    were cut into partitions; rows that are only scored need none (``keyed``).

    A test set passes the training set's ``kinds`` and ``dictionary`` so
    that both are typed and encoded alike (columns unseen in training are
    numeric).  With ``materialize`` the prepared rows are checkpointed to the
    shared folder once: the class gate, the weights and the fit then read
    doubles instead of re-parsing and re-scrubbing the CSV."""
    cols = [c for c in flows.columns if c not in set(exclude)]
    target_col = label_column(cols)
    if target_col is None:
        return None
    feats = feature_columns(cols)
    df = flows.select(*[F.col(q(c)) for c in feats], F.col(q(target_col)).alias("_label"))
    unkeyed = df
    if keyed or max_train_rows:
        df = sampling.numbered_copies(df)
    if max_train_rows:
        rate = sampling.training_rate(df.count(), max_train_rows)
        df = sampling.hash_sample(df, rate, [F.col("_rowkey")], seed)
    df = clean.null_tokens(df, NA_TOKENS, feats)
    if kinds is None:
        # of all rows the kinds are the same without keys, which take a shuffle
        kinds = clean.column_kinds(df if max_train_rows else clean.null_tokens(unkeyed, NA_TOKENS, feats), feats)
    else:
        kinds = {c: kinds.get(c, "numeric") for c in feats}
    numeric = [c for c in feats if kinds[c] == "numeric"]
    categorical = [c for c in feats if kinds[c] == "categorical"]
    df = clean.cast_numeric(df, numeric)
    if categorical:
        if dictionary is None:
            dictionary = encoding.build_dictionary(df, categorical)
        df = encoding.encode_categoricals(df, categorical, dictionary=dictionary)
    exprs = []
    for c in feats:
        v = f"CAST({q(c)} AS DOUBLE)"
        if float32 and c in numeric:
            v = f"CAST(CAST({q(c)} AS FLOAT) AS DOUBLE)"
        exprs.append(f"{clean.finite_or_zero_sql(v)} AS {q(c)}")
    df = df.selectExpr(*exprs, "_label", *[c for c in df.columns if c == "_rowkey"])
    df = df.withColumn("target", binary_target(F.col("_label"))).drop("_label")
    if materialize:
        df = cut_lineage(df)
    return Prepared(df, feats, categorical, dictionary, kinds)


# --- B7 extractor benchmark ------------------------------------------------------------

def _read_one(spark: SparkSession, path: str, fmt: str = "csv",
              is_dir: bool = False) -> DataFrame | None:
    """One scenario's labelled flows: a CSV file read with its own header,
    or a whole partition directory (CSV header groups, or Parquet)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if is_dir:
        cat = catalogue(spark, path)
        out = None
        for raw, paths in header_groups(cat):
            df = read_header_csv(spark, paths, list(raw))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out
    raw = parse_header(read_first_line(path))
    return read_header_csv(spark, [path], raw) if raw else None


def _scenario(spark: SparkSession, p, fmt: str, by_dir: bool, max_train_rows: int | None,
              per_dataset: bool) -> tuple[tuple | None, tuple | None, tuple | None]:
    """(metrics row, ranking row, skipped row) of one scenario."""
    scen = (p["extractor"], p["attack"])
    train_raw = _read_one(spark, p["train_path"], fmt, by_dir)
    bound = max_train_rows if p["strategy"] == "Real" else None
    prep = prepare_training_set(train_raw, bound) if train_raw else None
    counts = sampling.class_count_map(prep.data, "target") if prep else {}
    if len(counts) < 2:
        return None, None, (*scen, "invalid training data or fewer than 2 classes")
    if p["strategy"] == "Real":
        rows = prep.data
        test_raw = _read_one(spark, p["test_path"], fmt, by_dir)
        # the test set is read once (predict + score): no materialisation
        shared = {} if per_dataset else {"dictionary": prep.dictionary, "kinds": prep.kinds}
        tprep = prepare_training_set(test_raw, materialize=False, keyed=False, **shared) if test_raw else None
        if tprep is None:
            return None, None, (*scen, "invalid test data")
        test = align(tprep.data, prep.features + ["target"])
    else:
        if min(counts.values()) < 2:
            # a stratified split cannot place a one-member class on both sides
            return None, None, (*scen, "a class has a single member")
        split = sampling.stratified_split(prep.data, "target", "_rowkey")
        rows = split.filter(~F.col("is_test"))
        rows = sampling.hash_sample(rows, sampling.training_rate(sum(counts.values()), max_train_rows),
                                    ["_rowkey"], seed="fit")
        test = split.filter(F.col("is_test"))
    train = model.laid_out(sampling.class_weights(rows, "target"), sum(counts.values()), "_rowkey")
    forest = model.fit_forest(model.assemble(train, prep.features))
    preds = model.predict(forest, model.assemble(test, prep.features))
    s = scoring.weighted_scores(scoring.confusion(preds)).first()
    top = model.top_features(model.importances(spark, forest, prep.features)).first()
    return ((p["extractor"], p["attack"], s["f1_score"], s["precision"], s["recall"], p["strategy"]),
            (p["extractor"], p["attack"], p["strategy"], top["top_features"]), None)


def extractor_benchmark(spark: SparkSession, processed_root: str,
                        attacks: Sequence[str] = ATTACK_KEYWORDS,
                        extractors: Sequence[str] = EXTRACTORS,
                        out: str | None = None, fmt: str = "csv",
                        match_on: str = "file_name",
                        max_train_rows: int | None = None,
                        per_dataset: bool = False) -> tuple[DataFrame, DataFrame, list]:
    """For every (attack, extractor) with a training file: prepare,
    gate (>= 2 classes), fit the forest, score on the other day (Real) or on
    a stratified 30 % split (Split), rank importances.

    ``match_on="file_name"`` matches keywords against file names (one file
    per scenario, as the processed tree is laid out); ``"attack"`` matches
    them against attack directories and takes the whole directory -- the
    layout the labelled-flow sink writes (``extractor=/day=/attack=/part-*``).

    ``max_train_rows`` bounds the rows that a forest is fitted on; test rows
    are all scored.  ``per_dataset`` types and encodes the test set by itself,
    as the original does; by default the training set's dictionary holds.

    Returns (metrics, feature rankings, skipped: scenarios that gave no result, and
    how many further inputs matched a scenario but were not read)."""
    cat = catalogue(spark, processed_root, glob="*.parquet" if fmt == "parquet" else "*.csv",
                    exclude_contains=("semlabel",))
    by_dir = match_on == "attack"
    if by_dir:
        cat = (cat.groupBy("extractor", "day", "attack", "parent_dir")
               .agg(F.sum("length").alias("length"))
               .select(F.col("parent_dir").alias("path"), F.col("attack").alias("file_name"),
                       "extractor", "day", "length"))
    grid = matching.scenario_grid(spark, attacks, extractors)
    pairs = matching.pair_train_test(grid, cat).orderBy("a_ord", "e_ord").collect()  # <= 36 scenario rows
    found = {(r["extractor"], r["attack"]): r["n"] for r in matching.matches(grid, cat).collect()}  # <= 36 rows
    skipped = []
    for p in pairs:
        more = found[p["extractor"], p["attack"]] - 1 - (p["strategy"] == "Real")
        if more:
            skipped.append((p["extractor"], p["attack"], f"{more} further matching inputs not read"))

    done = [_scenario(spark, p, fmt, by_dir, max_train_rows, per_dataset) for p in pairs]
    metrics = [m for m, _, _ in done if m]
    rankings = [r for _, r, _ in done if r]
    skipped += [s for _, _, s in done if s]
    mdf = spark.createDataFrame(metrics, "Extractor string, Attack string, `F1-Score` double, "
                                         "Precision double, Recall double, Strategy string")
    rdf = spark.createDataFrame(rankings, "Extractor string, Attack string, Strategy string, "
                                          "top_features string")
    if out:
        writers.write_metrics(mdf, out)
    return mdf, rdf, skipped


# --- B8 / B9 reports ----------------------------------------------------------------------

def run_report(spark: SparkSession, interim_root: str, base_dir: str | None = None,
               samples_root: str | None = None, out: str | None = None) -> dict[str, DataFrame]:
    """Per-run detail (ordered by extractor, attack) and its DNS, Syn and
    Syn head-to-head subsets.  Empty subsets are not written.
    ``rejected_inputs`` (path, reason) lists the logs and sample files that are in
    none of them.  The folder is listed twice (logs; files by name), and the detail (one row per run) and the
    rejected inputs are written once: every view reads those."""
    logs = scan_logs(spark, interim_root)
    runs = read_runs(spark, interim_root, base_dir, logs=logs)
    skipped: list[tuple[str, str]] = []
    files = catalogue(spark, interim_root, glob="{benchmark_*.json,monitor_*.csv}", exclude_prefixes=())
    log_files, sample_files = (files.filter(F.col("file_name").endswith(end)) for end in (".json", ".csv"))
    samples = read_samples(spark, samples_root or interim_root, skipped, None if samples_root else sample_files)
    st = stats.sample_stats(samples, key="monitor_key")
    detail = stats.run_detail(runs, st, run_key="monitor_key", stats_key="monitor_key")
    detail = cut_lineage(detail).orderBy("extractor", "attack")
    dns = stats.subset_contains(detail, "attack", "DNS")
    syn = stats.subset_contains(detail, "attack", "Syn")
    h2h = syn.filter(F.col("extractor").isin(HEAD_TO_HEAD))
    views = {"benchmark_detailed": detail, "benchmark_dns_only": dns,
             "benchmark_syn_only": syn, "head_to_head_cic_ntl_syn": h2h}
    if out:
        for name, v in views.items():
            writers.write_report(writers.detail_table(v), f"{out}/{name}")
    rejected = cut_lineage(rejected_runs(spark, interim_root, logs=logs, files=log_files).unionByName(spark.createDataFrame(skipped, REJECTS_SCHEMA)))
    if out:
        writers.write_report(rejected.orderBy("path"), f"{out}/rejected_inputs")
    return views | {"rejected_inputs": rejected}


def extractor_report(detail: DataFrame) -> dict[str, DataFrame]:
    """Per-extractor rollup and the head-to-head pair."""
    roll = stats.extractor_rollup(detail).orderBy("extractor")
    return {"benchmark_table_geral": roll,
            "head_to_head_cic_ntl_geral": roll.filter(F.col("extractor").isin(HEAD_TO_HEAD))}


# --- B10 / B11 views ----------------------------------------------------------------------

def collapse_report(spark: SparkSession, raw_roots: dict[str, str], detail: DataFrame,
                    captures_root: str | None = None, keyword: str = "syn",
                    positional: Sequence[str] = ("NTLFlowLyzer",)) -> DataFrame:
    """Flows (parsed rows of every CSV whose name holds ``keyword``, all
    days), peak RAM and packet totals per extractor, side by side."""
    counts = []
    for tool, root in raw_roots.items():
        cat = catalogue(spark, root, exclude_contains=("semlabel",)).filter(
            F.lower(F.col("file_name")).contains(keyword.lower()))
        if tool in positional:
            flows = read_positional_flows(spark, cat)  # an unreadable width is an error
        else:
            flows = None
            for raw, paths in header_groups(cat):
                f = read_header_csv(spark, paths, list(raw)).select("source_file")
                flows = f if flows is None else flows.unionByName(f)
        n = flows.count() if flows is not None else 0
        counts.append((tool, n))
    fc = spark.createDataFrame(counts, "extractor string, flows bigint")
    packets = None
    if captures_root:
        _, per_attack = capture_inventory(spark, captures_root)
        packets = stats.subset_contains(per_attack, "attack", keyword)
    return stats.collapse_view(fc, detail, packets, list(raw_roots), keyword=keyword)


def f1_view(metrics: DataFrame, bootstrap: int = 0, seed: int = 42) -> DataFrame:
    """F6 regex filter, P15 scenario names, F7 drop, A14 mean F1 per
    (scenario, extractor); with ``bootstrap`` > 0 also a 95 % interval from
    Poisson-weighted replicates (bounded: one row per metric x replicate)."""
    pattern = "(?i)" + "|".join(F1_VIEW_TARGETS)
    m = metrics.filter(F.col("Attack").rlike(pattern))
    m = m.withColumn("Scenario", scenario_name(F.col("Attack"))).na.drop(subset=["Scenario"])
    mean = m.groupBy("Scenario", "Extractor").agg(F.avg("`F1-Score`").alias("mean_f1"),
                                                  F.count(F.lit(1)).alias("n"))
    if bootstrap <= 0:
        return mean
    # a uniform draw that depends on the row and the replicate alone
    row = F.struct(*[F.col(q(c)) for c in m.columns])
    reps = m.select("Scenario", "Extractor", F.col("`F1-Score`").alias("f1"), F.xxhash64(F.lit(seed), row).alias("row"),
                    F.explode(F.sequence(F.lit(0), F.lit(bootstrap - 1))).alias("b"))
    u = F.pmod(F.xxhash64("row", "b"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    # Poisson(1) weight by inverse CDF; the chance of more than 12 is below 1e-10.
    w, term = F.lit(13), math.exp(-1)
    levels, total = [], 0.0
    for k in range(13):
        total += term
        levels.append((k, total))
        term /= k + 1
    for k, level in reversed(levels):
        w = F.when(u < level, k).otherwise(w)
    reps = reps.withColumn("w", w)
    rep_means = reps.groupBy("Scenario", "Extractor", "b").agg(
        F.try_divide(F.sum(F.col("f1") * F.col("w")), F.sum("w")).alias("m"))
    # exact, linearly interpolated percentiles over the B replicate means of
    # each (scenario, extractor): a bounded group
    ci = rep_means.groupBy("Scenario", "Extractor").agg(
        F.percentile("m", 0.025).alias("ci_low"),
        F.percentile("m", 0.975).alias("ci_high"))
    return mean.join(ci, ["Scenario", "Extractor"], "left")


# --- B12 run quality ------------------------------------------------------------------------

def run_quality(spark: SparkSession, status: DataFrame | None, logs_root: str | None,
                run_key: str = "run", ok_col: str = "ok",
                log_glob: str = "jvm_stderr_*.log") -> dict[str, DataFrame]:
    """Success gate over chunk status rows and triage of extractor
    stderr logs (one severity per log file)."""
    out = {}
    if status is not None:
        out["passing_runs"] = stats.success_gate(status, run_key, ok_col)
    if logs_root:
        lines = (spark.read.option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", log_glob).text(logs_root)
                 .select(file_path().alias("file"), "value"))
        out["log_triage"] = stats.log_triage(lines)
    return out

