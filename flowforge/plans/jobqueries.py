"""Registered queries that call the jobs (B2, B6, B9, B11) and whole operators
on files or frames made from the driver tables, each with its own SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import topology_label_join
from ..operators import matching, model, sampling
from ..session import scratch_path, scratch_scope, table
from ..sources.catalogue import catalogue
from ..sources.flows import read_header_flows, rejected_rows
from ..sources.runs import read_detail
from . import jobs, support
from .standins import _EVENT_ATTACK_SQL, _EVENT_EXTRACTOR_SQL, _ROLLUP_SQL, detail_frame

_TOOL_OF = {"F": "CICFlowMeter", "O": "NTLFlowLyzer", "P": "ALFlowLyzer"}


def q_extractor_report(spark: SparkSession, sf: str) -> DataFrame:
    """The head-to-head pair of the per-extractor rollup."""
    names = F.create_map(*[F.lit(x) for pair in _TOOL_OF.items() for x in pair])
    detail = detail_frame(spark, sf).withColumn("extractor", names[F.col("extractor")])
    return jobs.extractor_report(detail)["head_to_head_cic_ntl_geral"]


_REPORT_SQL = f"""
WITH r AS ({_ROLLUP_SQL})
SELECT CASE extractor WHEN 'F' THEN 'CICFlowMeter' WHEN 'O' THEN 'NTLFlowLyzer' END AS extractor, * EXCLUDE (extractor)
FROM r WHERE extractor IN ('F', 'O')"""


def q_f1_view(spark: SparkSession, sf: str) -> DataFrame:
    """Mean F1 per scenario and extractor, by the job itself."""
    metrics = table(spark, sf, "events").select(
        F.expr(_EVENT_ATTACK_SQL).alias("Attack"),
        F.expr(_EVENT_EXTRACTOR_SQL.replace("json_extract_string", "get_json_object")).alias("Extractor"),
        F.col("value").alias("F1-Score"))
    return jobs.f1_view(metrics).select(F.col("Scenario").alias("scenario"), F.col("Extractor").alias("extractor"),
                                        F.round("mean_f1", 6).alias("mean_f1"), "n")


def q_class_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per class, the number of classes, and whether the set
    can be trained on, for the flags of every supplier's lines."""
    li = table(spark, sf, "lineitem")
    counts = li.groupBy("l_suppkey").agg(F.countDistinct("l_linestatus").alias("classes"), F.count("*").alias("n"))
    per_class = sampling.class_counts(li, "l_linestatus").agg(F.min("n_class").alias("smallest"))
    return counts.select("l_suppkey", "classes", "n", (F.col("classes") >= 2).alias("usable")).join(F.broadcast(per_class))


_GATE_SQL = """
SELECT l_suppkey, count(DISTINCT l_linestatus) AS classes, count(*) AS n, count(DISTINCT l_linestatus) >= 2 AS usable,
       (SELECT min(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_linestatus)) AS smallest
FROM lineitem GROUP BY l_suppkey"""


def q_capture_directories(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct directories of the pages."""
    parents = table(spark, sf, "pages").select(F.regexp_extract("url", r"^(.*)/[^/]*$", 1).alias("parent_dir"))
    return matching.capture_directories(parents)


_DIRECTORIES_SQL = r"SELECT DISTINCT regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent_dir FROM pages"


def q_importance_report(spark: SparkSession, sf: str) -> DataFrame:
    """Spread over trees, names by position and the ranking of
    an importance table; part sizes are the trees, 30 features by key."""
    part = table(spark, sf, "part")
    per_tree = (part.groupBy(F.col("p_size").cast("int").alias("tree"), (F.col("p_partkey") % 30).cast("int").alias("idx"))
                .agg((F.max("p_retailprice") / 10000).alias("imp")))
    mean = per_tree.groupBy("idx").agg(F.max("imp").alias("mean_w"))
    names = spark.createDataFrame([([f"feature_{i:02d}" for i in range(30)],)], "names array<string>")
    zipped = model.zip_importances(per_tree, mean, names.select(F.posexplode("names").alias("idx", "feature")))
    return model.top_features(zipped)


_IMPORTANCE_SQL = """
WITH t AS (SELECT p_size AS tree, p_partkey % 30 AS idx, max(p_retailprice) / 10000 AS imp FROM part GROUP BY ALL),
z AS (SELECT printf('feature_%02d', CAST(idx AS INTEGER)) AS feature, max(imp) AS mean_w, stddev_pop(imp) AS std_w FROM t GROUP BY idx),
r AS (SELECT *, row_number() OVER (ORDER BY mean_w DESC, feature) AS rank FROM z)
SELECT string_agg(printf('%s (%.3f±%.3f)', feature, mean_w, std_w), ', ' ORDER BY rank) AS top_features FROM r WHERE rank <= 10"""

_RAW_CELL = """CASE l_linenumber WHEN 1 THEN 'NA' WHEN 2 THEN '' WHEN 3 THEN 'inf' WHEN 4 THEN '1e300'
    ELSE CAST(l_extendedprice AS VARCHAR) END"""
_RAW_MODE = "CASE WHEN l_linenumber = 5 THEN 'null' ELSE l_linestatus || l_returnflag END"


def q_prepare_training(spark: SparkSession, sf: str) -> DataFrame:
    """B6 (P8, P9, T2, T4-T7, P10): lines as raw flows, prepared for a forest."""
    li = table(spark, sf, "lineitem")
    flows = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("flow_id"), F.col("l_suppkey").cast("string").alias("src_ip"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("packets_count"),
        F.expr(_RAW_CELL.replace("VARCHAR", "STRING")).alias("bytes_rate"),
        F.expr(_RAW_MODE).alias("handshake_state"),
        F.when(F.col("l_returnflag") == "N", F.lit("BENIGN")).otherwise(F.col("l_returnflag")).alias("label"))
    prepared = jobs.prepare_training_set(flows)
    return prepared.data.select(F.col("packets_count").cast("bigint").alias("packets_count"), "bytes_rate",
                                F.col("handshake_state").cast("bigint").alias("handshake_state"), "target")


_PREPARE_SQL = f"""
WITH f AS (SELECT l_orderkey * 8 + l_linenumber AS p, {_RAW_CELL} AS cell, {_RAW_MODE} AS mode, l_returnflag FROM lineitem),
n AS (SELECT p, CASE WHEN cell IN ('NA', '', 'inf', '1e300') THEN 0 ELSE TRY_CAST(cell AS FLOAT) END AS bytes_rate,
             CASE WHEN mode = 'null' THEN NULL ELSE mode END AS mode, l_returnflag FROM f)
SELECT CAST(CAST(p AS FLOAT) AS BIGINT) AS packets_count, CAST(bytes_rate AS DOUBLE) AS bytes_rate,
       CAST(dense_rank() OVER (ORDER BY coalesce(mode, 'nan')) - 1 AS BIGINT) AS handshake_state,
       CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS target
FROM n"""


def q_consolidate_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments with two column orders, one table per attack; an
    earlier result beside its fragments is no fragment."""
    li = table(spark, sf, "lineitem")
    out = scratch_path(spark, "fragments")
    cols = ["l_orderkey", "l_linenumber", "l_comment"]
    base = li.select(F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_linenumber").cast("string").alias("l_linenumber"),
                     F.concat_ws(" ", "l_linestatus", "l_returnflag").alias("l_comment"),
                     F.concat(F.lit("DrDoS_"), F.col("l_returnflag")).alias("attack"), (F.col("l_linenumber") % 2).alias("odd"))
    for odd, order in ((0, cols), (1, cols[::-1])):
        (base.filter(F.col("odd") == odd).select(*order, "attack").write.partitionBy("attack")
         .option("header", "true").csv(f"{out}/tool{odd}"))
    merged = jobs.consolidate_fragments(spark, out)
    return merged.select(*cols, "attack", "extractor")


_FRAGMENTS_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       l_linestatus || ' ' || l_returnflag AS l_comment, 'DrDoS_' || l_returnflag AS attack,
       'tool' || CAST(l_linenumber % 2 AS VARCHAR) AS extractor
FROM lineitem"""

_ODD_LINE = """CASE l_linenumber % 4 WHEN 0 THEN concat_ws(',', l_orderkey, l_linenumber, l_partkey, 'extra')
    WHEN 1 THEN concat_ws(',', l_orderkey, l_linenumber) WHEN 2 THEN concat_ws(',', l_orderkey, l_linenumber, l_partkey)
    ELSE concat_ws(',', l_partkey, l_linenumber, l_orderkey) END"""


def _odd_files(spark: SparkSession, sf: str) -> str:
    """Files with a blank first line, two header orders, and rows that are too
    long, too short or blank."""
    out = scratch_path(spark, "odd files")  # with a space
    lines = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 4 == 3).alias("turned"), F.expr(_ODD_LINE).alias("value"))
    for turned, header in ((False, "a,b,c"), (True, "c,b,a")):
        def with_header(batches, header=header):
            first = True
            for pdf in batches:
                if first:
                    yield pd.DataFrame({"value": ["", header]})
                    first = False
                yield pd.DataFrame({"value": [*pdf["value"], ""]})
        lines.filter(F.col("turned") == turned).select("value").mapInPandas(with_header, "value string").write.text(f"{out}/part {turned}")
    return out


def q_tolerant_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of all headers by name; long rows go, short ones are padded."""
    flows = read_header_flows(spark, catalogue(spark, _odd_files(spark, sf), glob="*.txt"))
    return flows.select("a", "b", "c")


_TOLERANT_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS a, CAST(l_linenumber AS VARCHAR) AS b,
       CASE WHEN l_linenumber % 4 <> 1 THEN CAST(l_partkey AS VARCHAR) END AS c
FROM lineitem WHERE l_linenumber % 4 <> 0"""


def q_rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows the scans reject."""
    files = rejected_rows(spark, catalogue(spark, _odd_files(spark, sf), glob="*.txt"))
    return files.agg(F.sum("rejected").cast("bigint").alias("rejected"))


_REJECTED_SQL = "SELECT count(*) AS rejected FROM lineitem WHERE l_linenumber % 4 = 0"


def q_training_sample(spark: SparkSession, sf: str) -> DataFrame:
    """M1: the rate follows the counted rows and the caller's bound."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"))
    n = li.count()
    return sampling.hash_sample(li, sampling.training_rate(n, n // 2), ["k"])


_SAMPLE_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
n AS (SELECT count(*) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, k FROM s, n
WHERE substr(md5(k), 1, 8) < printf('%08x', CAST(floor((n // 2)::DOUBLE / n::DOUBLE * 4294967296) AS BIGINT))"""


def q_attacker_join(spark: SparkSession, sf: str) -> DataFrame:
    """P6 through a table of attackers: the even suppliers."""
    li, supplier = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    flows = li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return topology_label_join(flows, "l_suppkey", supplier.filter("s_suppkey % 2 = 0"), "s_suppkey", F.col("l_returnflag"))


_ATTACKER_SQL = """
SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag,
       CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) THEN l_returnflag ELSE 'BENIGN' END AS label
FROM lineitem"""


def q_run_log_rows(spark: SparkSession, sf: str) -> DataFrame:
    """K2 and A4: packet totals per status joined to timed runs."""
    li, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    per_attack = li.groupBy(F.col("l_linestatus").alias("attack")).agg(
        F.count("*").alias("total_packets"), F.count_if(F.col("l_linenumber") == 7).alias("failed_files"))
    timings = orders.select(F.col("o_orderstatus").alias("attack"), F.col("o_orderpriority").alias("tool"),
                            (F.col("o_custkey") % 5).cast("double").alias("time_seconds"), F.col("o_orderkey").cast("string").alias("monitor_file"))
    return jobs.run_logs(per_attack, timings)


_RUN_LOG_SQL = """
WITH t AS (SELECT l_linestatus AS a, count(*) AS n, count(*) FILTER (WHERE l_linenumber = 7) AS f FROM lineitem GROUP BY 1),
r AS (SELECT o_orderstatus AS attack, o_orderpriority AS tool, CAST(o_custkey % 5 AS DOUBLE) AS time_seconds,
             CAST(o_orderkey AS VARCHAR) AS monitor_file FROM orders)
SELECT attack, tool, CAST(coalesce(n, 0) AS BIGINT) AS total_packets, time_seconds,
       CASE WHEN time_seconds > 0 THEN coalesce(n, 0) / time_seconds ELSE 0.0::DOUBLE END AS pps, monitor_file,
       coalesce(f, 0) AS failed_files
FROM r LEFT JOIN t ON r.attack = t.a"""


#: Orders for which each (status, priority) gets one more run.
REPORT_RUN_ORDERS = 5000
_REPORT_RUNS = f"""
  SELECT o_orderkey, o_orderstatus AS status, o_custkey,
         CASE o_orderpriority WHEN '1-URGENT' THEN '01-12_DrDoS_DNS' WHEN '2-HIGH' THEN '01-12_Syn' ELSE o_orderpriority END AS attack,
         o_orderkey % (1 + CAST(floor((SELECT count(*) FROM orders) / {REPORT_RUN_ORDERS}) AS BIGINT)) AS bucket
  FROM orders"""


def _report_files(spark: SparkSession, sf: str) -> str:
    """Logs and samples of runs (status, priority, bucket).  By bucket mod 4 a log
    has no attack (0), samples have another order of columns (1) or lack one (2),
    or the log breaks off (3); status P has no tool."""
    runs = spark.sql(_REPORT_RUNS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))
    folder = F.concat(F.create_map(*[F.lit(x) for x in ("F", "CIC_RAW", "O", "NTL_RAW", "P", "AL_RAW")])[F.col("status")], F.lit("/01-12/"))
    slug = F.concat_ws("_", "attack", F.col("bucket").cast("string"))
    runs = runs.withColumns({"kind": F.col("bucket") % 4, "slug": slug, "at": F.concat(folder, slug, F.lit("/"))})
    per_run = runs.groupBy("at", "slug", "status", "attack", "kind").agg(F.sum("o_custkey").alias("packets"), F.count("*").alias("n"))
    log = F.to_json(F.struct(
        F.when(F.col("kind") != 0, F.col("attack")).alias("attack"),
        F.when(F.col("status") == "F", "CICFlowMeter").when(F.col("status") == "O", "NTLFlowLyzer").alias("tool"),
        F.col("packets").alias("total_packets"), (F.col("n") / 4.0).alias("time_seconds"), (F.col("packets") / (F.col("n") / 4.0)).alias("pps"),
        F.concat(F.lit("./"), "at", F.lit("monitor_"), "slug", F.lit(".csv")).alias("monitor_file")))
    logs = per_run.select(F.concat("at", F.lit("benchmark_"), "slug", F.lit(".json")).alias("path"), F.lit(0).cast("bigint").alias("ord"),
                          F.when(F.col("kind") == 3, F.substring(log, 1, 30)).otherwise(log).alias("line"))
    path = F.concat("at", F.lit("monitor_"), "slug", F.lit(".csv")).alias("path")

    def columns(stamp, cpu, ram):
        return (F.when(F.col("kind") == 1, F.concat_ws(",", stamp, ram, cpu)).when(F.col("kind") == 2, F.concat_ws(",", stamp, cpu))
                .otherwise(F.concat_ws(",", stamp, cpu, ram)).alias("line"))

    heads = per_run.select(path, F.lit(-1).cast("bigint").alias("ord"), columns(F.lit("timestamp"), F.lit("cpu_percent"), F.lit("ram_mb")))
    stamp = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    samples = (table(spark, sf, "lineitem").join(runs, F.col("l_orderkey") == F.col("o_orderkey"))
               .select(path, stamp.alias("ord"), columns(stamp.cast("string"), F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"))))
    return support.write_lines(logs.unionByName(heads).unionByName(samples), scratch_path(spark, "report"))


def q_run_report(spark: SparkSession, sf: str) -> DataFrame:
    """B8 (S5, S6, S8, P12, P13, J1, K3): the report and its subsets as written
    and read again, with the number of inputs that were rejected."""
    root = _report_files(spark, sf)
    out = scratch_path(spark, "report-views")
    views = jobs.run_report(spark, root, base_dir=root, out=out)
    rejected = views.pop("rejected_inputs").agg(F.count_if(F.col("reason").startswith("not a run log")).alias("broken_logs"),
                                                F.count_if(F.col("reason") == "no column ram_mb").alias("short_samples"))
    back = None
    for name, view in views.items():
        if not view.isEmpty():  # an empty subset is not written
            rows = read_detail(spark, f"{out}/{name}").withColumn("report", F.lit(name))
            back = rows if back is None else back.unionByName(rows)
    return back.join(F.broadcast(rejected))


def _report_sql() -> str:
    from .standins import _zr
    return f"""
WITH o AS ({_REPORT_RUNS}),
x AS (SELECT o.*, bucket % 4 AS kind, attack || '_' || bucket AS slug FROM o),
runs AS (SELECT status, attack, slug, kind, sum(o_custkey) AS packets, count(*) / 4.0::DOUBLE AS t FROM x GROUP BY ALL),
c AS (SELECT status, slug, CAST(round(l_quantity * 100.0::DOUBLE) AS HUGEINT) AS c, CAST(round(l_extendedprice * 100.0::DOUBLE) AS HUGEINT) AS r, l_extendedprice AS ram
      FROM lineitem JOIN x ON l_orderkey = o_orderkey WHERE kind <> 2),
s AS (SELECT status, slug, max(ram) AS max_ram, count(*)::HUGEINT AS n, sum(c)::HUGEINT AS c1, sum(c * c)::HUGEINT AS c2, sum(r)::HUGEINT AS r1, sum(r * r)::HUGEINT AS r2
      FROM c GROUP BY ALL),
m AS (SELECT status, slug, max_ram, c1::DOUBLE / (n::DOUBLE * 100.0::DOUBLE) AS avg_cpu,
             CASE WHEN n > 1 THEN (n * c2 - c1 * c1)::DOUBLE / (n * (n - 1))::DOUBLE / 10000.0::DOUBLE END AS var_cpu,
             CASE WHEN n > 1 THEN (n * r2 - r1 * r1)::DOUBLE / (n * (n - 1))::DOUBLE / 10000.0::DOUBLE END AS var_ram FROM s),
d AS (SELECT CASE status WHEN 'F' THEN 'CICFlowMeter' WHEN 'O' THEN 'NTLFlowLyzer' ELSE 'ALFlowLyzer' END AS extractor,
             CASE WHEN kind = 0 THEN slug ELSE attack END AS attack, CAST(packets AS BIGINT) AS packets, {_zr('t')} AS time_s, {_zr('packets / t')} AS pps,
             {_zr('avg_cpu')} AS avg_cpu, {_zr('sqrt(var_cpu)')} AS std_cpu, {_zr('var_cpu')} AS var_cpu, {_zr('max_ram')} AS max_ram,
             {_zr('sqrt(var_ram)')} AS std_ram, {_zr('var_ram')} AS var_ram
      FROM runs LEFT JOIN m USING (status, slug) WHERE kind <> 3),
v AS (SELECT *, 'benchmark_detailed' AS report FROM d UNION ALL SELECT *, 'benchmark_dns_only' FROM d WHERE contains(attack, 'DNS')
      UNION ALL SELECT *, 'benchmark_syn_only' FROM d WHERE contains(attack, 'Syn')
      UNION ALL SELECT *, 'head_to_head_cic_ntl_syn' FROM d WHERE contains(attack, 'Syn') AND extractor IN ('CICFlowMeter', 'NTLFlowLyzer'))
SELECT v.*, (SELECT count(*) FROM runs WHERE kind = 3) AS broken_logs, (SELECT count(*) FROM runs WHERE kind = 2) AS short_samples FROM v"""


def q_fragment_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of consolidated fragments by rank of the fragment and place in it;
    fragments with two column orders, and numbers that do not sort as names do."""
    li = table(spark, sf, "lineitem")
    turned = F.col("l_linenumber") % 2 == 0
    path = F.concat(F.lit("CIC_RAW/01-12/Syn_"), "l_returnflag", F.lit("/frag_"), (F.col("l_linenumber") * 3).cast("string"), F.lit(".csv")).alias("path")
    rows = li.select(path, (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
                     F.when(turned, F.concat_ws(",", "l_orderkey", "l_linenumber")).otherwise(F.concat_ws(",", "l_linenumber", "l_orderkey")).alias("line"))
    heads = li.select(path, F.lit(-1).cast("bigint").alias("ord"), F.when(turned, "okey,line").otherwise("line,okey").alias("line")).distinct()
    root = support.write_large_files(rows.unionByName(heads), scratch_path(spark, "ordered"))
    merged = jobs.consolidate_fragments(spark, root, ordered=True)
    return merged.select("attack", "file_name", F.col("_file_seq").alias("file_seq"), F.col("_row_seq").alias("row_seq"), "okey", "line")


_FRAGMENT_ORDER_SQL = """
WITH f AS (SELECT 'Syn_' || l_returnflag AS attack, 'frag_' || (l_linenumber * 3) || '.csv' AS file_name, l_orderkey * 8 + l_linenumber AS ord,
                  CAST(l_orderkey AS VARCHAR) AS okey, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem)
SELECT attack, file_name, dense_rank() OVER (PARTITION BY attack ORDER BY file_name) AS file_seq,
       row_number() OVER (PARTITION BY attack, file_name ORDER BY ord) AS row_seq, okey, line FROM f"""

_LONG = "l_quantity > 40"


def _ragged_files(spark: SparkSession, sf: str, style: str) -> str:
    """Flow files of a style with rows of one field too many; of A and C a header file
    without a source address (line number 7), of B a headerless file that is too wide
    (line number 6; it is compressed, as each of its lines has 300 zeros)."""
    li = table(spark, sf, "lineitem")
    source, extra = F.col("l_suppkey").cast("string"), F.when(F.expr(_LONG), ",extra").otherwise("")
    order = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    name = F.concat(F.lit(f"{style}/01-12/Syn/f"), F.col("l_linenumber").cast("string"), F.lit(".csv"))
    names, first = li.select("l_linenumber").distinct(), F.lit(-1).cast("bigint").alias("ord")
    if style == "B":
        wide = F.col("l_linenumber") == 6
        line = F.concat_ws(",", F.lit("id"), F.lit("t"), source, F.lit("1"), F.when(wide, F.repeat(F.lit("0,"), F.lit(300))).otherwise("0,0,0,0,0,0,0,0"), F.lit("Label"))
        name = F.concat(name, F.when(wide, ".gz").otherwise(""))
        heads = names.filter("l_linenumber <> 6").select(name.alias("path"), first, F.lit("id,t,0,1,0,0,0,0,0,0,0,0,Label").alias("line"))
    else:
        line = F.concat_ws(",", source, "l_orderkey")
        heads = names.select(name.alias("path"), first, F.when(F.col("l_linenumber") == 7, "a,b").otherwise("Src IP,f").alias("line"))
    rows = li.select(name.alias("path"), order.alias("ord"), F.concat(line, extra).alias("line"))
    return support.write_large_files(rows.unionByName(heads), scratch_path(spark, "ragged"))


def q_label_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What each labelling job wrote, rejected and skipped, the
    rejected rows counted while it wrote.  A style's files go before the next one's
    are made."""
    rows = []
    for style in ("A", "B", "C"):
        with scratch_scope(spark):
            root, out = _ragged_files(spark, sf, style), scratch_path(spark, f"labelled-{style}")
            if style == "B":
                result = jobs.label_positional_flows(spark, f"{root}/B", ["1", "2", "3"], out=out)
            else:
                result = jobs.label_header_flows(spark, f"{root}/{style}", ["1", "2", "3"], style=style, out=out)
            counts, back = result.row_counts(), spark.read.parquet(out)
            rows.append((style, counts["rows"], counts["rejected"], back.count(), back.filter("label <> 'BENIGN'").count(), len(result.skipped)))
            del result, back
    return spark.createDataFrame(rows, "style string, read bigint, rejected bigint, written bigint, attacks bigint, skipped_files bigint")


_LABEL_REJECTS_SQL = f"""
WITH s AS (SELECT unnest(['A', 'B', 'C']) AS style),
l AS (SELECT style, l_suppkey, {_LONG} AS long FROM lineitem, s WHERE l_linenumber <> CASE style WHEN 'B' THEN 6 ELSE 7 END),
f AS (SELECT count(DISTINCT l_linenumber) AS n, count(DISTINCT CASE WHEN l_linenumber = 6 THEN 1 END) AS six,
             count(DISTINCT CASE WHEN l_linenumber = 7 THEN 1 END) AS seven FROM lineitem),
c AS (SELECT style, count(*) AS n, count(CASE WHEN long THEN 1 END) AS rejected, count(CASE WHEN NOT long AND l_suppkey IN (1, 2, 3) THEN 1 END) AS attacks FROM l GROUP BY style)
SELECT style, c.n + CASE style WHEN 'B' THEN f.n - six ELSE 0 END AS read, rejected, read - rejected AS written, attacks,
       CASE style WHEN 'B' THEN six ELSE seven END AS skipped_files
FROM c, f"""


def queries() -> dict:
    return {"extractor_report": q_extractor_report, "f1_view": q_f1_view, "class_gate": q_class_gate,
            "capture_directories": q_capture_directories, "importance_report": q_importance_report,
            "prepare_training": q_prepare_training, "consolidate_fragments": q_consolidate_fragments,
            "run_report": q_run_report, "fragment_order": q_fragment_order, "label_rejects": q_label_rejects,
            "tolerant_scan": q_tolerant_scan, "rejected_rows": q_rejected_rows, "training_sample": q_training_sample,
            "attacker_join": q_attacker_join, "run_log_rows": q_run_log_rows}


def oracle_sql() -> dict[str, str]:
    from .standins import _SCENARIO_SQL
    return {"extractor_report": _REPORT_SQL, "f1_view": _SCENARIO_SQL, "class_gate": _GATE_SQL,
            "capture_directories": _DIRECTORIES_SQL, "importance_report": _IMPORTANCE_SQL,
            "prepare_training": _PREPARE_SQL, "consolidate_fragments": _FRAGMENTS_SQL,
            "run_report": _report_sql(), "fragment_order": _FRAGMENT_ORDER_SQL, "label_rejects": _LABEL_REJECTS_SQL,
            "tolerant_scan": _TOLERANT_SQL, "rejected_rows": _REJECTED_SQL, "training_sample": _SAMPLE_SQL,
            "attacker_join": _ATTACKER_SQL, "run_log_rows": _RUN_LOG_SQL}
