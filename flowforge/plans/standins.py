"""The operator inventory run on the driver's tables, with a DuckDB oracle.

The driver tables stand in for the flow-record domain:

* runs      = ``orders``   (extractor = o_orderstatus, attack = o_orderpriority,
                            packets = o_custkey, seconds = o_totalprice / 1000)
* samples   = ``lineitem`` keyed by l_orderkey (cpu = l_quantity,
                            ram = l_extendedprice)
* flows     = ``lineitem`` (source = l_suppkey, attack = l_returnflag)
* file paths = ``pages.url``; metrics = ``events``; classes = ``labels``;
  feature matrix = ``embeddings``; log text = ``documents``.

Every query reads whole tables.  Each Spark query returns the same column
names and types as its oracle SQL.  Rounding in the oracle goes through a
decimal of the value's shortest text form, which is how Spark rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.columns import (align, attack_from_path, binary_target,
                                 feature_columns, flat_name, joined_in_order,
                                 rank_entry, scenario_name, to_millions,
                                 topology_label)
from ..operators import encoding, matching, ranking, sampling, stats
from ..operators import scoring
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]

# Stand-in parameters (fixed for every scale factor).
ATTACKERS = ["5", "17"]
SAMPLE_RATE = 0.3
CAP_PER_GROUP = 1000
BATCH_ROWS = 5000
TOP_K = 10
GRID_KEYWORDS = ["en", "fr", "DrDoS_de", "es", "xx"]
GRID_EXTRACTORS = ["http", "https"]
ANYWHERE_TEST = ["https"]


def R(expr: str, digits: int = 4) -> str:
    """Oracle-side rounding that matches Spark's (half-up on the decimal text)."""
    return f"round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {digits})::DOUBLE"


def _zr(expr: str, digits: int = 4) -> str:
    return R(f"coalesce({expr}, 0)", digits)


# ---------------------------------------------------------------------------
# Shared stand-in frames
# ---------------------------------------------------------------------------

def runs_frame(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    seconds = F.col("o_totalprice") / F.lit(1000.0)
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderstatus").alias("extractor"),
        F.col("o_orderpriority").alias("attack"),
        F.col("o_custkey").alias("total_packets"),
        seconds.alias("time_seconds"),
        stats.run_throughput(F.col("o_custkey"), seconds).alias("pps"),
        F.col("o_orderkey").alias("monitor_file"))


def samples_frame(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("monitor_file"),
                     F.col("l_quantity").alias("cpu_percent"),
                     F.col("l_extendedprice").alias("ram_mb"))


def detail_frame(spark: SparkSession, sf: str) -> DataFrame:
    return stats.run_detail(runs_frame(spark, sf),
                            stats.sample_stats(samples_frame(spark, sf)),
                            keep=[F.col("run_id")])


# Moments from exact sums of hundredths (samples carry two decimals).
_SAMPLE_STATS_SQL = """
  SELECT k, max_ram, n,
         CASE WHEN cn > 0 THEN c1::DOUBLE / (cn::DOUBLE * 100.0::DOUBLE) END AS avg_cpu,
         sqrt(CASE WHEN cn > 1 THEN (cn * c2 - c1 * c1)::DOUBLE / (cn * (cn - 1))::DOUBLE
                                    / 10000.0::DOUBLE END) AS std_cpu,
         CASE WHEN cn > 1 THEN (cn * c2 - c1 * c1)::DOUBLE / (cn * (cn - 1))::DOUBLE
                               / 10000.0::DOUBLE END AS var_cpu,
         sqrt(CASE WHEN rn > 1 THEN (rn * r2 - r1 * r1)::DOUBLE / (rn * (rn - 1))::DOUBLE
                                    / 10000.0::DOUBLE END) AS std_ram,
         CASE WHEN rn > 1 THEN (rn * r2 - r1 * r1)::DOUBLE / (rn * (rn - 1))::DOUBLE
                               / 10000.0::DOUBLE END AS var_ram
  FROM (
    SELECT l_orderkey AS k, max(l_extendedprice) AS max_ram, count(*) AS n,
           count(cq) AS cn, sum(cq)::HUGEINT AS c1, sum(cq * cq)::HUGEINT AS c2,
           count(cr) AS rn, sum(cr)::HUGEINT AS r1, sum(cr * cr)::HUGEINT AS r2
    FROM (SELECT l_orderkey, l_extendedprice,
                 CAST(round(l_quantity * 100.0::DOUBLE) AS HUGEINT) AS cq,
                 CAST(round(l_extendedprice * 100.0::DOUBLE) AS HUGEINT) AS cr
          FROM lineitem)
    GROUP BY l_orderkey)"""

_DETAIL_SQL = f"""
WITH s AS ({_SAMPLE_STATS_SQL}),
r AS (
  SELECT o_orderkey AS run_id, o_orderstatus AS extractor, o_orderpriority AS attack,
         o_custkey AS total_packets, o_totalprice / 1000.0::DOUBLE AS t
  FROM orders)
SELECT r.run_id, r.extractor, r.attack,
       CAST(coalesce(r.total_packets, 0) AS BIGINT) AS packets,
       {_zr('r.t')} AS time_s,
       {_zr('CASE WHEN r.t > 0 THEN r.total_packets / r.t ELSE 0.0::DOUBLE END')} AS pps,
       {_zr('s.avg_cpu')} AS avg_cpu, {_zr('s.std_cpu')} AS std_cpu,
       {_zr('s.var_cpu')} AS var_cpu, {_zr('s.max_ram')} AS max_ram,
       {_zr('s.std_ram')} AS std_ram, {_zr('s.var_ram')} AS var_ram,
       coalesce(s.n, 0) AS n_samples
FROM r LEFT JOIN s ON r.run_id = s.k"""


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------

def q_run_detail(spark, sf):
    return detail_frame(spark, sf)


def q_extractor_rollup(spark, sf):
    return stats.extractor_rollup(detail_frame(spark, sf))


def _units_sum(col: str, scale: str = "10000.0") -> str:
    """Exact sum of a fixed-point column in integer units, as a double."""
    return f"CAST(sum(CAST(round({col} * {scale}::DOUBLE) AS HUGEINT)) AS DOUBLE)"


def _units_mean(col: str) -> str:
    return f"{_units_sum(col)} / (count({col})::DOUBLE * 10000.0::DOUBLE)"


_ROLLUP_SQL = f"""
WITH d AS ({_DETAIL_SQL}),
g AS (
  SELECT extractor, CAST(sum(packets) AS BIGINT) AS total_packets,
         {_units_sum('time_s')} / 10000.0::DOUBLE AS t,
         {_units_mean('avg_cpu')} AS avg_cpu, {_units_mean('std_cpu')} AS std_cpu,
         {_units_mean('var_cpu')} AS var_cpu, max(max_ram) AS max_ram,
         {_units_mean('std_ram')} AS std_ram, {_units_mean('var_ram')} AS var_ram
  FROM d GROUP BY extractor)
SELECT extractor, total_packets, {R('t')} AS time_s,
       {R('total_packets::DOUBLE / nullif(t, 0)')} AS pps,
       {R('avg_cpu')} AS avg_cpu, {R('std_cpu')} AS std_cpu, {R('var_cpu')} AS var_cpu,
       {R('max_ram')} AS max_ram, {R('std_ram')} AS std_ram, {R('var_ram')} AS var_ram
FROM g"""


def q_extractor_throughput(spark, sf):
    """A4 on (extractor, attack) groups; runs of priority 5 report no time,
    so their group has no defined throughput (null, not infinity)."""
    r = runs_frame(spark, sf)
    t = F.when(F.col("attack").startswith("5"), F.lit(0.0)).otherwise(F.col("time_seconds"))
    per_run = r.select("extractor", "attack", "total_packets", t.alias("t"))
    return per_run.groupBy("extractor", "attack").agg(
        F.sum("total_packets").cast("bigint").alias("total_packets"),
        F.round(F.sum("t"), 4).alias("time_s"),
        F.round(F.try_divide(F.sum("total_packets").cast("double"), F.sum("t")), 4).alias("pps"),
        F.round(F.avg(stats.run_throughput(F.col("total_packets"), F.col("t"))), 4)
        .alias("mean_run_pps"))


_THROUGHPUT_SQL = f"""
WITH r AS (
  SELECT o_orderstatus AS extractor, o_orderpriority AS attack, o_custkey AS p,
         CASE WHEN starts_with(o_orderpriority, '5') THEN 0.0::DOUBLE
              ELSE o_totalprice / 1000.0::DOUBLE END AS t
  FROM orders)
SELECT extractor, attack, CAST(sum(p) AS BIGINT) AS total_packets,
       {R('sum(t)')} AS time_s,
       {R('sum(p)::DOUBLE / nullif(sum(t), 0)')} AS pps,
       {R('avg(CASE WHEN t > 0 THEN p / t ELSE 0.0::DOUBLE END)')} AS mean_run_pps
FROM r GROUP BY extractor, attack"""


def q_sample_summary(spark, sf):
    return stats.sample_summary(samples_frame(spark, sf))


_SUMMARY_SQL = f"""
SELECT l_orderkey AS monitor_file, max(l_quantity) AS max_cpu,
       {R(_units_sum('l_quantity', '100.0') + ' / (count(l_quantity)::DOUBLE * 100.0::DOUBLE)', 2)}
         AS avg_cpu,
       max(l_extendedprice) AS max_ram,
       {R(_units_sum('l_extendedprice', '100.0')
          + ' / (count(l_extendedprice)::DOUBLE * 100.0::DOUBLE)', 2)} AS avg_ram,
       count(*) AS n_samples
FROM lineitem GROUP BY l_orderkey"""


def q_topology_label(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey",
                     topology_label(F.col("l_suppkey"), ATTACKERS,
                                    F.col("l_returnflag")).alias("label"))


_TOPOLOGY_SQL = f"""
SELECT l_orderkey, l_linenumber, l_suppkey,
       CASE WHEN CAST(l_suppkey AS VARCHAR) IN ({', '.join(repr(a) for a in ATTACKERS)})
            THEN l_returnflag ELSE 'BENIGN' END AS label
FROM lineitem"""


def q_path_attack_name(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", attack_from_path(F.col("url")).alias("attack"))


_PATH_ATTACK_SQL = r"""
SELECT page_id, regexp_extract(url, '([^/]+)/[^/]+$', 1) AS attack FROM pages"""


def q_path_flat_name(spark, sf):
    p = table(spark, sf, "pages")
    rel = F.regexp_replace(F.col("url"), r"^[a-z]+://", "")
    return p.select("page_id", flat_name(rel).alias("flat_name"))


_PATH_FLAT_SQL = r"""
SELECT page_id, replace(regexp_replace(url, '^[a-z]+://', ''), '/', '_') AS flat_name
FROM pages"""

# Dirty cells made from l_linenumber (1..7), identically on both sides.
_DIRTY_SQL = """CASE l_linenumber
    WHEN 1 THEN 'nan' WHEN 2 THEN 'inf' WHEN 3 THEN 'not a dns flow'
    WHEN 4 THEN '1d' WHEN 5 THEN 'Unknown' WHEN 6 THEN 'Infinity'
    ELSE CAST(l_quantity AS VARCHAR) || 'e1' END"""


def q_artefact_scrub(spark, sf):
    li = table(spark, sf, "lineitem")
    raw = li.select("l_orderkey", "l_linenumber", "l_partkey",
                    F.expr(_DIRTY_SQL.replace("VARCHAR", "STRING")).alias("raw"))
    scrubbed = clean.scrub(raw.withColumn("cell", F.col("raw")), columns=["cell"])
    typed = clean.coerce_numeric(scrubbed, keep=["l_orderkey", "l_linenumber",
                                                 "l_partkey", "raw"])
    return clean.zero_nonfinite(typed, ["cell"]).withColumnRenamed("cell", "value")


_SCRUB_SQL = f"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, {_DIRTY_SQL} AS raw FROM lineitem),
s AS (SELECT *, CASE WHEN raw IN ('not a dns flow', 'not a complete handshake', 'nan',
                                   'inf', '-inf', 'unknown') THEN '0' ELSE raw END AS cell
      FROM d),
n AS (SELECT *, coalesce(CASE WHEN regexp_matches(cell, '{clean.NUMBER_PATTERN}')
                              THEN TRY_CAST(cell AS DOUBLE) END, 0.0::DOUBLE) AS v FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, raw,
       coalesce(CASE WHEN abs(v) < 'Infinity'::DOUBLE THEN v ELSE 0.0::DOUBLE END, 0.0::DOUBLE)
         AS value
FROM n"""

_KIND_COLUMNS = {
    "quantity_text": "CAST(l_quantity AS {t})",
    "returnflag": "l_returnflag",
    "dirty_text": _DIRTY_SQL,
    "price_text": "CAST(l_extendedprice AS {t})",
    "sparse_text": "CASE WHEN l_linestatus = 'O' THEN CAST(l_tax AS {t}) END",
}


def q_column_kind(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = li.select(*[F.expr(e.replace("VARCHAR", "STRING").format(t="STRING")).alias(n)
                       for n, e in _KIND_COLUMNS.items()])
    return clean.kind_report(cols, list(_KIND_COLUMNS))


def _kind_sql() -> str:
    sel = ", ".join(f"{e.format(t='VARCHAR')} AS {n}" for n, e in _KIND_COLUMNS.items())
    parts = []
    for n in _KIND_COLUMNS:
        v = f"TRY_CAST({n} AS DOUBLE)"
        exp = (f"TRY_CAST(regexp_extract({n}, '[eE]([+-]?[0-9]+)', 1) AS BIGINT) "
               f"- length(regexp_extract({n}, '[.]([0-9]*)', 1))")
        bad = (f"count(*) FILTER (WHERE {n} IS NOT NULL AND "
               f"(CASE WHEN regexp_matches({n}, '{clean.DECIMAL_PATTERN}') "
               f"AND (NOT contains(lower({n}), 'e') OR coalesce({exp} <= 308, false)) "
               f"AND abs({v}) < 'Infinity'::DOUBLE THEN {v} "
               f"WHEN regexp_matches({n}, '{clean.INFINITY_PATTERN}') THEN {v} END) IS NULL)")
        parts.append(f"SELECT '{n}' AS column_name, {bad} AS bad_cells FROM c")
    return (f"WITH c AS (SELECT {sel} FROM lineitem), b AS ({' UNION ALL '.join(parts)}) "
            "SELECT column_name, bad_cells, CASE WHEN bad_cells > 0 THEN 'categorical' "
            "ELSE 'numeric' END AS kind FROM b")


def q_category_codes(spark, sf):
    part = table(spark, sf, "part")
    return encoding.encode_categoricals(
        part.select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"])


_CODES_SQL = """
SELECT p_partkey,
       CAST(dense_rank() OVER (ORDER BY coalesce(p_type, 'nan')) - 1 AS INTEGER) AS p_type,
       CAST(dense_rank() OVER (ORDER BY coalesce(p_brand, 'nan')) - 1 AS INTEGER) AS p_brand
FROM part"""

_TARGET_LABEL_SQL = """CASE WHEN l_suppkey = 5 THEN l_returnflag
    WHEN l_suppkey = 6 THEN NULL WHEN l_suppkey = 7 THEN 'Benign-Looking'
    ELSE 'BENIGN' END"""


def q_binary_target(spark, sf):
    li = table(spark, sf, "lineitem")
    lab = F.expr(_TARGET_LABEL_SQL)
    return li.select("l_orderkey", "l_linenumber", "l_suppkey",
                     lab.alias("label"), binary_target(lab).alias("target"))


_TARGET_SQL = f"""
SELECT l_orderkey, l_linenumber, l_suppkey, {_TARGET_LABEL_SQL} AS label,
       CASE WHEN contains(lower(coalesce({_TARGET_LABEL_SQL}, 'nan')), 'benign')
            THEN 0 ELSE 1 END AS target
FROM lineitem"""

# lineitem renamed into flow vocabulary: identifiers and the label must be
# pruned, the rest are features; the training set knew one more feature.
_FLOW_NAMES = {"l_orderkey": "flow_id", "l_shipdate": "timestamp",
               "l_suppkey": "src_ip", "l_partkey": "dst_port",
               "l_linenumber": "protocol", "l_quantity": "packets_count",
               "l_extendedprice": "total_payload_bytes", "l_discount": "down_up_rate",
               "l_tax": "bytes_rate", "l_returnflag": "label",
               "l_linestatus": "handshake_state"}
_TRAIN_COLUMNS = ["packets_count", "total_payload_bytes", "idle_mean",
                  "bytes_rate", "down_up_rate"]


def q_feature_align(spark, sf):
    li = table(spark, sf, "lineitem")
    flows = li.select(*[F.col(k).alias(v) for k, v in _FLOW_NAMES.items()])
    feats = feature_columns(flows.columns)
    test = flows.select("flow_id", "protocol", *feats)
    return align(test, ["flow_id", "protocol"] + _TRAIN_COLUMNS)


_ALIGN_SQL = """
SELECT l_orderkey AS flow_id, l_linenumber AS protocol, l_quantity AS packets_count,
       l_extendedprice AS total_payload_bytes, 0 AS idle_mean, l_tax AS bytes_rate,
       l_discount AS down_up_rate
FROM lineitem"""


def _grid_catalogue(spark, sf):
    p = table(spark, sf, "pages")
    path_part = F.regexp_replace(F.col("url"), r"^[a-z]+://[^/]*", "")
    day = (F.when(F.col("url").contains(".org/"), F.lit("01-12"))
           .when(F.col("url").contains(".net/"), F.lit("03-11"))
           .otherwise(F.lit("other")))
    return p.select(F.col("url").alias("path"),
                    F.regexp_extract(F.col("url"), "^([a-z]+)://", 1).alias("extractor"),
                    path_part.alias("file_name"), day.alias("day"))


def q_scenario_grid_match(spark, sf):
    grid = matching.scenario_grid(spark, GRID_KEYWORDS, GRID_EXTRACTORS)
    m = matching.match_files(grid, _grid_catalogue(spark, sf))
    return m.select("attack", "extractor", "match_path")


def _grid_values() -> str:
    rows = ", ".join(f"('{a}', '{e}')" for a in GRID_KEYWORDS for e in GRID_EXTRACTORS)
    return f"(VALUES {rows}) AS g(attack, extractor)"


_GRID_CAT_SQL = """
SELECT url AS path, regexp_extract(url, '^([a-z]+)://', 1) AS extractor,
       regexp_replace(url, '^[a-z]+://[^/]*', '') AS file_name,
       CASE WHEN contains(url, '.org/') THEN '01-12' WHEN contains(url, '.net/') THEN '03-11'
            ELSE 'other' END AS day
FROM pages"""


def _match_sql(scope: str) -> str:
    kw = "replace(lower(g.attack), 'drdos_', '')"
    return f"""
SELECT g.attack, g.extractor, min(c.path) AS match_path
FROM {_grid_values()}
LEFT JOIN (SELECT * FROM ({_GRID_CAT_SQL}) WHERE {scope}) c
  ON c.extractor = g.extractor AND contains(lower(c.file_name), {kw})
     AND NOT ({kw} = 'udp' AND contains(lower(c.file_name), 'lag'))
GROUP BY g.attack, g.extractor"""


def q_pairing_strategy(spark, sf):
    grid = matching.scenario_grid(spark, GRID_KEYWORDS, GRID_EXTRACTORS)
    p = matching.pair_train_test(grid, _grid_catalogue(spark, sf),
                                 anywhere_test_for=ANYWHERE_TEST)
    return p.select("attack", "extractor", "train_path", "test_path", "strategy")


_PAIRING_SQL = f"""
WITH tr AS ({_match_sql("day = '01-12'")}), an AS ({_match_sql('TRUE')}),
te AS ({_match_sql("day = '03-11'")}),
j AS (
  SELECT tr.attack, tr.extractor, coalesce(tr.match_path, an.match_path) AS train_path,
         CASE WHEN te.match_path IS NOT NULL THEN te.match_path
              WHEN tr.extractor IN ({', '.join(repr(e) for e in ANYWHERE_TEST)})
              THEN an.match_path END AS test_path
  FROM tr JOIN an USING (attack, extractor) JOIN te USING (attack, extractor))
SELECT attack, extractor, train_path, test_path,
       CASE WHEN test_path IS NOT NULL AND test_path <> train_path THEN 'Real' ELSE 'Split' END
         AS strategy
FROM j WHERE train_path IS NOT NULL"""


def q_subset_contains(spark, sf):
    return stats.subset_contains(detail_frame(spark, sf), "attack", "high")


def q_subset_pair(spark, sf):
    d = stats.subset_contains(detail_frame(spark, sf), "attack", "URGENT")
    return d.filter(F.col("extractor").isin("F", "O"))


def q_regex_scenario_mean(spark, sf):
    ev = table(spark, sf, "events")
    metrics = ev.select(
        F.expr(_EVENT_ATTACK_SQL).alias("attack"),
        F.expr(_EVENT_EXTRACTOR_SQL.replace("json_extract_string", "get_json_object")
               ).alias("extractor"),
        F.col("value").alias("f1"))
    hit = metrics.filter(F.col("attack").rlike("(?i)Syn|UDP|LDAP"))
    named = hit.withColumn("scenario", scenario_name(F.col("attack")))
    named = named.na.drop(subset=["scenario"])
    return named.groupBy("scenario", "extractor").agg(
        F.round(F.avg("f1"), 6).alias("mean_f1"), F.count(F.lit(1)).alias("n"))


_EVENT_ATTACK_SQL = """CASE event_type WHEN 'click' THEN 'Syn' WHEN 'view' THEN 'UDP'
    WHEN 'error' THEN 'UDPLag' WHEN 'purchase' THEN 'ldap' ELSE event_type END"""
_EVENT_EXTRACTOR_SQL = """CASE
    WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 33 THEN 'CIC'
    WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 66 THEN 'NTL'
    ELSE 'AL' END"""

_SCENARIO_SQL = f"""
WITH m AS (SELECT {_EVENT_ATTACK_SQL} AS attack, {_EVENT_EXTRACTOR_SQL} AS extractor,
                  value AS f1 FROM events),
h AS (SELECT *, CASE WHEN contains(attack, 'UDPLag') THEN NULL
                     WHEN contains(attack, 'Syn') THEN 'Syn (Estado Fechado)'
                     WHEN contains(attack, 'UDP') THEN 'UDP (Stateless)'
                     WHEN contains(attack, 'LDAP') THEN 'LDAP (Stateless)'
                     ELSE attack END AS scenario
      FROM m WHERE regexp_matches(attack, '(?i)Syn|UDP|LDAP'))
SELECT scenario, extractor, {R('avg(f1)', 6)} AS mean_f1, count(*) AS n
FROM h WHERE scenario IS NOT NULL GROUP BY scenario, extractor"""


def _flows_with_names(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_linestatus").alias("extractor"),
                     F.concat(F.lit("flows_"), F.col("l_returnflag"), F.lit(".csv"))
                     .alias("file_name"))


def q_keyword_flow_count(spark, sf):
    c = stats.flow_counts(_flows_with_names(spark, sf), "r")
    return c.select("extractor", "flows", to_millions(F.col("flows")).alias("flows_m"))


_FLOWCOUNT_SQL = """
SELECT l_linestatus AS extractor, count(*) AS flows, count(*)::DOUBLE / 1e6 AS flows_m
FROM lineitem WHERE contains(lower('flows_' || l_returnflag || '.csv'), 'r')
GROUP BY l_linestatus"""


def q_collapse_view(spark, sf):
    flows = stats.flow_counts(_flows_with_names(spark, sf), "r")
    return stats.collapse_view(flows, detail_frame(spark, sf), None,
                               ["F", "O", "P"], keyword="urgent")


_COLLAPSE_SQL = f"""
WITH d AS ({_DETAIL_SQL}),
sub AS (SELECT * FROM d WHERE coalesce(contains(lower(attack), 'urgent'), false)),
f AS (SELECT l_linestatus AS extractor, count(*) AS flows FROM lineitem
      WHERE contains(lower('flows_' || l_returnflag || '.csv'), 'r') GROUP BY 1),
pk AS (SELECT extractor, max(max_ram) AS peak FROM sub GROUP BY 1),
tot AS (SELECT sum(packets) AS t FROM sub),
e AS (SELECT * FROM (VALUES ('F'), ('O'), ('P')) AS v(extractor))
SELECT e.extractor, coalesce(f.flows, 0)::DOUBLE / 1e6 AS flows_m,
       coalesce(pk.peak / 1024.0::DOUBLE, 0.0::DOUBLE) AS peak_ram_gb,
       (SELECT t FROM tot)::DOUBLE / 1e6 AS packets_m
FROM e LEFT JOIN f USING (extractor) LEFT JOIN pk USING (extractor)"""


def q_class_weights(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    w = sampling.class_weights(lab, "quality")
    return w.select("doc_id", "quality", "weight")


_WEIGHTS_SQL = """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
SELECT l.doc_id, l.quality,
       (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c)::DOUBLE * c.n) AS weight
FROM labels l JOIN c USING (quality)"""


def _predictions(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.select(F.col("quality").alias("label"),
                      F.when(F.col("toxic") == 0, F.lit(1)).otherwise(F.lit(0))
                      .alias("prediction"))


def q_confusion(spark, sf):
    return scoring.confusion(_predictions(spark, sf))


_CONFUSION_SQL = """
SELECT quality AS label, CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS prediction, count(*) AS n
FROM labels GROUP BY 1, 2"""


def q_weighted_scores(spark, sf):
    return scoring.weighted_scores(scoring.confusion(_predictions(spark, sf)))


_SCORES_SQL = f"""
WITH c AS ({_CONFUSION_SQL}),
sup AS (SELECT label AS cls, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END)
        AS tp FROM c GROUP BY 1),
prd AS (SELECT prediction AS cls, sum(n) AS predicted FROM c GROUP BY 1),
k AS (SELECT coalesce(sup.cls, prd.cls) AS cls, coalesce(support, 0) AS support,
             coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
      FROM sup FULL JOIN prd ON sup.cls = prd.cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0.0::DOUBLE END AS p,
             CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0::DOUBLE END AS r FROM k),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1 FROM m)
SELECT {R('sum(support * f1) / sum(support)', 6)} AS f1_score,
       {R('sum(support * p) / sum(support)', 6)} AS precision,
       {R('sum(support * r) / sum(support)', 6)} AS recall,
       CAST(sum(support) AS BIGINT) AS support
FROM f"""


def q_stratified_split(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return sampling.stratified_split(lab, "quality", "doc_id")


_SPLIT_SQL = """
SELECT doc_id, quality,
       row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id)
         <= ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY quality)) AS is_test
FROM labels"""

_SAMPLE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_SAMPLE_KEY_SQL = ("md5(concat_ws('|', '', " +
                   ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in _SAMPLE_KEY) + "))")


def q_hash_sample(spark, sf):
    li = table(spark, sf, "lineitem").select(*_SAMPLE_KEY, "l_returnflag")
    return sampling.hash_sample(li, SAMPLE_RATE, _SAMPLE_KEY, seed="")  # rate < 1


def _hash_sample_sql() -> str:
    return (f"SELECT {', '.join(_SAMPLE_KEY)}, l_returnflag FROM lineitem "
            f"WHERE substr({_SAMPLE_KEY_SQL}, 1, 8) < '{sampling.threshold_hex(SAMPLE_RATE)}'")


def q_hash_cap(spark, sf):
    li = table(spark, sf, "lineitem").select(*_SAMPLE_KEY, "l_returnflag")
    return sampling.cap_rows(li, CAP_PER_GROUP, _SAMPLE_KEY, ["l_returnflag"], seed="")


_CAP_SQL = f"""
SELECT {', '.join(_SAMPLE_KEY)}, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag
                               ORDER BY {_SAMPLE_KEY_SQL}, {', '.join(_SAMPLE_KEY)}) AS rn
  FROM lineitem) WHERE rn <= {CAP_PER_GROUP}"""

_BATCH_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def q_fixed_batches(spark, sf):
    li = table(spark, sf, "lineitem").select(*_BATCH_ORDER)
    b = ranking.fixed_batches(li, _BATCH_ORDER, BATCH_ROWS)
    # the timestamp is reported as text: engines type zone-less timestamps differently
    return b.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


_BATCH_SQL = f"""
SELECT CAST(l_shipdate AS VARCHAR) AS l_shipdate, {', '.join(_BATCH_ORDER[1:])},
       CAST(floor((row_number() OVER (ORDER BY {', '.join(_BATCH_ORDER)}) - 1)
                  / {BATCH_ROWS}) AS BIGINT) AS batch_id
FROM lineitem"""


def q_top_k_per_group(spark, sf):
    li = table(spark, sf, "lineitem")
    feats = li.select(
        F.col("l_suppkey").alias("model"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string")).alias("feature"),
        F.col("l_extendedprice").alias("importance"),
        (F.col("l_quantity") / F.lit(8.0)).alias("mean_w"),
        F.col("l_tax").alias("std_w"))
    top = ranking.top_k_per_group(feats, ["model"],
                                  [F.col("importance").desc(), F.col("feature").asc()],
                                  TOP_K)
    return top.groupBy("model").agg(
        joined_in_order(F.col("rank"), rank_entry(F.col("feature"), F.col("mean_w"),
                                                  F.col("std_w"))).alias("top_features"),
        F.count(F.lit(1)).alias("n"))


_TOPK_SQL = f"""
WITH f AS (
  SELECT l_suppkey AS model,
         concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR)) AS feature,
         l_extendedprice AS importance, l_quantity / 8.0::DOUBLE AS mean_w, l_tax AS std_w
  FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature ASC)
        AS rank FROM f)
SELECT model, string_agg(printf('%s (%.3f±%.3f)', feature, mean_w, std_w), ', ' ORDER BY rank)
         AS top_features, count(*) AS n
FROM r WHERE rank <= {TOP_K} GROUP BY model"""


def q_success_gate(spark, sf):
    li = table(spark, sf, "lineitem")
    status = li.select(F.col("l_orderkey").alias("run"),
                       (F.col("l_linestatus") == "F").alias("ok"))
    passing = stats.success_gate(status, "run", "ok")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return o.join(passing, o.o_orderkey == passing.run, "inner").select(
        "o_orderkey", "o_orderstatus", "ok_chunks", "chunks")


_GATE_SQL = """
WITH g AS (SELECT l_orderkey AS run, count(*) FILTER (WHERE l_linestatus = 'F') AS ok_chunks,
                  count(*) AS chunks
           FROM lineitem GROUP BY l_orderkey
           HAVING count(*) FILTER (WHERE l_linestatus = 'F') >= 0.99::DOUBLE * count(*))
SELECT o_orderkey, o_orderstatus, ok_chunks, chunks FROM orders JOIN g ON o_orderkey = g.run"""


def q_log_triage(spark, sf):
    d = table(spark, sf, "documents")
    lines = d.select(F.col("doc_id").alias("file"),
                     F.explode(F.split(F.col("text"), "\n")).alias("value"))
    return stats.log_triage(lines)


_TRIAGE_SQL = """
WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS value FROM documents)
SELECT file,
       CASE WHEN max(CASE WHEN contains(value, 'OutOfMemoryError') OR contains(value, 'GC overhead')
                          OR contains(value, 'heap space') THEN 1 ELSE 0 END) = 1 THEN 'alert'
            WHEN max(CASE WHEN regexp_matches(coalesce(value, ''), '[^ \t\n\r\f\x0B]')
                          THEN 1 ELSE 0 END) = 1
              THEN 'warning'
            ELSE 'clean' END AS severity
FROM l GROUP BY file"""


def q_consolidate(spark, sf):
    li = table(spark, sf, "lineitem")
    first = li.filter(F.col("l_returnflag") == "A").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    rest = li.filter(F.col("l_returnflag") != "A").select(
        "l_returnflag", "l_tax", "l_quantity", "l_orderkey", "l_linenumber")
    return matching.union_fragments([first, rest])


_CONSOLIDATE_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag,
       CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_tax END AS l_tax
FROM lineitem"""


def queries() -> dict[str, Query]:
    from . import roundtrip, modelling
    return {
        "run_detail": q_run_detail,
        "extractor_rollup": q_extractor_rollup,
        "extractor_throughput": q_extractor_throughput,
        "sample_summary": q_sample_summary,
        "topology_label": q_topology_label,
        "path_attack_name": q_path_attack_name,
        "path_flat_name": q_path_flat_name,
        "artefact_scrub": q_artefact_scrub,
        "column_kind": q_column_kind,
        "category_codes": q_category_codes,
        "binary_target": q_binary_target,
        "feature_align": q_feature_align,
        "scenario_grid_match": q_scenario_grid_match,
        "pairing_strategy": q_pairing_strategy,
        "subset_contains": q_subset_contains,
        "subset_pair": q_subset_pair,
        "regex_scenario_mean": q_regex_scenario_mean,
        "keyword_flow_count": q_keyword_flow_count,
        "collapse_view": q_collapse_view,
        "class_weights": q_class_weights,
        "confusion": q_confusion,
        "weighted_scores": q_weighted_scores,
        "stratified_split": q_stratified_split,
        "hash_sample": q_hash_sample,
        "hash_cap": q_hash_cap,
        "fixed_batches": q_fixed_batches,
        "top_k_per_group": q_top_k_per_group,
        "success_gate": q_success_gate,
        "log_triage": q_log_triage,
        "consolidate": q_consolidate,
        **roundtrip.queries(),
        **modelling.queries(),
    }


def oracle_sql() -> dict[str, str]:
    from . import roundtrip
    return {
        "run_detail": _DETAIL_SQL,
        "extractor_rollup": _ROLLUP_SQL,
        "extractor_throughput": _THROUGHPUT_SQL,
        "sample_summary": _SUMMARY_SQL,
        "topology_label": _TOPOLOGY_SQL,
        "path_attack_name": _PATH_ATTACK_SQL,
        "path_flat_name": _PATH_FLAT_SQL,
        "artefact_scrub": _SCRUB_SQL,
        "column_kind": _kind_sql(),
        "category_codes": _CODES_SQL,
        "binary_target": _TARGET_SQL,
        "feature_align": _ALIGN_SQL,
        "scenario_grid_match": _match_sql("TRUE"),
        "pairing_strategy": _PAIRING_SQL,
        "subset_contains": (f"SELECT * FROM ({_DETAIL_SQL}) "
                            "WHERE coalesce(contains(lower(attack), 'high'), false)"),
        "subset_pair": (f"SELECT * FROM ({_DETAIL_SQL}) "
                        "WHERE coalesce(contains(lower(attack), 'urgent'), false) "
                        "AND extractor IN ('F', 'O')"),
        "regex_scenario_mean": _SCENARIO_SQL,
        "keyword_flow_count": _FLOWCOUNT_SQL,
        "collapse_view": _COLLAPSE_SQL,
        "class_weights": _WEIGHTS_SQL,
        "confusion": _CONFUSION_SQL,
        "weighted_scores": _SCORES_SQL,
        "stratified_split": _SPLIT_SQL,
        "hash_sample": _hash_sample_sql(),
        "hash_cap": _CAP_SQL,
        "fixed_batches": _BATCH_SQL,
        "top_k_per_group": _TOPK_SQL,
        "success_gate": _GATE_SQL,
        "log_triage": _TRIAGE_SQL,
        "consolidate": _CONSOLIDATE_SQL,
        **roundtrip.oracle_sql(),
    }
