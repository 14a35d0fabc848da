"""URL filter: fixed host and path rules, then a path-template tree.

Native: DataFrame functions only, no Python in tasks.

1. Host and path are cut from the url; the longest rule that fits decides.
2. Each path becomes a template of up to ``DEPTH`` segments; segments that are
   numbers or long hexadecimal names turn into ``*`` and what lies deeper into
   ``**``.  Only counts per distinct template go on (aggregated before the
   shuffle), so hosts with many pages cost no more than others.
3. Level by level, a node whose children hardly ever repeat has them all
   generalised to ``*``.
4. Per host, a top branch whose distribution over (rest of the template, label
   state) lies within ``MERGE`` total variation of the whole host's is merged
   into the branch ``*``.
5. Label states come from the rules of step 1.  A template is rejected when
   its smoothed share of blocked among labelled pages,
   ``(blocked + PSEUDO * p) / (labelled + PSEUDO)`` with the corpus share
   ``p``, reaches one half; one without labelled pages stays.  Counts are compared as whole decimals, so no
   rounding enters.

Defined results: null urls and urls without ``://`` have an empty host and
path and no rule; they form the template of the empty host.  Repeated rows give
repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowforge.llm.common import written

#: (host, path prefix, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEPTH = 3
#: A node's children are generalised beyond so many of them, with fewer than two pages each.
FANOUT = 8
#: Total variation distance (numerator, denominator) up to which branches merge.
MERGE = (1, 5)
PSEUDO = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER = r"^[0-9]+([.][A-Za-z0-9]+)?$"
HEXADECIMAL = r"^[0-9A-Fa-f-]{8,}([.][A-Za-z0-9]+)?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _levels(path: Column) -> list[Column]:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s: Column) -> Column:
        return F.when(s.rlike(NUMBER) | (s.rlike(HEXADECIMAL) & s.rlike("[0-9]")), F.lit("*")).otherwise(s)

    level = [F.coalesce(general(F.get(parts, F.lit(i))), F.lit("")).alias(f"t{i + 1}") for i in range(DEPTH)]
    return [*level, F.when(F.size(parts) > DEPTH, F.lit("**")).otherwise(F.lit("")).alias("deep")]


def _big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, rejected."""
    levels = [f"t{i + 1}" for i in range(DEPTH)]
    shape = ["host", *levels, "deep"]
    host, path = host_and_path(F.col(url_col))
    cut = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    cut = cut.select("*", rule.alias("rule"), verdict.alias("ruled"), *_levels(F.col("path")))

    tree = written(cut.groupBy(*shape, "ruled").agg(F.count("*").alias("n")), "url-templates")
    names = [F.col(c).alias(f"g{i + 1}") for i, c in enumerate(levels)]
    tree = tree.select(*shape, F.coalesce("ruled", F.lit("none")).alias("state"), "n", *names)
    for i in range(DEPTH):
        parent = ["host", *[f"g{k + 1}" for k in range(i)]]
        wild = (tree.filter(F.col(f"g{i + 1}") != "").groupBy(*parent, f"g{i + 1}").agg(F.sum("n").alias("n"))
                .groupBy(*parent).agg(F.count("*").alias("kids"), F.sum("n").alias("n"))
                .filter((F.col("kids") > FANOUT) & (F.col("n") < 2 * F.col("kids"))).select(*parent, F.lit(True).alias("wild")))
        tree = (tree.join(wild, parent, "left")
                .withColumn(f"g{i + 1}", F.when(F.col("wild") & (F.col(f"g{i + 1}") != ""), F.lit("*")).otherwise(F.col(f"g{i + 1}")))
                .drop("wild"))

    rest = [*[f"g{k + 1}" for k in range(1, DEPTH)], "deep", "state"]
    cells = tree.groupBy("host", "g1", *rest).agg(F.sum("n").alias("n"))
    pooled = tree.groupBy("host", *rest).agg(F.sum("n").alias("pool"))
    total = tree.groupBy("host").agg(F.sum("n").alias("host_n"))
    size = tree.groupBy("host", "g1").agg(F.sum("n").alias("branch_n"))
    apart = (cells.join(pooled, ["host", *rest]).join(total, "host").join(size, ["host", "g1"])
             .groupBy("host", "g1", "host_n", "branch_n")
             .agg(F.sum(F.abs(_big("n") * F.col("host_n") - _big("pool") * F.col("branch_n"))).alias("inside"), F.sum("pool").alias("covered")))
    gap = _big("inside") + _big("branch_n") * (F.col("host_n") - F.col("covered"))
    merged = (apart.filter((F.col("g1") != "") & (gap * MERGE[1] <= _big("branch_n") * F.col("host_n") * (2 * MERGE[0])))
              .select("host", "g1", F.lit(True).alias("like_host")))
    tree = (tree.join(merged, ["host", "g1"], "left")
            .withColumn("g1", F.when(F.col("like_host"), F.lit("*")).otherwise(F.col("g1"))).drop("like_host"))

    block, known = F.when(F.col("state") == "block", F.col("n")).otherwise(0), F.when(F.col("state") != "none", F.col("n")).otherwise(0)
    template = ["host", *[f"g{k + 1}" for k in range(DEPTH)], "deep"]
    purity = tree.groupBy(*template).agg(F.sum(block).alias("b"), F.sum(known).alias("k"))
    overall = tree.agg(F.coalesce(F.sum(block), F.lit(0)).alias("all_b"), F.coalesce(F.sum(known), F.lit(0)).alias("all_k"))
    bad = (purity.crossJoin(F.broadcast(overall))  # one row of totals
           .filter((F.col("k") > 0) & (2 * (_big("b") * F.col("all_k") + PSEUDO * _big("all_b")) >= _big(F.col("k") + PSEUDO) * F.col("all_k")))
           .select(*template))
    rejected = tree.select(*shape, *template[1:-1]).distinct().join(bad, template, "left_semi").select(*shape, F.lit(True).alias("rejected"))
    return (cut.join(rejected, shape, "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")))


def sql() -> str:
    """DuckDB SQL for ``judge``, spelled out on its own."""
    wild = ""
    for i in range(1, 4):
        parent = ", ".join(["host", *[f"g{k}" for k in range(1, i)]])
        on = " AND ".join(f"a.{c.strip()} = w.{c.strip()}" for c in parent.split(","))
        keep = ", ".join(f"a.g{k}" for k in range(1, 4) if k != i)
        wild += f""",
w{i} AS (SELECT {parent} FROM (SELECT {parent}, g{i}, sum(n) AS n FROM l{i - 1} WHERE g{i} <> '' GROUP BY ALL)
      GROUP BY {parent} HAVING count(*) > 8 AND sum(n) < 2 * count(*)),
l{i} AS (SELECT a.host, a.t1, a.t2, a.t3, a.deep, a.state, a.n, {keep},
      CASE WHEN w.host IS NOT NULL AND a.g{i} <> '' THEN '*' ELSE a.g{i} END AS g{i}
      FROM l{i - 1} a LEFT JOIN w{i} w ON {on})"""
    seg = ", ".join(
        f"""CASE WHEN len(p) < {i} THEN '' WHEN regexp_matches(p[{i}], '^[0-9]+([.][A-Za-z0-9]+)?$')
      OR (regexp_matches(p[{i}], '^[0-9A-Fa-f-]{{8,}}([.][A-Za-z0-9]+)?$') AND regexp_matches(p[{i}], '[0-9]')) THEN '*' ELSE p[{i}] END AS t{i}"""
        for i in (1, 2, 3))
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT *, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
      list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM h),
c AS (SELECT page_id, host, path, rule,
      CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
      {seg}, CASE WHEN len(p) > 3 THEN '**' ELSE '' END AS deep FROM v),
l0 AS (SELECT host, t1, t2, t3, deep, coalesce(ruled, 'none') AS state, count(*) AS n, t1 AS g1, t2 AS g2, t3 AS g3 FROM c GROUP BY ALL){wild},
cell AS (SELECT host, g1, g2, g3, deep, state, sum(n) AS n FROM l3 GROUP BY ALL),
pool AS (SELECT host, g2, g3, deep, state, sum(n) AS pool FROM l3 GROUP BY ALL),
hostn AS (SELECT host, sum(n) AS host_n FROM l3 GROUP BY host),
brn AS (SELECT host, g1, sum(n) AS branch_n FROM l3 GROUP BY ALL),
apart AS (SELECT host, g1, host_n, branch_n, sum(abs(n * host_n - pool * branch_n)) + branch_n * (host_n - sum(pool)) AS gap
      FROM cell JOIN pool USING (host, g2, g3, deep, state) JOIN hostn USING (host) JOIN brn USING (host, g1) GROUP BY host, g1, host_n, branch_n),
like_host AS (SELECT host, g1 FROM apart WHERE g1 <> '' AND gap * 5 <= branch_n * host_n * 2),
m AS (SELECT l.host, t1, t2, t3, deep, state, n, CASE WHEN k.host IS NOT NULL THEN '*' ELSE l.g1 END AS g1, g2, g3
      FROM l3 l LEFT JOIN like_host k ON l.host = k.host AND l.g1 = k.g1),
tot AS (SELECT sum(CASE WHEN state = 'block' THEN n ELSE 0 END) AS all_b, sum(CASE WHEN state <> 'none' THEN n ELSE 0 END) AS all_k FROM m),
bad AS (SELECT host, g1, g2, g3, deep FROM m, tot GROUP BY host, g1, g2, g3, deep, all_b, all_k
      HAVING sum(CASE WHEN state <> 'none' THEN n ELSE 0 END) > 0 AND 2 * (sum(CASE WHEN state = 'block' THEN n ELSE 0 END) * all_k + 4 * all_b) >= (sum(CASE WHEN state <> 'none' THEN n ELSE 0 END) + 4) * all_k),
rej AS (SELECT DISTINCT host, t1, t2, t3, deep FROM m JOIN bad USING (host, g1, g2, g3, deep))
SELECT page_id, c.host, path, rule, coalesce(ruled, CASE WHEN rej.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN rej ON c.host = rej.host AND c.t1 = rej.t1 AND c.t2 = rej.t2 AND c.t3 = rej.t3 AND c.deep = rej.deep
"""
