"""Operators: property checks against brute force on small frames."""

import math
import random

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from flowforge import session
from flowforge.operators import encoding, matching, model, ranking, sampling, scoring, stats


def _rows(n=700, groups=("a", "b", "c"), seed=7, skew=True):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        g = "a" if skew and rnd.random() < 0.6 else rnd.choice(groups)
        out.append((i, g, rnd.randint(0, 40), rnd.random()))
    return out


def test_exact_row_number_matches_window(spark):
    df = spark.createDataFrame(_rows(), "id long, g string, k int, v double")
    got = ranking.exact_row_number(df, ["k", "id"], ["g"], out="rn", num_partitions=5)
    small = ranking.exact_row_number(df, ["k", "id"], ["g"], out="rn")
    w = Window.partitionBy("g").orderBy("k", "id")
    ref = df.withColumn("rn", F.row_number().over(w))
    assert sorted(got.select("id", "rn").collect()) == sorted(ref.select("id", "rn").collect())
    assert sorted(small.select("id", "rn").collect()) == sorted(ref.select("id", "rn").collect())
    glob = ranking.exact_row_number(df, ["v", "id"], out="rn", num_partitions=3)
    ref2 = df.withColumn("rn", F.row_number().over(Window.orderBy("v", "id")))
    assert sorted(glob.select("id", "rn").collect()) == sorted(ref2.select("id", "rn").collect())


def test_fixed_batches(spark):
    df = spark.createDataFrame(_rows(250), "id long, g string, k int, v double")
    b = ranking.fixed_batches(df, ["id"], 100)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes == [50, 100, 100]
    assert b.filter("id = 199").first().batch_id == 1


def test_top_k_ties_by_name(spark):
    df = spark.createDataFrame([("m", "b", 1.0), ("m", "a", 1.0), ("m", "c", 2.0),
                                ("n", "z", 0.5)], "m string, f string, v double")
    top = ranking.top_k_per_group(df, ["m"], [F.col("v").desc(), F.col("f")], 2)
    assert sorted((r.m, r.rank, r.f) for r in top.collect()) == [
        ("m", 1, "c"), ("m", 2, "a"), ("n", 1, "z")]


def test_stratified_split_properties(spark):
    df = spark.createDataFrame(_rows(501), "id long, g string, k int, v double")
    s = sampling.stratified_split(df, "g", "id")
    assert s.count() == 501 and s.select("id").distinct().count() == 501
    per = {r.g: (r.n, r.t) for r in s.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    for n, t in per.values():
        assert t == math.ceil(0.3 * n)
    again = sampling.stratified_split(df, "g", "id")
    assert sorted(s.collect()) == sorted(again.collect())


def test_hash_sample_and_cap(spark):
    df = spark.createDataFrame(_rows(2000), "id long, g string, k int, v double")
    s1 = sampling.hash_sample(df, 0.3, ["id"])
    s2 = sampling.hash_sample(df, 0.3, ["id"])
    assert sorted(s1.collect()) == sorted(s2.collect())
    assert 450 < s1.count() < 750
    assert sampling.hash_sample(df, 1.0, ["id"]).count() == 2000
    cap = sampling.cap_rows(df, 50, ["id"], ["g"])
    assert sorted(r["count"] for r in cap.groupBy("g").count().collect()) == [50, 50, 50]
    assert sampling.cap_rows(df, 5000, ["id"], ["g"]).count() == 2000
    one = sampling.cap_rows(df, 7, ["id"])
    first = df.orderBy(F.md5(F.col("id").cast("string")), "id").limit(7)
    assert sorted(one.collect()) == sorted(first.collect())


def test_equal_rows_are_sampled_in_proportion(spark):
    """Rows equal in every column, as floods have them, are kept like others."""
    from flowforge.plans.jobs import prepare_training_set
    rows = [("1.5", "2", "Syn")] * 2000 + [("0.5", "7", "BENIGN")] * 2000
    df = spark.createDataFrame(rows, "f1 string, f2 string, label string")
    whole = prepare_training_set(df)
    assert whole.data.count() == 4000
    some = prepare_training_set(df, max_train_rows=2500).data
    per = {r.target: r["count"] for r in some.groupBy("target").count().collect()}
    assert all(1150 < n < 1350 for n in per.values()) and len(per) == 2
    split = sampling.stratified_split(whole.data, "target", "_rowkey")
    assert {(r.target, r["count"]) for r in split.filter("is_test").groupBy("target").count().collect()} == {(0, 600), (1, 600)}


def test_split_of_null_and_tiny_classes(spark):
    df = spark.createDataFrame([(i, None if i < 10 else "a" if i < 11 else "b") for i in range(40)], "id long, g string")
    s = sampling.stratified_split(df, "g", "id")
    per = {r.g: r.t for r in s.groupBy("g").agg(F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert per == {None: 3, "a": 1, "b": 9}


def test_class_weight_of_nulls_does_not_depend_on_the_number_of_classes(spark):
    for k in (2, 2000):
        rows = [(None,)] * 4 + [(f"c{i}",) for i in range(k) for _ in range(4)]
        df = spark.createDataFrame(rows, "y string")
        assert {r.weight for r in sampling.class_weights(df, "y").collect()} == {1.0}


def test_moments_of_many_and_of_infinite_samples(spark):
    many = spark.range(20_000_000).select(F.lit("m").alias("monitor_file"), (F.col("id") % 2 * 100.0).alias("cpu_percent"),
                                          F.lit(64000.25).alias("ram_mb"))
    r = stats.sample_stats(many).first()
    assert r.n_samples == 20_000_000 and r.avg_cpu == 50.0 and math.isclose(r.var_cpu, 2500 * 2e7 / (2e7 - 1)) and r.var_ram == 0.0
    odd = spark.createDataFrame([("m", float("inf"), 1.0), ("m", 0.004, float("nan")), ("m", 0.001, 3.0)],
                                "monitor_file string, cpu_percent double, ram_mb double")
    r = stats.sample_stats(odd).first()
    assert r.avg_cpu == 0.0025 and r.max_ram == 3.0 and math.isclose(r.var_ram, 2.0)


def test_class_weights_and_gate(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(10)], "id int, y int")
    w = {r.y: r.weight for r in sampling.class_weights(df, "y").select("y", "weight")
         .distinct().collect()}
    assert math.isclose(w[1], 10 / (2 * 3)) and math.isclose(w[0], 10 / (2 * 7))
    assert sampling.class_count_map(df, "y") == {0: 7, 1: 3}


def test_encoding_by_tables_and_by_join_agree(spark, monkeypatch):
    rows = [(x, y) for x in ("b", "a", None, "nan", "é", "", "7") for y in ("p", None, None, None)] + [(None, None)] * 20
    df = spark.createDataFrame(rows, "x string, `y.z` string")
    fit = df.filter("x is null or x <> 'é'")
    found = []
    for limit in (64, 4, 0):
        monkeypatch.setattr(encoding, "MAP_ENTRIES", limit)
        out = encoding.encode_categoricals(df, ["x", "y.z"], fit_on=fit)
        assert out.columns == ["x", "y.z"]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == {64: 0, 4: 1, 0: 2}[limit]
        found.append(sorted(map(tuple, out.collect())))
    assert found[0] == found[1] == found[2]
    assert {r[0] for r in found[0]} == {0, 1, 2, 3, 4, 5} and {r[1] for r in found[0]} == {0, 1}  # 5: unseen


def test_encoding_is_a_code_point_bijection(spark):
    vals = ["b", "_", "a", None, "é", "B", "a"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, c string")
    enc = encoding.encode_categoricals(df, ["c"])
    codes = dict((r.id, r.c) for r in enc.collect())
    order = sorted({v if v is not None else "nan" for v in vals})
    assert order == ["B", "_", "a", "b", "nan", "é"]
    for i, v in enumerate(vals):
        assert codes[i] == order.index(v if v is not None else "nan")
    # unseen values get the dictionary size
    other = spark.createDataFrame([(0, "zzz"), (1, "a")], "id int, c string")
    enc2 = encoding.encode_categoricals(other, ["c"], fit_on=df)
    assert sorted((r.id, r.c) for r in enc2.collect()) == [(0, 6), (1, 2)]


def test_weighted_scores(spark):
    pairs = [(1, 1)] * 40 + [(1, 0)] * 10 + [(0, 0)] * 45 + [(0, 1)] * 5 + [(2, 1)] * 3
    df = spark.createDataFrame(pairs, "label int, prediction int")
    s = scoring.weighted_scores(scoring.confusion(df)).first()
    acc = (40 + 45) / len(pairs)
    assert math.isclose(s.recall, round(acc, 6))        # weighted recall = accuracy
    p1, r1 = 40 / 48, 40 / 50
    p0, r0 = 45 / 55, 45 / 50
    f = lambda p, r: 2 * p * r / (p + r)
    exp_f1 = (50 * f(p1, r1) + 50 * f(p0, r0) + 3 * 0) / 103
    assert math.isclose(s.f1_score, round(exp_f1, 6))


def test_report_stats_edge_cases(spark):
    samples = spark.createDataFrame(
        [("r1", 10.0, 100.0), ("r1", 30.0, 300.0), ("r2", 5.0, float("nan")), ("r2", 7.0, 70.0),
         ("r3", 1.25, 12.5)], "monitor_file string, cpu_percent double, ram_mb double")
    st = stats.sample_stats(samples)
    got = {r.monitor_file: r for r in st.collect()}
    assert math.isclose(got["r1"].var_cpu, 200.0) and math.isclose(got["r1"].std_ram,
                                                                   math.sqrt(20000.0))
    assert got["r2"].max_ram == 70.0            # NaN never wins a max
    assert got["r3"].var_cpu is None            # one sample: undefined -> zeroed in reports
    runs = spark.createDataFrame(
        [("CIC", "Syn", 100, 4.0, 25.0, "r1"), ("CIC", "DNS", 50, 0.0, 0.0, "r3"),
         ("NTL", "Syn", 10, 1.0, 10.0, "missing")],
        "extractor string, attack string, total_packets long, time_seconds double, "
        "pps double, monitor_file string")
    d = stats.run_detail(runs, st)
    rows = {(r.extractor, r.attack): r for r in d.collect()}
    assert rows[("CIC", "DNS")].var_cpu == 0.0 and rows[("NTL", "Syn")].max_ram == 0.0
    roll = {r.extractor: r for r in stats.extractor_rollup(d).collect()}
    assert roll["CIC"].total_packets == 150 and roll["CIC"].pps == 37.5
    zero = stats.extractor_rollup(d.filter("attack = 'DNS'")).first()
    assert zero.pps is None                      # 0 elapsed: undefined, not infinity
    fast = stats.sample_stats(samples)
    assert math.isclose({r.monitor_file: r for r in fast.collect()}["r1"].var_cpu, 200.0)


def test_gate_and_triage(spark):
    status = spark.createDataFrame([("a", True)] * 99 + [("a", False)] + [("b", True)] * 9
                                   + [("b", False)], "run string, ok boolean")
    assert [r.run for r in stats.success_gate(status, "run", "ok").collect()] == ["a"]
    lines = spark.createDataFrame([("f1", "java.lang.OutOfMemoryError: Java heap space"),
                                   ("f1", "ok"), ("f2", "warning text"), ("f3", "  ")],
                                  "file string, value string")
    sev = {r.file: r.severity for r in stats.log_triage(lines).collect()}
    assert sev == {"f1": "alert", "f2": "warning", "f3": "clean"}


def test_grid_matching_rules(spark):
    grid = matching.scenario_grid(spark, ["UDP", "DrDoS_DNS", "Syn", "TFTP"], ["CIC"])
    assert grid.count() == 4
    cat = spark.createDataFrame(
        [("/r/CIC/01-12/UDPLag/UDPLag.csv", "UDPLag.csv", "CIC", "01-12"),
         ("/r/CIC/01-12/UDP/DrDoS_UDP.csv", "DrDoS_UDP.csv", "CIC", "01-12"),
         ("/r/CIC/03-11/DNS/DrDoS_DNS.csv", "DrDoS_DNS.csv", "CIC", "03-11"),
         ("/r/CIC/01-12/Syn/b_Syn.csv", "b_Syn.csv", "CIC", "01-12"),
         ("/r/CIC/01-12/Syn/a_Syn.csv", "a_Syn.csv", "CIC", "01-12"),
         ("/r/CIC/03-11/Syn/Syn.csv", "Syn.csv", "CIC", "03-11")],
        "path string, file_name string, extractor string, day string")
    m = {r.attack: r.match_path for r in matching.match_files(grid, cat).collect()}
    assert m == {"UDP": "/r/CIC/01-12/UDP/DrDoS_UDP.csv", "DrDoS_DNS": "/r/CIC/03-11/DNS/DrDoS_DNS.csv",
                 "Syn": "/r/CIC/01-12/Syn/a_Syn.csv", "TFTP": None}
    pairs = {r.attack: (r.strategy, r.test_path) for r in
             matching.pair_train_test(grid, cat).collect()}
    assert pairs["Syn"] == ("Real", "/r/CIC/03-11/Syn/Syn.csv")
    assert pairs["UDP"] == ("Split", None)
    # train falls back to any day, finds the test-day file itself: same file -> Split
    assert pairs["DrDoS_DNS"] == ("Split", "/r/CIC/03-11/DNS/DrDoS_DNS.csv")
    assert "TFTP" not in pairs


def test_union_fragments(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([("y", 2, 3.0)], "s string, k int, extra double")
    u = matching.union_fragments([a, b])
    assert sorted(tuple(r) for r in u.collect()) == [(1, "x", None), (2, "y", 3.0)]
    try:
        matching.union_fragments([a, b], strict=True)
        raise AssertionError("strict union should refuse different columns")
    except ValueError:
        pass


def test_exact_moments_against_fractions(spark):
    from fractions import Fraction
    rnd = random.Random(11)
    rows = []
    for g in range(6):
        for _ in range(rnd.randint(2, 40)):
            big = rnd.choice([1, 1000, 1_500_000])
            rows.append((f"g{g}", round(rnd.uniform(-1, 1) * 100, 2),
                         round(rnd.uniform(0, big), 2)))
    df = spark.createDataFrame(rows, "monitor_file string, cpu_percent double, ram_mb double")
    got = {r.monitor_file: r for r in stats.sample_stats(df).collect()}
    for g in {r[0] for r in rows}:
        xs = [Fraction(str(r[2])) for r in rows if r[0] == g]
        n = len(xs)
        mean = sum(xs) / n
        var = sum((x - mean) ** 2 for x in xs) / (n - 1)
        assert math.isclose(got[g].var_ram, float(var), rel_tol=1e-12)
        cs = [Fraction(str(r[1])) for r in rows if r[0] == g]
        assert math.isclose(got[g].avg_cpu, float(sum(cs) / n), rel_tol=1e-12, abs_tol=1e-12)


def test_log_triage_whitespace_only_is_clean(spark):
    lines = spark.createDataFrame([("f1", "\t"), ("f1", "  "), ("f2", "\t x")],
                                  "file string, value string")
    sev = {r.file: r.severity for r in stats.log_triage(lines).collect()}
    assert sev == {"f1": "clean", "f2": "warning"}


def test_exact_row_number_null_groups_and_skew(spark):
    rnd = random.Random(21)
    rows = [(i, None if rnd.random() < 0.3 else rnd.choice(["a", "a", "a", "b"]),
             rnd.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, k int")
    got = ranking.exact_row_number(df, ["k", "id"], ["g"], out="rn", num_partitions=7)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    assert sorted(got.select("id", "rn").collect()) == sorted(ref.select("id", "rn").collect())


def test_rollup_weighted_option(spark):
    detail = spark.createDataFrame(
        [("CIC", 10, 1.0, 10.0, 1.0, 1.0, 100.0, 1.0, 1.0, 1),
         ("CIC", 20, 3.0, 30.0, 3.0, 3.0, 300.0, 3.0, 3.0, 3)],
        "extractor string, packets long, time_s double, avg_cpu double, std_cpu double, "
        "var_cpu double, max_ram double, std_ram double, var_ram double, n_samples long")
    plain = stats.extractor_rollup(detail).first()
    weighted = stats.extractor_rollup(detail, weighted=True).first()
    assert plain.avg_cpu == 20.0                       # mean of the run means
    assert weighted.avg_cpu == 25.0                    # (10*1 + 30*3) / 4
    assert plain.pps == weighted.pps == 7.5 and plain.max_ram == 300.0


def test_a_forest_scores_after_an_observation(spark):
    seen = Observation()
    spark.range(4).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 4}
    rows = spark.range(40).select((F.col("id") % 2).cast("int").alias("target"), (F.col("id") % 2 + F.col("id") / 100).alias("x"))
    train = model.assemble(rows, ["x"])
    forest = model.fit_forest(train, weight=None, trees=2, depth=2)
    pairs = scoring.confusion(model.predict(forest, train)).collect()
    assert sum(r["n"] for r in pairs) == 40 and all(r["label"] == r["prediction"] for r in pairs)


def test_rows_are_not_dealt_by_a_few_groups(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).cast("string").alias("g"))
    for out in (sampling.cap_rows(df, 50, ["id"], ["g"]), sampling.stratified_split(df, "g", "id"), sampling.class_weights(df, "g")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_many_groups_are_joined_as_well(spark, monkeypatch):
    monkeypatch.setattr(session, "LOOKUP_ROWS", 3)
    df = spark.range(400).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 10).alias("g"))
    assert sorted(r["count"] for r in sampling.cap_rows(df, 5, ["id"], ["g"]).groupBy("g").count().collect()) == [5] * 10
    assert {r.weight for r in sampling.class_weights(df, "g").collect()} == {1.0}
