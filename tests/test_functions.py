"""Schema rules, column expressions (P*) and cleaning (T*)."""

import hashlib
import math

from pyspark.sql import functions as F

from flowforge.functions import clean
from flowforge.functions.columns import (align, attack_from_log_name, attack_from_path,
                                         binary_target, canonical_dns, feature_columns,
                                         flat_name, infer_tool, joined_in_order,
                                         label_column, normalise_names, rank_entry,
                                         scenario_name, source_ip_column, topology_label,
                                         unseen_columns, zero_round)
from flowforge.functions.schema import MASTER_HEADER


def test_master_header_rule():
    assert len(MASTER_HEADER) == 272 and len(set(MASTER_HEADER)) == 272
    assert MASTER_HEADER[:7] == ["flow_id", "timestamp", "src_ip", "src_port", "dst_ip",
                                 "dst_port", "protocol"]
    # all names in their order
    assert hashlib.sha256("\n".join(MASTER_HEADER).encode()).hexdigest() == "689a0a1e8ed46a386534e0620816831a99812d580c053446d1a689e7641d99dc"
    families = {"delta_len": 81, "payload_bytes": 45, "header_bytes": 42,
                "percentage_in": 40, "delta_time": 27, "flag_counts": 24, "iat": 15,
                "bulk": 14, "_rate": 10, "subflow": 4, "active": 4, "idle": 4}
    for fam, n in families.items():
        assert sum(fam in c for c in MASTER_HEADER) == n, fam
    assert MASTER_HEADER[7] == "duration" and MASTER_HEADER[-1].startswith("fwd_payload_bytes_delta_len_")
    # none of the 265 features is an identifier or label candidate
    assert feature_columns(MASTER_HEADER) == MASTER_HEADER[7:]


def test_normalise_names_rules():
    assert normalise_names([" Src IP", "Flow Bytes/s ", "Label"]) == \
        ["src_ip", "flow_bytes/s", "label"]
    # the last of two case-variants keeps the name; an earlier label is the dummy
    assert normalise_names(["label", "x", "Label"]) == ["_extractor_label", "x", "label"]
    # exact raw repeats are suffixed like the pandas reader does
    assert normalise_names(["a", "a", "b"]) == ["a", "a.1", "b"]
    assert normalise_names(["A b", "a_b"]) == ["a_b_dup", "a_b"]
    assert normalise_names([" label", "label", "Label"]) == \
        ["_extractor_label", "_extractor_label_2", "label"]


def test_source_and_label_resolution():
    assert source_ip_column(["flow_id", "src_port", "src_ip", "ip_src"]) == "src_ip"
    assert source_ip_column(["a", "b"]) is None
    assert label_column(["label", "x", "traffic_class"]) == "traffic_class"
    assert label_column(["a"]) is None
    cols = ["flow_id", "src_ip", "ip", "port", "unnamed", "unnamed:_0", "my_timestamp",
            "x_flow_id", "simillarhttp", "label", "class_x", "duration"]
    assert feature_columns(cols) == ["unnamed:_0", "duration"]


def test_path_names(spark):
    df = spark.createDataFrame([("/d/01-12/DrDoS_DNS/f.csv", "DNS", "01-12/Syn"),
                                ("/d/03-11/Syn/x.csv", "DrDoS_DNS", "a/b/c"),
                                ("f.csv", "dns", "")],
                               "p string, a string, r string")
    out = df.select(attack_from_path(F.col("p")).alias("att"),
                    canonical_dns(F.col("a")).alias("dns"),
                    flat_name(F.col("r")).alias("flat")).collect()
    assert [r.att for r in out] == ["DrDoS_DNS", "Syn", ""]
    assert [r.dns for r in out] == ["DrDoS_DNS", "DrDoS_DNS", "dns"]
    assert [r.flat for r in out] == ["01-12_Syn", "a_b_c", ""]


def test_topology_label_total_and_exact(spark):
    df = spark.createDataFrame([("172.16.0.5", "BENIGN"), ("172.16.0.50", "x"), (None, "y"),
                                ("10.0.0.1", None), ("172.16.0.5 ", None)],
                               "src string, old string")
    out = df.select(topology_label(F.col("src"), "172.16.0.5", "Syn").alias("l")).collect()
    assert [r.l for r in out] == ["Syn", "BENIGN", "BENIGN", "BENIGN", "BENIGN"]
    multi = df.select(topology_label(F.col("src"), ["10.0.0.1", "172.16.0.5"], F.col("old"))
                      .alias("l")).collect()
    assert [r.l for r in multi] == ["BENIGN", "BENIGN", "BENIGN", None, "BENIGN"]


def test_binary_target(spark):
    df = spark.createDataFrame([("BENIGN",), ("benign",), ("Syn",), (None,), ("not-BeNiGn",)],
                               "l string")
    assert [r.t for r in df.select(binary_target(F.col("l")).alias("t")).collect()] == \
        [0, 0, 1, 1, 0]


def test_align_and_unseen(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0)], "a double, c double, extra double")
    out = align(df, ["c", "b", "a"])
    assert out.columns == ["c", "b", "a"]
    assert tuple(out.first()) == (2.0, 0, 1.0)
    assert unseen_columns(["c", "b", "a"], df.columns) == ["b"]


def test_run_log_defaults(spark):
    df = spark.createDataFrame(
        [(None, "/x/NTL_RAW/a/benchmark_Syn.json", None),
         ("Unknown", "/x/AL_RAW/b/benchmark_DNS.json", "given"),
         (None, "/x/CIC_RAW/c/benchmark_UDP.json", None),
         (None, "/x/temp_q/benchmark_q.json", None),
         (None, "/x/other/benchmark_z.json", None),
         ("Mine", "/x/ntl/benchmark_k.json", None)],
        "tool string, path string, attack string")
    out = df.select(infer_tool(F.col("tool"), F.col("path")).alias("t"),
                    attack_from_log_name(F.col("attack"), F.col("path")).alias("a")).collect()
    assert [r.t for r in out] == ["NTLFlowLyzer", "ALFlowLyzer", "CICFlowMeter",
                                  "NTLFlowLyzer", "Unknown", "Mine"]
    assert [r.a for r in out] == ["Syn", "given", "UDP", "q", "z", "k"]


def test_zero_round_and_scenarios(spark):
    df = spark.createDataFrame([(float("nan"), "UDPLag"), (None, "Syn-01"), (0.12345, "udp"),
                                (2.5, "DrDoS_UDP"), (1.0, "LDAP"), (1.0, "NTP")],
                               "x double, a string")
    out = df.select(zero_round(F.col("x")).alias("r"), scenario_name(F.col("a")).alias("s"))
    rows = out.collect()
    assert [r.r for r in rows] == [0.0, 0.0, 0.1235, 2.5, 1.0, 1.0]
    assert [r.s for r in rows] == [None, "Syn (Estado Fechado)", "udp", "UDP (Stateless)",
                                   "LDAP (Stateless)", "NTP"]


def test_rank_string(spark):
    df = spark.createDataFrame([(2, "b", 0.25, 0.0), (1, "a", 0.5, 0.125)],
                               "o int, n string, m double, s double")
    out = df.agg(joined_in_order(F.col("o"), rank_entry(F.col("n"), F.col("m"), F.col("s")))
                 .alias("j")).first().j
    assert out == "a (0.500±0.125), b (0.250±0.000)"


CELLS = ["not a dns flow", "not a complete handshake", "nan", "inf", "-inf", "unknown",
         "Unknown", "1d", "1e3", "", None, "12", " 7 ", "Infinity", "-2.5"]


def test_scrub_coerce_and_nonfinite(spark):
    df = spark.createDataFrame([(c, c) for c in CELLS], "meta string, v string")
    s1 = clean.scrub(df)
    s2 = clean.scrub(s1)
    assert s1.collect() == s2.collect()  # idempotent
    typed = clean.coerce_numeric(s1, keep=["meta"])
    fin = clean.zero_nonfinite(typed, ["v"])
    vals = [r.v for r in fin.collect()]
    assert vals == [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1000.0, 0.0, 0.0, 12.0, 7.0,
                    0.0, -2.5]
    metas = [r.meta for r in s1.collect()]
    assert metas[:6] == ["0"] * 6 and metas[6] == "Unknown"


def test_null_tokens_and_kinds(spark):
    df = spark.createDataFrame([("NA", "1", "x"), ("3", "n/a", "2"), ("4", None, "3")],
                               "a string, b string, c string")
    nt = clean.null_tokens(df)
    assert [r.a for r in nt.collect()] == [None, "3", "4"]
    kinds = clean.column_kinds(nt, ["a", "b", "c"])
    assert kinds == {"a": "numeric", "b": "numeric", "c": "categorical"}
    rep = {r.column_name: (r.bad_cells, r.kind) for r in clean.kind_report(nt, ["a", "c"]).collect()}
    assert rep == {"a": (0, "numeric"), "c": (1, "categorical")}


def test_downcast_overflow_then_zero(spark):
    df = spark.createDataFrame([(1e39,), (0.1,)], "x double")
    d = clean.downcast(df, ["x"])
    z = clean.zero_nonfinite(d.selectExpr("CAST(x AS DOUBLE) AS x"), ["x"])
    vals = [r.x for r in z.collect()]
    assert vals[0] == 0.0 and math.isclose(vals[1], 0.1, rel_tol=1e-7)


def test_normalise_names_properties():
    from hypothesis import given, settings, strategies as st
    alphabet = st.sampled_from(["a", "A", "b", " ", "_", "l", "L", "label", "Label"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(alphabet, min_size=1, max_size=4).map("".join),
                    min_size=1, max_size=8))
    def check(raw):
        out = normalise_names(raw)
        assert len(out) == len(raw)
        assert len({o.lower() for o in out}) == len(out)          # unique, case-insensitively
        assert all(" " not in o for o in out)
        # the last raw name of each normalised family keeps the normalised name
        norm = [r.strip().lower().replace(" ", "_") for r in raw]
        for n in set(norm):
            idx = max(i for i, m in enumerate(norm) if m == n)
            if raw.index(raw[idx]) == idx:                        # not an exact raw repeat
                assert out[idx] == n

    check()


def _random_cells(seed, n, size):
    import random
    rnd = random.Random(seed)
    alpha = list("0123456789") * 3 + list(".eE+- dDfFxinaIN_\t") + \
        ["inf", "Infinity", "nan", "NaN", " ", "e308", "e309", "e-400"]
    return sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(1, size)))
                   for _ in range(n)})


def test_coercion_matches_pandas_to_numeric(spark):
    """T3 equals pandas to_numeric(errors='coerce').fillna(0), then T5."""
    import pandas as pd
    cells = _random_cells(3, 6000, 6)
    exp = pd.to_numeric(pd.Series(cells, dtype=object), errors="coerce").fillna(0)
    exp = [0.0 if not math.isfinite(v) else float(v) for v in exp]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, v string")
    got = {r.i: r.v for r in clean.zero_nonfinite(clean.coerce_numeric(df, keep=["i"]), ["v"])
           .collect()}
    bad = [(cells[i], e, got[i]) for i, e in enumerate(exp)
           if not math.isclose(e, got[i], rel_tol=1e-12, abs_tol=0.0) and e != got[i]]
    assert bad == []


def test_column_kind_matches_pandas_csv_typing(spark):
    """T2 types a column as a CSV reader does (cells next to a number)."""
    import io
    import pandas as pd
    cells = [c for c in _random_cells(5, 1500, 5) if "," not in c]
    exp = []
    for c in cells:
        d = pd.read_csv(io.StringIO(f"x,y\n1,a\n{c},b\n"), keep_default_na=False,
                        na_values=[])
        exp.append("categorical" if d["x"].dtype == object else "numeric")
    src = spark.createDataFrame([(i, v) for i in range(len(cells)) for v in ("1", cells[i])],
                                "id int, x string")
    bad_cells = src.groupBy("id").agg(
        F.expr(f"count_if(x IS NOT NULL AND {clean.csv_numeric_sql('x')} IS NULL)").alias("b"))
    got = {r.id: ("categorical" if r.b > 0 else "numeric") for r in bad_cells.collect()}
    diff = [(cells[i], exp[i], got[i]) for i in range(len(cells)) if exp[i] != got[i]]
    assert diff == []


def test_repeated_header_names_match_pandas():
    """Exact repeats are suffixed as the pandas CSV reader does: the
    smallest ``.k`` clashing with no name anywhere in the header."""
    import io
    import random
    import pandas as pd
    rnd = random.Random(2)
    cases = [["a", "a", "a.1"], ["a", "a.1", "a"], ["a.1", "a.1", "a", "a"]]
    cases += [[rnd.choice(["a", "a.1", "b", "a.2", "a.1.1", "b.1"])
               for _ in range(rnd.randint(2, 7))] for _ in range(400)]
    for raw in cases:
        text = ",".join(raw) + "\n" + ",".join("1" for _ in raw) + "\n"
        cols = list(pd.read_csv(io.StringIO(text)).columns)
        assert normalise_names(raw) == [c.strip().lower().replace(" ", "_") for c in cols], raw
