"""End-to-end jobs on fixture trees."""

import os
import random


from pyspark.sql import functions as F

from flowforge.functions.schema import MASTER_HEADER
from flowforge.plans import jobs
from flowforge.sources.runs import read_detail, read_metrics, read_runs

from .fixtures import capture, run_log, samples, write

ATT = "172.16.0.5"


def test_label_extractor_a(spark, tmp):
    write(f"{tmp}/CIC_RAW/01-12/Syn/Syn.csv",
          "Src IP,Dst IP,Flow Duration,Label\n"
          f"{ATT},10.0.0.1,5,BENIGN\n10.0.0.9,10.0.0.1,6,Syn\n,10.0.0.1,7,x\n")
    write(f"{tmp}/CIC_RAW/03-11/DNS/DNS.csv",
          f"Dst IP,Src IP,Flow Duration\n10.0.0.1,{ATT},1\n")          # no label: appended
    write(f"{tmp}/CIC_RAW/03-11/DNS/nosrc.csv", "a,b\n1,2\n")         # skipped
    out = f"{tmp}/processed"
    res = jobs.label_header_flows(spark, f"{tmp}/CIC_RAW", ATT, style="A", out=out)
    assert [os.path.basename(p) for p, _ in res.skipped] == ["nosrc.csv"]
    got = sorted((r.attack, r.flow_duration, r.label) for r in res.flows.collect())
    assert got == [("DNS", "1", "DNS"), ("Syn", "5", "Syn"), ("Syn", "6", "BENIGN"),
                   ("Syn", "7", "BENIGN")]
    back = spark.read.parquet(out)
    assert back.count() == 4 and {"extractor", "day", "attack"} <= set(back.columns)
    # the label is total: every flow gets one
    assert res.flows.filter(F.col("label").isNull()).count() == 0


def test_label_extractor_b(spark, tmp):
    width = 20
    row = lambda fid, src: ",".join([fid, "t", src] + ["1"] * (width - 4) + ["BENIGN"])
    write(f"{tmp}/NTL_RAW/01-12/Syn/part1.csv", row("a", ATT) + "\n" + row("b", "10.1.1.1") + "\n")
    write(f"{tmp}/NTL_RAW/01-12/Syn/part2.csv",
          ",".join(MASTER_HEADER[:width - 1] + ["Label"]) + "\n" + row("c", ATT) + "\n")
    res = jobs.label_positional_flows(spark, f"{tmp}/NTL_RAW", ATT)
    got = sorted((r.flow_id, r.label) for r in res.flows.collect())
    assert got == [("a", "Syn"), ("b", "BENIGN"), ("c", "Syn")]
    assert MASTER_HEADER[width - 2] in res.flows.columns
    assert MASTER_HEADER[width - 1] not in res.flows.columns


def test_label_extractor_c(spark, tmp):
    body = ("flow_id,timestamp,src_ip,src_port,dst_ip,dst_port,protocol,label,"
            "dns_q,f1,f2,f3\n"
            f"x1,t,{ATT},1,10.0.0.1,53,17,BENIGN,not a dns flow,1e3,inf,1d\n"
            f"x2,t,unknown,1,10.0.0.1,53,17,BENIGN,Unknown,nan,,-inf\n"
            f"x3,t,{ATT},1,10.0.0.1,53,17,BENIGN,not a complete handshake,2,3,4\n")
    write(f"{tmp}/AL_RAW/01-12/DNS/DNS.csv", body)
    write(f"{tmp}/AL_RAW/01-12/DrDoS_DNS/DrDoS_DNS.csv", body.split("\n")[0] + "\n")  # header only
    res = jobs.label_header_flows(spark, f"{tmp}/AL_RAW", ATT, style="C")
    rows = {r.flow_id: r for r in res.flows.collect()}
    assert set(rows) == {"x1", "x2", "x3"}
    assert rows["x1"].label == "DrDoS_DNS" and rows["x2"].label == "BENIGN"
    assert rows["x2"].src_ip == "0"
    assert (rows["x1"].dns_q, rows["x1"].f1, rows["x1"].f2, rows["x1"].f3) == (0.0, 1000.0, 0.0, 0.0)
    assert (rows["x2"].dns_q, rows["x2"].f1, rows["x2"].f2) == (0.0, 0.0, 0.0)
    assert rows["x1"]._extractor_label == "BENIGN"


def test_consolidate(spark, tmp):
    write(f"{tmp}/CIC_RAW/01-12/Syn/frag_b.csv", "Src IP,Flow Duration\n1.1.1.1,5\n")
    write(f"{tmp}/CIC_RAW/01-12/Syn/frag_a.csv", "Flow Duration,Src IP\n6,2.2.2.2\n")
    write(f"{tmp}/CIC_RAW/01-12/Syn/monitor_x.csv", "timestamp,cpu_percent,ram_mb\n1,2,3\n")
    out = f"{tmp}/merged"
    m = jobs.consolidate_fragments(spark, f"{tmp}/CIC_RAW", out=out)
    assert sorted((r.src_ip, r.flow_duration) for r in m.collect()) == [("1.1.1.1", "5"),
                                                                        ("2.2.2.2", "6")]
    assert spark.read.option("header", True).csv(out).count() == 2


def test_reports(spark, tmp):
    interim = f"{tmp}/interim"
    for ext, tool in (("CIC_RAW", "CICFlowMeter"), ("NTL_RAW", "NTLFlowLyzer")):
        for att, rows in (("Syn", [(1, 10.0, 1000.0), (2, 20.0, 3000.0)]), ("DNS", [(1, 5.0, 50.0)])):
            mon = f"{interim}/{ext}/01-12/{att}/monitor_01-12_{att}.csv"
            samples(mon, rows)
            run_log(f"{interim}/{ext}/01-12/{att}/benchmark_01-12_{att}.json",
                    attack=f"01-12_{att}", tool=tool, total_packets=1000, time_seconds=2.0,
                    pps=500.0, monitor_file=mon)
    run_log(f"{interim}/AL_RAW/01-12/DNS/benchmark_01-12_DNS.json", total_packets=10,
            time_seconds=0.0, pps=0.0, monitor_file="/missing.csv")
    out = f"{tmp}/figures"
    views = jobs.run_report(spark, interim, out=out)
    d = {(r.extractor, r.attack): r for r in views["benchmark_detailed"].collect()}
    assert d[("CICFlowMeter", "01-12_Syn")].max_ram == 3000.0
    assert d[("CICFlowMeter", "01-12_Syn")].var_cpu == 50.0
    assert d[("CICFlowMeter", "01-12_DNS")].std_cpu == 0.0          # one sample
    assert d[("ALFlowLyzer", "01-12_DNS")].avg_cpu == 0.0            # missing monitor
    assert views["head_to_head_cic_ntl_syn"].count() == 2
    assert views["benchmark_dns_only"].count() == 3
    back = read_detail(spark, f"{out}/benchmark_detailed")
    assert back.count() == 5
    roll = {r.extractor: r for r in jobs.extractor_report(views["benchmark_detailed"])
            ["benchmark_table_geral"].collect()}
    assert roll["CICFlowMeter"].total_packets == 2000 and roll["CICFlowMeter"].pps == 500.0
    assert roll["ALFlowLyzer"].pps is None


def test_capture_inventory_and_batches(spark, tmp):
    capture(f"{tmp}/PCAP/01-12/Syn/a.pcap", "<", 5, ts0=10)
    capture(f"{tmp}/PCAP/01-12/Syn/b.pcap", ">", 7, ts0=12)
    capture(f"{tmp}/PCAP/03-11/DNS/c.pcap", "<", 0, magic=b"junk")
    files, per = jobs.capture_inventory(spark, f"{tmp}/PCAP")
    got = {r.attack: (r.total_packets, r.failed_files) for r in per.collect()}
    assert got == {"01-12_Syn": (12, 0), "03-11_DNS": (0, 1)}
    b = jobs.packet_batches(spark, f"{tmp}/PCAP", 5)
    sizes = sorted(r["count"] for r in b.groupBy("directory", "batch_id").count().collect())
    assert sizes == [2, 5, 5]


def _flow_csv(path, n, seed, attack_rate):
    rnd = random.Random(seed)
    lines = ["src_ip,dst_ip,timestamp,flow_duration,pkt_rate,proto_name,label"]
    for i in range(n):
        attack = rnd.random() < attack_rate
        dur = rnd.gauss(5 if attack else 50, 2)
        rate = rnd.gauss(900 if attack else 100, 30)
        proto = rnd.choice(["udp", "tcp"]) if not attack else "udp"
        lines.append(f"{ATT if attack else '10.0.0.9'},10.0.0.1,t{i},{dur:.3f},{rate:.2f},"
                     f"{proto},{'Syn' if attack else 'BENIGN'}")
    write(path, "\n".join(lines) + "\n")


def test_extractor_benchmark_and_views(spark, tmp):
    root = f"{tmp}/processed"
    _flow_csv(f"{root}/CIC/01-12/Syn/Syn.csv", 300, 1, 0.4)
    _flow_csv(f"{root}/CIC/03-11/Syn/Syn.csv", 200, 2, 0.5)
    _flow_csv(f"{root}/AL/01-12/DNS/DrDoS_DNS.csv", 300, 3, 0.3)
    _flow_csv(f"{root}/NTL/01-12/LDAP/LDAP.csv", 50, 4, 0.0)        # one class: skipped
    out = f"{tmp}/figures/ml_metrics"
    metrics, ranks, skipped = jobs.extractor_benchmark(
        spark, root, attacks=["DNS", "LDAP", "Syn"], out=out)
    m = {(r.Extractor, r.Attack): r for r in metrics.collect()}
    assert set(m) == {("CIC", "Syn"), ("AL", "DNS")}
    assert m[("CIC", "Syn")].Strategy == "Real" and m[("AL", "DNS")].Strategy == "Split"
    for r in m.values():
        assert 0.9 <= r["F1-Score"] <= 1.0
    assert skipped == [("NTL", "LDAP", "invalid training data or fewer than 2 classes")]
    top = ranks.collect()[0].top_features
    assert "(" in top and "±" in top
    assert not any(k in top for k in ("src_ip", "timestamp", "label"))
    back = read_metrics(spark, out)
    assert back.count() == 2
    view = jobs.f1_view(back, bootstrap=20)
    assert {r.Scenario for r in view.collect()} == {"Syn (Estado Fechado)"}


def test_run_quality(spark, tmp):
    write(f"{tmp}/CIC_RAW/a/jvm_stderr_a.pcap.log", "Exception: java.lang.OutOfMemoryError\n")
    write(f"{tmp}/CIC_RAW/b/jvm_stderr_b.pcap.log", "some warning\n")
    status = spark.createDataFrame([("r1", True), ("r1", True), ("r2", False)],
                                   "run string, ok boolean")
    q = jobs.run_quality(spark, status, f"{tmp}/CIC_RAW")
    assert [r.run for r in q["passing_runs"].collect()] == ["r1"]
    sev = sorted((os.path.basename(r.file), r.severity) for r in q["log_triage"].collect())
    assert sev == [("jvm_stderr_a.pcap.log", "alert"), ("jvm_stderr_b.pcap.log", "warning")]


def test_sample_file_edge_cases(spark, tmp):
    interim = f"{tmp}/interim"
    write(f"{interim}/CIC_RAW/d/a/monitor_a.csv", "timestamp,cpu_percent,ram_mb\n")   # header only
    samples(f"{interim}/CIC_RAW/d/b/monitor_b.csv", [(1.0, 50.0, 512.0)])             # one row
    for name in ("a", "b", "c"):                                                      # c: no file
        run_log(f"{interim}/CIC_RAW/d/{name}/benchmark_{name}.json", attack=name,
                tool="CICFlowMeter", total_packets=10, time_seconds=1.0, pps=10.0,
                monitor_file=f"{interim}/CIC_RAW/d/{name}/monitor_{name}.csv")
    d = {r.attack: r for r in jobs.run_report(spark, interim)["benchmark_detailed"].collect()}
    for name in ("a", "c"):
        assert (d[name].avg_cpu, d[name].max_ram, d[name].std_ram, d[name].var_cpu) == (0, 0, 0, 0)
    assert (d["b"].avg_cpu, d["b"].max_ram, d["b"].std_cpu, d["b"].var_ram) == (50.0, 512.0, 0, 0)


def test_run_log_keys_missing_in_turn(spark, tmp):
    full = dict(attack="x", tool="CICFlowMeter", total_packets=7, time_seconds=2.0, pps=3.5,
                monitor_file="/none.csv")
    for k in full:
        fields = {kk: v for kk, v in full.items() if kk != k}
        run_log(f"{tmp}/CIC_RAW/no_{k}/benchmark_no_{k}.json", **fields)
    d = {r.log_path.rsplit("/", 2)[-2]: r for r in read_runs(spark, tmp).collect()}
    assert d["no_attack"].attack == "no_attack"                 # from the file name
    assert d["no_tool"].extractor == "CICFlowMeter"              # from the path (CIC_RAW)
    assert d["no_total_packets"].total_packets is None
    rows = jobs.run_report(spark, tmp)["benchmark_detailed"].collect()
    assert {r.packets for r in rows} == {0, 7} and {r.time_s for r in rows} == {0.0, 2.0}


def test_f1_view_cases(spark):
    rows = [("CIC", "UDPLag", 0.5), ("NTL", "UDP", 0.6), ("CIC", "Syn", 0.9), ("AL", "Syn", 0.7),
            ("AL", "udp", 0.4), ("CIC", None, 1.0), ("NTL", "LDAP", 0.8), ("NTL", "DNS", 0.3)]
    m = spark.createDataFrame(rows, "Extractor string, Attack string, `F1-Score` double")
    got = {(r.Scenario, r.Extractor): round(r.mean_f1, 6) for r in jobs.f1_view(m).collect()}
    assert got == {("UDP (Stateless)", "NTL"): 0.6, ("Syn (Estado Fechado)", "CIC"): 0.9,
                   ("Syn (Estado Fechado)", "AL"): 0.7, ("udp", "AL"): 0.4,
                   ("LDAP (Stateless)", "NTL"): 0.8}


def test_test_set_uses_training_kinds_and_codes(spark):
    train = spark.createDataFrame([("udp", "1.5", "BENIGN"), ("tcp", "2.5", "Syn")],
                                  "proto_name string, rate string, label string")
    test = spark.createDataFrame([("6", "3.5", "Syn"), ("udp", "x", "BENIGN")],
                                 "proto_name string, rate string, label string")
    tr = jobs.prepare_training_set(train, exclude=())
    assert tr.kinds == {"proto_name": "categorical", "rate": "numeric"}
    te = jobs.prepare_training_set(test, exclude=(), dictionary=tr.dictionary, kinds=tr.kinds)
    got = sorted((r.proto_name, r.rate, r.target) for r in te.data.collect())
    # '6' was never seen in training: extra code 2; 'udp' keeps its code 1;
    # 'x' in a numeric column becomes 0
    assert got == [(1.0, 0.0, 0), (2.0, 3.5, 1)]


def test_split_scenario_with_single_member_class_is_skipped(spark, tmp):
    root = f"{tmp}/processed"
    rows = ["src_ip,flow_duration,label", f"{ATT},1.0,Syn"] + \
        [f"10.0.0.{i},{i}.5,BENIGN" for i in range(2, 40)]
    write(f"{root}/AL/01-12/DNS/DrDoS_DNS.csv", "\n".join(rows) + "\n")
    metrics, _, skipped = jobs.extractor_benchmark(spark, root, attacks=["DNS"],
                                                   extractors=["AL"])
    assert metrics.count() == 0
    assert skipped == [("AL", "DNS", "a class has a single member")]


def test_readme_workflow(spark, tmp):
    """The four steps exactly as the README shows them, on a fixture tree."""
    d = f"{tmp}/data"
    capture(f"{d}/raw/PCAP/01-12/Syn/a.pcap", "<", 5)
    capture(f"{d}/raw/PCAP/03-11/Syn/b.pcap", ">", 3)
    for day, seed in (("01-12", 1), ("03-11", 2)):
        _flow_csv(f"{d}/interim/CIC_RAW/{day}/Syn/part.csv", 120, seed, 0.4)
        mon = f"{d}/interim/CIC_RAW/{day}/Syn/monitor_{day}_Syn.csv"
        samples(mon, [(1.0, 10.0, 100.0), (2.0, 20.0, 200.0)])
        run_log(f"{d}/interim/CIC_RAW/{day}/Syn/benchmark_{day}_Syn.json", attack=f"{day}_Syn",
                tool="CICFlowMeter", total_packets=8, time_seconds=2.0, pps=4.0,
                monitor_file=mon)
    row = lambda fid, src: ",".join([fid, "t", src] + ["1"] * 16 + ["BENIGN"])
    write(f"{d}/interim/NTL_RAW/01-12/Syn/p.csv", row("a", ATT) + "\n" + row("b", "9.9.9.9") + "\n")
    write(f"{d}/interim/AL_RAW/01-12/DNS/p.csv",
          "flow_id,timestamp,src_ip,label,f1\nx,t," + ATT + ",BENIGN,inf\n")
    # the README's relative paths, rooted at the fixture folder (Spark resolves
    # relative paths in the JVM's working directory)
    files, per_attack = jobs.capture_inventory(spark, f"{d}/raw/PCAP")
    assert {r.attack: r.total_packets for r in per_attack.collect()} == \
        {"01-12_Syn": 5, "03-11_Syn": 3}
    jobs.consolidate_fragments(spark, f"{d}/interim/CIC_RAW", out=f"{d}/interim/CIC_merged")
    jobs.label_header_flows(spark, f"{d}/interim/CIC_RAW", ATT, style="A",
                            out=f"{d}/processed/CIC")
    jobs.label_positional_flows(spark, f"{d}/interim/NTL_RAW", ATT, out=f"{d}/processed/NTL")
    jobs.label_header_flows(spark, f"{d}/interim/AL_RAW", ATT, style="C",
                            out=f"{d}/processed/AL")
    metrics, rankings, skipped = jobs.extractor_benchmark(
        spark, f"{d}/processed", fmt="parquet", match_on="attack",
        out=f"{tmp}/results/ml_metrics")
    m = {(r.Extractor, r.Attack): r.Strategy for r in metrics.collect()}
    assert m[("CIC", "Syn")] == "Real"                  # day 1 -> day 2 from the sink layout
    views = jobs.run_report(spark, f"{d}/interim", out=f"{tmp}/results/figures")
    assert views["benchmark_detailed"].count() == 2
    assert jobs.extractor_report(views["benchmark_detailed"])[
        "benchmark_table_geral"].first().total_packets == 16
    assert jobs.f1_view(metrics).count() >= 1


def test_collapse_report_and_capture_helpers(spark, tmp):
    from flowforge.operators import matching
    from flowforge.sources import pcap
    from flowforge.sources.catalogue import catalogue
    capture(f"{tmp}/PCAP/01-12/Syn/a.pcap", "<", 4)
    capture(f"{tmp}/PCAP/03-11/Syn/b.pcap", "<", 2)
    capture(f"{tmp}/PCAP/03-11/DNS/c.pcap", "<", 1)
    pk = pcap.read_packets(spark, f"{tmp}/PCAP")
    assert {r["attack"]: r["count"] for r in pk.groupBy("attack").count().collect()} == \
        {"01-12_Syn": 4, "03-11_Syn": 2, "03-11_DNS": 1}
    dirs = matching.capture_directories(
        catalogue(spark, f"{tmp}/PCAP", glob="*.pcap", exclude_prefixes=()))
    listed = [r.parent_dir.split("PCAP/")[1] for r in dirs.collect()]
    assert listed == ["01-12/Syn", "03-11/DNS", "03-11/Syn"]         # distinct and sorted
    # Flows per extractor for the keyword, peak RAM, packets from captures
    write(f"{tmp}/CIC_RAW/01-12/Syn/Syn.csv", "Src IP,Label\n1.1.1.1,x\n2.2.2.2,y\n")
    write(f"{tmp}/CIC_RAW/03-11/Syn/Syn.csv", "Src IP,Label\n3.3.3.3,z\n")
    write(f"{tmp}/NTL_RAW/01-12/Syn/syn_part.csv", "a,t,1.1.1.1,BENIGN\n")
    detail = spark.createDataFrame(
        [("CICFlowMeter", "01-12_Syn", 10, 2048.0), ("CICFlowMeter", "03-11_Syn", 5, 1024.0),
         ("NTLFlowLyzer", "01-12_Syn", 7, 4096.0), ("NTLFlowLyzer", "01-12_DNS", 9, 9999.0)],
        "extractor string, attack string, packets long, max_ram double")
    view = jobs.collapse_report(spark, {"CICFlowMeter": f"{tmp}/CIC_RAW",
                                        "NTLFlowLyzer": f"{tmp}/NTL_RAW"}, detail,
                                captures_root=f"{tmp}/PCAP", keyword="syn")
    got = {r.extractor: (r.flows_m, r.peak_ram_gb, r.packets_m) for r in view.collect()}
    assert got == {"CICFlowMeter": (3e-6, 2.0, 6e-6), "NTLFlowLyzer": (1e-6, 4.0, 6e-6)}
    # without captures the packet total falls back to the detail table
    view2 = jobs.collapse_report(spark, {"CICFlowMeter": f"{tmp}/CIC_RAW"}, detail,
                                 keyword="syn")
    assert view2.first().packets_m == 22e-6


def test_f1_view_bootstrap_interval(spark):
    rows = [("CIC", "Syn", v) for v in (0.2, 0.4, 0.6, 0.8)] + [("NTL", "Syn", 0.5)]
    m = spark.createDataFrame(rows, "Extractor string, Attack string, `F1-Score` double")
    got = {r.Extractor: r for r in jobs.f1_view(m, bootstrap=200, seed=3).collect()}
    cic, ntl = got["CIC"], got["NTL"]
    assert abs(cic.mean_f1 - 0.5) < 1e-12 and 0.2 <= cic.ci_low < 0.5 < cic.ci_high <= 0.8
    assert ntl.ci_low == ntl.ci_high == 0.5          # one value: a degenerate interval
    again = {r.Extractor: r for r in jobs.f1_view(m, bootstrap=200, seed=3).collect()}
    assert again["CIC"].ci_low == cic.ci_low          # seeded: reproducible
