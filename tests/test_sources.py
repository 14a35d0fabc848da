"""File sources on fixtures built in fresh temporary folders."""

import os

from pyspark.sql import functions as F

from flowforge.functions.schema import MASTER_HEADER
from flowforge.sources import pcap
from flowforge.sources.catalogue import catalogue
from flowforge.sources.flows import (attach_path_meta, header_groups, read_header_csv,
                                     read_header_flows,
                                     read_positional_flows, rejected_rows)
from flowforge.sources.runs import read_runs, read_samples
from flowforge.session import qualify

from .fixtures import capture, run_log, samples, write


def test_catalogue_layout_and_exclusions(spark, tmp):
    write(f"{tmp}/CIC_RAW/01-12/Syn/Syn.csv", "a\n1\n")
    write(f"{tmp}/CIC_RAW/01-12/Syn/monitor_01-12_Syn.csv", "t\n1\n")
    write(f"{tmp}/CIC_RAW/03-11/DNS/x_semlabel.csv", "a\n1\n")
    write(f"{tmp}/CIC_RAW/03-11/DNS/empty.csv", "")
    write(f"{tmp}/CIC_RAW/03-11/DNS/notes.txt", "x")
    cat = catalogue(spark, tmp, exclude_contains=("semlabel",))
    rows = {r.file_name: r for r in cat.collect()}
    assert set(rows) == {"Syn.csv"}
    r = rows["Syn.csv"]
    assert (r.extractor, r.day, r.attack, r.rel_path) == ("CIC", "01-12", "Syn",
                                                          "CIC_RAW/01-12/Syn/Syn.csv")
    assert r.length == 4


def test_header_scan_tolerance(spark, tmp):
    body = ("Src IP, Dst IP ,Flow Duration,Flow Bytes/s,Label\n"
            "172.16.0.5,10.0.0.1,5,NaN,BENIGN\n"
            "10.0.0.2,10.0.0.1,7\n"                       # short row: kept, padded
            "10.0.0.3,10.0.0.1,1,2,x,EXTRA\n"             # long row: dropped
            "10.0.0.4,\"10.0.0.1,9\",3,Infinity,BENIGN\n"  # quoted comma
            ",10.0.0.1,4,1.5,BENIGN\n")                   # null source
    write(f"{tmp}/A/01-12/Syn/Syn.csv", body)
    flows = read_header_flows(spark, catalogue(spark, tmp))
    assert flows.columns[:5] == ["src_ip", "dst_ip", "flow_duration", "flow_bytes/s", "label"]
    rows = flows.orderBy("flow_duration").collect()
    assert len(rows) == 4
    by = {r.flow_duration: r for r in rows}
    assert by["7"].label is None and by["7"]["flow_bytes/s"] is None
    assert by["3"].dst_ip == "10.0.0.1,9"
    assert by["4"].src_ip is None
    rej = [(os.path.basename(r.source_file), r.rejected)
           for r in rejected_rows(spark, catalogue(spark, tmp)).collect()]
    assert rej == [("Syn.csv", 1)]


def test_header_drift_is_bound_by_name(spark, tmp):
    write(f"{tmp}/A/01-12/Syn/p1.csv", "Src IP,Flow Duration,Label\n1.1.1.1,5,x\n")
    write(f"{tmp}/A/01-12/Syn/p2.csv", "Flow Duration,Src IP,Label\n6,2.2.2.2,y\n")
    cat = catalogue(spark, tmp)
    assert len(header_groups(cat)) == 2
    flows = read_header_flows(spark, cat)
    got = sorted((r.src_ip, r.flow_duration) for r in flows.collect())
    assert got == [("1.1.1.1", "5"), ("2.2.2.2", "6")]


def test_positional_binding(spark, tmp):
    full = ",".join(["f"] * 272 + ["BENIGN"])
    narrow = "id1,ts,172.16.0.5,1,10.0.0.1,2,6,0.5,BENIGN"        # 8 features + dummy
    stray = "flow_id,timestamp,src_ip,src_port,dst_ip,dst_port,protocol,duration,Label"
    write(f"{tmp}/B/01-12/Syn/full.csv", full + "\n" + full + "\n")
    write(f"{tmp}/B/01-12/Syn/narrow.csv", narrow + "\n" + narrow.replace("id1", "id2") + "\n"
          + narrow + ",9\n")                                      # long row dropped
    write(f"{tmp}/B/03-11/DNS/stray.csv", stray + "\n" + narrow.replace("id1", "id3") + "\n")
    flows = read_positional_flows(spark, catalogue(spark, tmp))
    assert set(flows.columns) - {"source_file"} == set(MASTER_HEADER)
    assert flows.count() == 2 + 2 + 1
    ids = sorted(r.flow_id for r in flows.filter(F.col("duration") == "0.5").collect())
    assert ids == ["id1", "id2", "id3"]
    meta = attach_path_meta(flows, qualify(spark, tmp))
    assert sorted({(r.day, r.attack) for r in meta.collect()}) == [("01-12", "Syn"),
                                                                    ("03-11", "DNS")]


def test_run_logs_and_samples(spark, tmp):
    mon = f"{tmp}/interim/CIC_RAW/01-12/Syn/monitor_01-12_Syn.csv"
    samples(mon, [(1.0, 10.0, 100.0), (2.0, 30.0, 300.0)])
    run_log(f"{tmp}/interim/CIC_RAW/01-12/Syn/benchmark_01-12_Syn.json",
            attack="01-12_Syn", tool="CICFlowMeter", total_packets=100, time_seconds=4.0,
            pps=25.0, monitor_file=mon)
    # every key missing except a relative monitor path; tool from the path
    samples(f"{tmp}/interim/NTL_RAW/03-11/DNS/monitor_x.csv", [(1.0, 5.0, 50.0)])
    run_log(f"{tmp}/interim/NTL_RAW/03-11/DNS/benchmark_03-11_DNS.json",
            monitor_file="./interim/NTL_RAW/03-11/DNS/monitor_x.csv")
    # monitor file missing entirely
    run_log(f"{tmp}/interim/AL_RAW/x/benchmark_q.json", tool="ALFlowLyzer", time_seconds=0,
            monitor_file="/nowhere/monitor.csv")
    runs = read_runs(spark, f"{tmp}/interim", base_dir=tmp)
    got = {r.attack: r for r in runs.collect()}
    assert got["01-12_Syn"].extractor == "CICFlowMeter"
    assert got["03-11_DNS"].extractor == "NTLFlowLyzer" and got["03-11_DNS"].total_packets is None
    assert got["q"].time_seconds == 0.0
    s = read_samples(spark, f"{tmp}/interim")
    keys = {r.monitor_key for r in s.collect()}
    assert got["01-12_Syn"].monitor_key in keys and got["03-11_DNS"].monitor_key in keys
    assert got["q"].monitor_key not in keys


def test_captures(spark, tmp):
    capture(f"{tmp}/PCAP/01-12/Syn/a.pcap", "<", 5)
    capture(f"{tmp}/PCAP/01-12/Syn/b.pcap", ">", 7)
    capture(f"{tmp}/PCAP/03-11/DNS/c.pcap", "<", 3, cut_last=True)
    capture(f"{tmp}/PCAP/03-11/DNS/d.pcap", "<", 0, magic=bytes.fromhex("0a0d0d0a"))
    capture(f"{tmp}/PCAP/03-11/DNS/e.pcap", "<", 0, header_only=True)
    write(f"{tmp}/PCAP/03-11/DNS/short.pcap", "\xd4\xc3")          # missing header bytes
    files = {os.path.basename(r.file): r for r in pcap.read_capture_files(spark, f"{tmp}/PCAP")
             .collect()}
    assert {k: v.packets for k, v in files.items()} == {
        "a.pcap": 5, "b.pcap": 7, "c.pcap": 3, "d.pcap": 0, "e.pcap": 0, "short.pcap": 0}
    assert files["d.pcap"].status == "bad_magic" and files["b.pcap"].byte_order == "big"
    pk = pcap.read_packets(spark, f"{tmp}/PCAP")
    per = {r.attack: r["count"] for r in pk.groupBy("attack").count().collect()}
    assert per == {"01-12_Syn": 12, "03-11_DNS": 3}
    assert pk.filter("truncated").count() == 1


def test_tolerant_scan_matches_pandas_bad_line_skip(spark, tmp):
    """S2 keeps and drops exactly the rows pandas keeps with
    on_bad_lines='skip' (ragged rows, quoted commas, escaped quotes, empty
    extra fields); the first data row is never long (see Q28)."""
    import random
    import pandas as pd
    rnd = random.Random(11)
    vals = ["1", "x", "", '"a,b"', '""', "2.5", " y ", "NaN", '"q""r"']
    key = lambda t: tuple("\0" if v is None else v for v in t)
    for t in range(25):
        lines = ["h1,h2,h3,h4"]
        for r in range(rnd.randint(1, 12)):
            n = rnd.choice([1, 2, 3, 4, 4, 4, 5, 6]) if r > 0 else rnd.choice([2, 3, 4])
            lines.append(",".join(rnd.choice(vals) for _ in range(n)))
        path = write(f"{tmp}/r/f{t}.csv", "\n".join(lines) + "\n")
        p = pd.read_csv(path, on_bad_lines="skip", dtype=str, keep_default_na=False)
        exp = sorted((tuple(None if v == "" else v for v in row)
                      for row in p.itertuples(index=False)), key=key)
        got = sorted((tuple(None if v == "" else v for v in r)[:4] for r in
                      read_header_csv(spark, [path], ["h1", "h2", "h3", "h4"]).collect()), key=key)
        assert exp == got, "\n".join(lines)


def test_scan_with_only_file_metadata_selected(spark, tmp):
    write(f"{tmp}/A/01-12/Syn/a.csv", "Src IP,X\n1.1.1.1,5\n2.2.2.2,6,7\n3.3.3.3\n")
    flows = read_header_flows(spark, catalogue(spark, tmp))
    assert flows.select("source_file").count() == 2
    assert rejected_rows(spark, catalogue(spark, tmp)).first().rejected == 1


def test_long_rows_dropped_whatever_the_query_selects(spark, tmp):
    write(f"{tmp}/B/01-12/Syn/n.csv", "a,0.5,x\nb,0.5,y\nc,0.5,z,EXTRA\n")
    flows = read_positional_flows(spark, catalogue(spark, tmp))
    assert flows.filter(F.col("timestamp") == "0.5").select("flow_id").count() == 2
    assert flows.select("source_file").count() == 2


def test_empty_folders(spark, tmp):
    import os
    from flowforge.plans import jobs
    os.makedirs(f"{tmp}/e/sub")
    assert pcap.read_capture_files(spark, f"{tmp}/e").count() == 0
    assert pcap.read_packets(spark, f"{tmp}/e").count() == 0
    assert jobs.run_report(spark, f"{tmp}/e")["benchmark_detailed"].count() == 0
    assert jobs.label_header_flows(spark, f"{tmp}/e").flows is None


def test_record_walk_across_block_boundaries(tmp, monkeypatch):
    """Tiny read blocks: headers and payloads straddle every boundary."""
    monkeypatch.setattr(pcap, "_BLOCK_BYTES", 32)
    a = capture(f"{tmp}/c/a.pcap", "<", 9)
    b = capture(f"{tmp}/c/b.pcap", ">", 4, cut_last=True)
    order, recs = pcap.walk_records(a)
    got = list(recs)
    assert order == "little" and [r[3] for r in got] == [10 + i for i in range(9)]
    assert [r[1] for r in got] == [1000 + i for i in range(9)] and not any(r[5] for r in got)
    order, recs = pcap.walk_records(b)
    got = list(recs)
    assert order == "big" and len(got) == 4 and got[-1][5] and not got[0][5]


def test_header_with_byte_order_mark(spark, tmp):
    path = f"{tmp}/A/01-12/Syn/bom.csv"
    import os
    os.makedirs(os.path.dirname(path))
    with open(path, "wb") as f:
        f.write(b"\xef\xbb\xbfSrc IP,Label\n1.1.1.1,x\n")
    flows = read_header_flows(spark, catalogue(spark, tmp))
    assert flows.columns[:2] == ["src_ip", "label"]
    assert [r.src_ip for r in flows.collect()] == ["1.1.1.1"]
