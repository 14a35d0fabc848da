"""No silent loss: files and rows that can't be read are reported, paths are
decoded, and one sink never changes another."""

import json
import os

import pytest

from flowforge.functions.schema import MASTER_HEADER
from flowforge.plans import jobs
from flowforge.session import ensure_checkpoint_dir
from flowforge.sinks import writers
from flowforge.sources import pcap
from flowforge.sources.catalogue import catalogue, read_first_line
from flowforge.sources.flows import header_groups, positional_groups, read_header_flows
from flowforge.sources.runs import read_runs, read_samples

from .fixtures import capture


def put(root, rel, text):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_blank_first_lines_are_skipped_not_the_file(spark, tmp):
    put(tmp, "t/01-12/Syn/a.csv", "\n\nsrc_ip,x\n1.1.1.1,2\n")
    put(tmp, "t/01-12/Syn/b.csv", "src_ip,x\n1.1.1.2,3\n")
    res = jobs.label_header_flows(spark, tmp, "1.1.1.1")
    assert sorted((r.src_ip, r.x, r.label) for r in res.flows.collect()) == [("1.1.1.1", "2", "Syn"), ("1.1.1.2", "3", "BENIGN")]


def test_wide_positional_files_are_reported(spark, tmp):
    good = ",".join(["f", "t", '"10,0"', "1"] + ["0"] * 8) + ",Label\n"
    put(tmp, "t/01-12/Syn/good.csv", good)
    wide = put(tmp, "t/01-12/Syn/wide.csv", ",".join(["0"] * (len(MASTER_HEADER) + 5)) + "\n")
    res = jobs.label_positional_flows(spark, tmp, "1.1.1.1")
    assert [p.endswith(os.path.basename(wide)) for p, _ in res.skipped] == [True]
    row = res.flows.first()
    assert row.src_ip == "10,0" and "bwd_packets_count" in res.flows.columns  # the quoted comma is no field


def test_positional_width_respects_quotes(spark, tmp):
    put(tmp, "a/x.csv", 'a,"b,c",d\n')
    assert [(w, h) for w, h, _ in positional_groups(catalogue(spark, tmp))] == [(3, False)]


def test_many_files_of_three_headers(spark, tmp):
    for i in range(60):
        head = ["a,b", "b,a", "a,b,c"][i % 3]
        put(tmp, f"t/01-12/Syn/f{i}.csv", head + "\n" + ",".join(str(i) for _ in head.split(",")) + "\n")
    cat = catalogue(spark, tmp)
    assert [len(paths) for _, paths in header_groups(cat)] == [20, 20, 20]
    assert sorted(int(r.a) for r in read_header_flows(spark, cat).collect()) == list(range(60))


def test_unreadable_files_and_endless_headers_are_errors(tmp):
    with pytest.raises(OSError):
        read_first_line("file:" + os.path.join(tmp, "missing.csv"))
    with pytest.raises(ValueError):
        read_first_line("file:" + put(tmp, "long.csv", "x," * 1000), max_bytes=100)


def test_an_unreadable_capture_is_an_error(spark, tmp):
    capture(f"{tmp}/PCAP/01-12/Syn/a.pcap", "<", 3)
    reader = pcap.CapturePackets({"path": f"{tmp}/PCAP"}).reader(None)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3
    gone = pcap._FilePartition(f"{tmp}/PCAP/01-12/Syn/gone.pcap")
    with pytest.raises(OSError):
        list(reader.read(gone))
    files = pcap.CaptureFiles({"path": f"{tmp}/PCAP"}).reader(None)
    assert [row[3] for row in files.read(gone)] == ["error"]


def test_paths_with_spaces_and_deep_days(spark, tmp):
    root = os.path.join(tmp, "data set+1")
    put(root, "CIC_RAW/x/y/z/w/03-11/Syn Flood/a.csv", "src_ip,x\n1.1.1.1,2\n")
    r = jobs.label_header_flows(spark, root, "1.1.1.1").flows.first()
    assert (r.extractor, r.day, r.attack, r.label) == ("CIC", "03-11", "Syn Flood", "Syn Flood")


def test_run_report_under_a_path_with_a_space(spark, tmp):
    root = os.path.join(tmp, "data set")
    samples = put(root, "CIC/monitor_Syn.csv", "timestamp,cpu_percent,ram_mb\n1,10.0,100.0\n2,30.0,300.0\n")
    put(root, "CIC/benchmark_Syn.json", json.dumps({"attack": "Syn", "tool": "CIC", "total_packets": 10, "time_seconds": 2.0, "pps": 5.0, "monitor_file": samples}))
    assert read_runs(spark, root).first().monitor_key == read_samples(spark, root).first().monitor_key
    row = jobs.run_report(spark, root)["benchmark_detailed"].first()
    assert row.avg_cpu == 20.0 and row.max_ram == 300.0 and row.var_cpu == 200.0


def test_labelled_sink_leaves_the_run_log_sink_alone(spark, tmp):
    runs = spark.createDataFrame([("Syn", "A", 1, 1.0, 1.0, "m")], "attack string, tool string, total_packets long, time_seconds double, pps double, monitor_file string")
    other = runs.selectExpr("attack", "'B' AS tool", "total_packets", "time_seconds", "pps", "monitor_file")
    flows = spark.createDataFrame([("x", "A", "01-12", "Syn")], "v string, extractor string, day string, attack string")
    writers.write_run_logs(runs, f"{tmp}/logs")
    writers.write_labelled(flows, f"{tmp}/flows")
    writers.write_labelled(flows.selectExpr("v", "extractor", "'03-11' AS day", "attack"), f"{tmp}/flows")
    writers.write_run_logs(other, f"{tmp}/logs")
    assert {d for d in os.listdir(f"{tmp}/logs") if d.startswith("tool=")} == {"tool=B"}
    assert spark.read.parquet(f"{tmp}/flows").count() == 2  # only the partitions present are replaced


def test_semlabel_files_are_not_counted(spark, tmp):
    put(tmp, "raw/01-12/Syn/Syn_a.csv", "src_ip,x\n1,2\n")
    put(tmp, "raw/01-12/Syn/Syn_semlabel.csv", "src_ip,x\n1,2\n3,4\n")
    detail = spark.createDataFrame([("CIC", "Syn", 5, 100.0)], "extractor string, attack string, packets long, max_ram double")
    assert jobs.collapse_report(spark, {"CIC": f"{tmp}/raw"}, detail).first().flows_m == 1e-6


def test_an_earlier_result_is_no_fragment(spark, tmp):
    put(tmp, "t/Syn/part1.csv", "a,b\n1,2\n")
    put(tmp, "t/Syn/Syn.csv", "a,b\n1,2\n")
    assert jobs.consolidate_fragments(spark, tmp).count() == 1


def test_test_rows_are_all_scored(spark):
    rows = [(str(i), "Syn" if i % 2 else "BENIGN") for i in range(500)]
    df = spark.createDataFrame(rows, "f1 string, label string")
    kinds = {"f1": "numeric"}
    assert jobs.prepare_training_set(df, kinds=kinds, materialize=False).data.count() == 500


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_scratch_folders_go_with_their_scope(spark):
    from flowforge.session import scratch_path, scratch_scope, written_in_scope

    base = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "scratch")

    def folders():
        return set(os.listdir(base)) if os.path.isdir(base) else set()

    before = folders()

    def make():
        spark.range(5).write.parquet(scratch_path(spark, "inner"))
        with scratch_scope(spark):
            spark.range(5).write.parquet(scratch_path(spark, "innermost"))
        assert {f.rsplit("-", 1)[0] for f in folders() - before} == {"inner"}
        return spark.range(7)

    out = written_in_scope(spark, "kept", make)
    assert out.count() == 7 and {f.rsplit("-", 1)[0] for f in folders() - before} == {"kept"}
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        spark.range(5).write.parquet(scratch_path(spark, "failed"))
        raise ZeroDivisionError
    assert {f.rsplit("-", 1)[0] for f in folders() - before} == {"kept"}
