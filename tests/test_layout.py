"""Training rows, rejects and reports do not depend on how files are cut."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from flowforge.operators import model, sampling, scoring
from flowforge.plans import jobqueries, jobs, support
from flowforge.session import scratch_path
from flowforge.sinks.writers import write_labelled
from flowforge.sources.catalogue import catalogue
from flowforge.sources.flows import rejected_rows
from flowforge.sources.runs import read_detail, read_runs, read_samples, rejected_runs

from .fixtures import run_log, write


def flows(spark, n=4000):
    r = random.Random(4)
    rows = [(str(r.randrange(60)), str(r.randrange(40)), r.choice(["BENIGN", "BENIGN", "Syn"])) for _ in range(n)]
    return spark.createDataFrame(rows + rows[:500] + [("7", None, "Syn")] * 300, "a string, b string, label string")


def test_the_same_rows_are_sampled_and_split_under_any_layout(spark):
    table = flows(spark)
    found = []
    for parts in (1, 3, 8):
        prep = jobs.prepare_training_set(table.repartition(parts), max_train_rows=1500)
        split = sampling.stratified_split(prep.data, "target", "_rowkey").select("a", "b", "target", "_rowkey", "is_test").collect()
        found.append(sorted(map(tuple, split)))
    assert found[0] == found[1] == found[2] and 1300 < len(found[0]) < 1700
    assert len({r[3] for r in found[0]}) == len(found[0])


def test_the_same_forest_under_any_layout(spark):
    table = flows(spark)
    scores = []
    for parts in (1, 3, 8):
        prep = jobs.prepare_training_set(table.repartition(parts))
        train = model.laid_out(sampling.class_weights(prep.data, "target"), 4800, "_rowkey")
        forest = model.fit_forest(model.assemble(train, prep.features), trees=4, depth=4)
        scores.append((scoring.weighted_scores(scoring.confusion(model.predict(forest, model.assemble(prep.data, prep.features)))).first(),
                       forest.featureImportances.toArray().tolist()))
    assert scores[0] == scores[1] == scores[2]


def test_copies_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES", 7)
    rows = [(1, None, float("nan"))] * 23 + [(1, "", 0.0)] * 7 + [(None, None, None)] * 8 + [(2, "x", 1.0)]
    df = spark.createDataFrame(rows, "a int, `b.c` string, d double")
    got = sampling.numbered_copies(df)
    assert got.columns == ["a", "b.c", "d", "_rowkey"] and got.select("_rowkey").distinct().count() == len(rows)
    counts = sorted(r["count"] for r in got.groupBy("a", "`b.c`", "d").count().collect())
    assert counts == [1, 7, 8, 23]
    assert sampling.numbered_copies(df.limit(0)).count() == 0


def test_row_counts_of_the_labelling_jobs(spark, tmp):
    write(f"{tmp}/A/01-12/Syn/a.csv", "Src IP,x\n1.1.1.1,1\n1.1.1.2,2,EXTRA\n1.1.1.3\n")
    write(f"{tmp}/A/01-12/Syn/b.csv", "x,Src IP\n1,1.1.1.1\n1,2,3,4\n")
    write(f"{tmp}/A/01-12/Syn/c.csv", "x,y\n1,1.1.1.1,3\n")
    result = jobs.label_header_flows(spark, f"{tmp}/A", "1.1.1.1", out=f"{tmp}/out")
    assert result.row_counts() == {"rows": 5, "rejected": 2} and len(result.skipped) == 1
    write(f"{tmp}/B/01-12/Syn/n.csv", "a,t,1.1.1.1,x\nb,t,1.1.1.1,y\nc,t,1.1.1.1,z,EXTRA\n")
    write(f"{tmp}/B/01-12/Syn/w.csv", "0," * 400 + "x\n")
    result = jobs.label_positional_flows(spark, f"{tmp}/B", "1.1.1.1", out=f"{tmp}/outb")
    assert result.row_counts() == {"rows": 3, "rejected": 1} and len(result.skipped) == 1
    assert [r.rejected for r in rejected_rows(spark, catalogue(spark, f"{tmp}/B"), positional=True).collect()] == [1]
    assert jobs.label_header_flows(spark, f"{tmp}/A/01-12/none" if os.makedirs(f"{tmp}/A/01-12/none") else f"{tmp}/A/01-12/none").row_counts() == {"rows": 0, "rejected": 0}


def test_report_inputs_are_read_by_name(spark, tmp):
    d = f"{tmp}/CIC_RAW/01-12/Syn"
    write(f"{d}/monitor_a.csv", "timestamp,ram_mb,cpu_percent\n1,600,10\n2,700,30\n")
    write(f"{d}/monitor_b.csv", "timestamp,cpu_percent\n1,5\n")
    run_log(f"{d}/benchmark_a.json", attack="Syn", total_packets=10, time_seconds=2.0, pps=5.0, monitor_file=f"{d}/monitor_a.csv")
    run_log(f"{d}/benchmark_b.json", total_packets=10, time_seconds=2.0, pps=5.0, monitor_file=f"{d}/monitor_b.csv")
    write(f"{d}/benchmark_c.json", '{"attack": "Syn", "time_')
    write(f"{d}/benchmark_d.json", '{"attack": "Syn", "total_packets": "many"}')
    write(f"{d}/benchmark_e.json", "  \n")
    assert read_runs(spark, tmp).count() == 2
    out = f"{tmp}/figures"
    views = jobs.run_report(spark, tmp, out=out)
    detail = [(r.attack, r.avg_cpu, r.max_ram) for r in views["benchmark_detailed"].collect()]
    assert detail == [("Syn", 20.0, 700.0), ("b", 0.0, 0.0)]  # ordered; b's samples are rejected
    rejected = {os.path.basename(r.path): r.reason for r in views["rejected_inputs"].collect()}
    assert set(rejected) == {"benchmark_c.json", "benchmark_d.json", "benchmark_e.json", "monitor_b.csv"}
    assert rejected["monitor_b.csv"] == "no column ram_mb" and rejected["benchmark_e.json"] == "no JSON object"
    assert {os.path.basename(r.path) for r in rejected_runs(spark, tmp).collect()} == set(rejected) - {"monitor_b.csv"}
    with pytest.raises(ValueError, match="no column ram_mb"):
        read_samples(spark, tmp)
    again = read_detail(spark, f"{out}/benchmark_detailed")
    assert [(r.attack, r.avg_cpu, r.max_ram) for r in again.orderBy("attack").collect()] == detail
    turned = again.select(*[F.col(c).alias(n) for c, n in zip(
        ["max_ram", "attack", "extractor", "packets", "time_s", "pps", "avg_cpu", "std_cpu", "var_cpu", "std_ram", "var_ram"],
        ["Max RAM (MB)", "Attack", "Extractor", "Packets", "Time (s)", "Throughput (PPS)", "Avg CPU (%)", "Std CPU", "Var CPU", "Std RAM", "Var RAM"])])
    turned.write.option("header", "true").csv(f"{tmp}/turned")
    assert sorted(map(tuple, read_detail(spark, f"{tmp}/turned").collect())) == sorted(map(tuple, again.collect()))


def test_large_files_are_written_in_pieces(spark, tmp, monkeypatch):
    monkeypatch.setattr(support, "PIECE_ROWS", 50)
    rows = spark.range(700).select(F.concat(F.lit("a/f"), (F.col("id") % 3).cast("string"), F.lit(".csv")).alias("path"),
                                   (1000 - F.col("id")).alias("ord"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("line"))
    support.write_lines(rows, f"{tmp}/whole")
    support.write_large_files(rows, f"{tmp}/pieces")
    for k in range(3):
        with open(f"{tmp}/whole/a/f{k}.csv", "rb") as want, open(f"{tmp}/pieces/a/f{k}.csv", "rb") as got:
            assert want.read() == got.read()
    assert not support.write_large_files(rows.limit(0), f"{tmp}/none").startswith("file:")


def test_a_piece_holds_a_part_of_a_file(spark, tmp, monkeypatch):
    monkeypatch.setattr(support, "PIECE_ROWS", 50)
    sizes = []
    monkeypatch.setattr(support, "cut_lineage", lambda df: sizes.append(df.count()) or df)
    rows = spark.range(700).select(F.lit("f.csv").alias("path"), F.col("id").alias("ord"), F.lit("x").alias("line"))
    support.write_large_files(rows, tmp)
    assert sizes[0] > 5  # one piece per task, not one task per file


def test_kinds_of_all_rows_are_found_without_keys(spark, monkeypatch):
    seen, kinds = [], jobs.clean.column_kinds
    monkeypatch.setattr(jobs.clean, "column_kinds", lambda df, columns: seen.append(df) or kinds(df, columns))
    rows = spark.createDataFrame([("1", "x", "Syn"), ("2", "NA", "BENIGN"), (None, "7", "Syn")] * 20, "a string, b string, label string")
    prep = jobs.prepare_training_set(rows)
    assert prep.kinds == {"a": "numeric", "b": "categorical"} and prep.data.select("_rowkey").distinct().count() == 60
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()  # the pass shuffles no rows
    jobs.prepare_training_set(rows, max_train_rows=30)
    assert seen[1].count() < 60  # of sampled rows, those that are kept


def test_pieces_and_packed_files_are_compressed(spark, tmp, monkeypatch):
    monkeypatch.setattr(support, "PIECE_ROWS", 200)
    rows = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "d/f.csv").otherwise("d/f.csv.gz").alias("path"), F.col("id").alias("ord"),
                                    F.concat(F.col("id").cast("string"), F.repeat(F.lit(",0"), F.lit(300))).alias("line"))
    want = [r["line"] + "\n" for r in rows.sort("ord").collect()]
    sizes = []

    def collected(df):
        found = df.collect()
        sizes.extend(os.path.getsize(r["piece"]) for r in found)
        return spark.createDataFrame(found, df.schema)

    monkeypatch.setattr(support, "cut_lineage", collected)
    support.write_large_files(rows, tmp)
    with open(f"{tmp}/d/f.csv", encoding="utf-8") as plain, gzip.open(f"{tmp}/d/f.csv.gz", "rt") as packed:
        assert plain.readlines() == want[::2] and packed.readlines() == want[1::2]
    size = sum(map(len, want))
    assert len(sizes) > 5 and sum(sizes) < size / 20 and os.path.getsize(f"{tmp}/d/f.csv.gz") < size / 20


def test_compressed_positional_files_are_labelled(spark, tmp):
    lines = [f"{k},t,1.1.1.{k % 3},x" for k in range(9)]
    write(f"{tmp}/B/01-12/Syn/a.csv", "\n".join(lines[:3]) + "\n")
    with open(f"{tmp}/B/01-12/Syn/b.csv.gz", "wb") as f:  # of two members
        f.write(b"".join(gzip.compress(("\n".join(x) + "\n").encode()) for x in (lines[3:6], lines[6:])))
    result = jobs.label_positional_flows(spark, f"{tmp}/B", "1.1.1.1", out=f"{tmp}/out")
    assert result.row_counts() == {"rows": 9, "rejected": 0}
    assert spark.read.parquet(f"{tmp}/out").filter("label <> 'BENIGN'").count() == 3


def test_label_rejects_holds_the_files_of_one_style(spark, tmp, monkeypatch):
    lines = 2000
    spark.range(lines).selectExpr("id as l_orderkey", "cast(id % 7 + 1 as int) as l_linenumber", "id % 5 as l_suppkey", "cast(id % 50 as double) as l_quantity") \
        .write.parquet(f"{tmp}/lineitem.parquet")
    folder, held = scratch_path(spark, "x").rpartition("/")[0].removeprefix("file:"), []
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()

    def size():
        new = [os.path.join(folder, x) for x in set(os.listdir(folder)) - before]
        held.append((len(new), sum(os.path.getsize(os.path.join(top, f)) for x in new for top, _, files in os.walk(x) for f in files)))

    for name in ("label_header_flows", "label_positional_flows"):
        monkeypatch.setattr(jobs, name, lambda *a, f=getattr(jobs, name), **b: size() or f(*a, **b))
    rows = jobqueries.q_label_rejects(spark, tmp).collect()
    assert sorted(r["style"] for r in rows) == ["A", "B", "C"] and {r["skipped_files"] for r in rows} == {1}
    assert [n for n, _ in held] == [1, 1, 1]  # nothing of the style before
    assert max(n for _, n in held) < lines / 7 * 600  # the wide file, as plain text


def test_labelled_rows_are_written_unsorted(spark, tmp):
    df = spark.range(100).select("id", (F.col("id") % 9).cast("string").alias("attack"))
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "0")
    write_labelled(df, f"{tmp}/t")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert spark.read.parquet(f"{tmp}/t").filter("id % 9 = attack").count() == 100


def test_the_report_reads_its_inputs_once(spark, tmp, monkeypatch):
    d = f"{tmp}/in/CIC_RAW/01-12/Syn"
    write(f"{d}/monitor_a.csv", "timestamp,cpu_percent,ram_mb\n1,10,600\n")
    run_log(f"{d}/benchmark_a.json", attack="Syn", total_packets=10, time_seconds=2.0, pps=5.0, monitor_file=f"{d}/monitor_a.csv")
    views = jobs.run_report(spark, f"{tmp}/in")
    for view in views.values():  # written once: no view scans the samples or logs
        assert "FileScan" not in view._jdf.queryExecution().executedPlan().toString()
