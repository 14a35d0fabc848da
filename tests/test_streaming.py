"""Labelling on a file stream gives the batch job's rows."""

from flowforge.plans import jobs
from flowforge.streaming.labeling import start_labelling

from .fixtures import write

ATT = "172.16.0.5"
HEADER = ["Src IP", "Dst IP", "Flow Duration", "Label"]


def test_stream_equals_batch(spark, tmp):
    src = f"{tmp}/CIC_RAW"
    write(f"{src}/01-12/Syn/a.csv", "Src IP,Dst IP,Flow Duration,Label\n"
          f"{ATT},1.1.1.1,5,x\n9.9.9.9,1.1.1.1,6,y\n")
    out = f"{tmp}/labelled"
    q = start_labelling(spark, src, HEADER, out, ATT, checkpoint=f"{tmp}/ckpt",
                        available_now=True)
    q.awaitTermination(120)
    # a new file arrives: the next run picks up only the new file
    write(f"{src}/03-11/DNS/b.csv", "Src IP,Dst IP,Flow Duration,Label\n"
          f"{ATT},1.1.1.1,7,z\n")
    q = start_labelling(spark, src, HEADER, out, ATT, checkpoint=f"{tmp}/ckpt",
                        available_now=True)
    q.awaitTermination(120)
    streamed = sorted((r.flow_duration, r.label, r.attack, r.day)
                      for r in spark.read.parquet(out).collect())
    batch = jobs.label_header_flows(spark, src, ATT).flows
    expected = sorted((r.flow_duration, r.label, r.attack, r.day) for r in batch.collect())
    assert streamed == expected == [("5", "Syn", "Syn", "01-12"), ("6", "BENIGN", "Syn", "01-12"),
                                    ("7", "DNS", "DNS", "03-11")]


def test_running_resource_summary(spark, tmp):
    from flowforge.operators import stats
    from flowforge.sources.runs import read_samples
    from flowforge.streaming.monitoring import start_summary
    from .fixtures import samples
    root = f"{tmp}/interim"
    samples(f"{root}/CIC_RAW/d/a/monitor_a.csv", [(1.0, 10.0, 100.01), (2.0, 30.0, 100.02)])
    out, ckpt = f"{tmp}/summary", f"{tmp}/ckpt-monitor"
    start_summary(spark, root, out, ckpt, available_now=True).awaitTermination(120)
    samples(f"{root}/NTL_RAW/d/b/monitor_b.csv", [(1.0, 5.0, 50.0)])
    start_summary(spark, root, out, ckpt, available_now=True).awaitTermination(120)
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    batch = stats.sample_summary(read_samples(spark, root), key="monitor_key")
    expected = sorted(tuple(r) for r in batch.select("monitor_key", "max_cpu", "avg_cpu",
                                                       "max_ram", "avg_ram", "n_samples").collect())
    assert streamed == expected and len(streamed) == 2
    assert [r[4] for r in streamed if r[0].endswith("monitor_a.csv")] == [100.02]   # 100.015 -> half up
