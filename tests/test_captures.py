"""Captures read in byte ranges: places are proved whatever the cuts."""

import os
import random
import struct

import pytest

from flowforge.sources import pcap

from .fixtures import capture


def records(path):
    return list(pcap.walk_records(path)[1])


def ranges_of(path, split):
    size = max(1, os.path.getsize(path))
    rows = []
    for k, start in enumerate(range(0, size, split)):
        order, first, stop, packets, status = pcap.probe(path, start, start + split)
        rows.append({"file": path, "range": k, "start": start, "end": start + split, "size": size, "byte_order": order,
                     "first": first, "stop": stop, "packets": packets, "status": status})
    return rows


def read_by(path, rows):
    out = []
    for r in pcap.settle(rows):
        if r["first"] is not None:
            part = [x for b in pcap._packet_batches(path, r["first"], r["end"], len(out)) for x in b.to_pylist()]
            assert len(part) == r["packets"]
            out += part
    return [(x["ordinal"], x["ts_sec"], x["ts_frac"], x["incl_len"], x["orig_len"], x["truncated"]) for x in out]


def odd_capture(path, order, seed):
    """Payloads full of plausible and zero headers, records of no length, jumps
    of the clock, fractions out of range."""
    r = random.Random(seed)
    with open(path, "wb") as f:
        f.write((b"\xd4\xc3\xb2\xa1" if order == "<" else b"\xa1\xb2\xc3\xd4") + bytes(20))
        for i in range(60):
            header = struct.pack(order + "IIII", 1000 + i, i, 32, 32)
            body = r.choice([b"", bytes(64), header * 9, os.urandom(r.randrange(90))])
            sec, frac = r.choice([1000 + i, 1000 + i, 10 ** 9]), r.choice([i, i, 2_000_000])
            f.write(struct.pack(order + "IIII", sec, frac, len(body), 7) + body)
        if seed % 2:
            f.write(struct.pack(order + "IIII", 5, 5, 500, 500) + b"cut")
    return path


@pytest.mark.parametrize("order", ["<", ">"])
def test_every_cut_of_a_small_file(tmp, order):
    path = capture(f"{tmp}/a.pcap", order, 9, cut_last=True)
    want = records(path)
    assert len(want) == 9
    for split in range(1, os.path.getsize(path) + 2):
        assert read_by(path, ranges_of(path, split)) == want, split


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_wrong_guesses_are_walked_again(tmp, seed):
    path = odd_capture(f"{tmp}/b.pcap", "<" if seed < 3 else ">", seed)
    want = records(path)
    for split in (7, 16, 33, 64, 100, 1000, 1 << 20):
        rows = ranges_of(path, split)
        assert read_by(path, rows) == want
        for r in rows:  # no range found a place, or all found a wrong one
            r.update(first=None, stop=None, packets=0)
        rows[0].update(first=24, packets=pcap.probe(path, 0, split)[3], stop=pcap.probe(path, 0, split)[2])
        assert read_by(path, rows) == want


def test_ranges_agree_without_a_second_walk(tmp, monkeypatch):
    r = random.Random(6)
    path = f"{tmp}/c.pcap"
    with open(path, "wb") as f:  # clock and payloads as networks give them
        f.write(b"\xd4\xc3\xb2\xa1" + bytes(20))
        for i in range(400):
            body = r.randbytes(r.randrange(60, 1500))
            f.write(struct.pack("<IIII", 1_543_600_000 + i // 40, r.randrange(10 ** 6), len(body), len(body)) + body)
    rows = ranges_of(path, 4096)
    assert len(rows) > 10 and all(r["first"] is not None for r in rows[:-1])
    monkeypatch.setattr(pcap, "Capture", None)  # would be needed to walk again
    assert sum(r["packets"] for r in pcap.settle(rows)) == 400


def test_a_large_capture_is_read_by_several_tasks(spark, tmp):
    path = capture(f"{tmp}/PCAP/01-12/Syn/a.pcap", "<", 300)
    capture(f"{tmp}/PCAP/01-12/Syn/b.pcap", ">", 40)
    capture(f"{tmp}/PCAP/03-11/DNS/junk.pcap", "<", 0, magic=b"junk")
    open(f"{tmp}/PCAP/03-11/DNS/empty.pcap", "w").close()
    files = {os.path.basename(r.file): r for r in pcap.read_capture_files(spark, f"{tmp}/PCAP", split_bytes=2048).collect()}
    assert {k: (r.packets, r.status) for k, r in files.items()} == {
        "a.pcap": (300, "ok"), "b.pcap": (40, "ok"), "junk.pcap": (0, "bad_magic"), "empty.pcap": (0, "bad_magic")}
    assert files["a.pcap"].ranges > 20 and files["a.pcap"].attack == "01-12_Syn"
    got = pcap.read_packets(spark, f"{tmp}/PCAP", split_bytes=2048)
    assert got.rdd.getNumPartitions() > 20
    mine = sorted((r.ordinal, r.ts_sec, r.ts_frac, r.incl_len, r.orig_len, r.truncated) for r in got.collect() if r.file == path)
    assert mine == records(path)


def test_a_capture_that_fails_later_is_an_error(spark, tmp):
    path = capture(f"{tmp}/PCAP/01-12/Syn/a.pcap", "<", 300)
    gone = [r | {"file": path + ".gone", "first": None} for r in ranges_of(path, 2048)]
    gone[0]["first"] = 24
    assert {(r["status"], r["packets"]) for r in pcap.settle(gone)} == {("error", 0)}
    with pytest.raises(OSError):
        list(pcap._packet_batches(path + ".gone", 24, 100, 0))


def test_small_ranges_share_a_task(spark, tmp, monkeypatch):
    for k in range(40):
        capture(f"{tmp}/01-12/Syn/{k}.pcap", "<" if k % 2 else ">", 5)
    want = sum(len(records(path)) for path in pcap.list_files(tmp))
    assert pcap._tasks(40, 5_000) == 40 and pcap._tasks(1, 0) == 1 and pcap._tasks(0, 0) == 1
    assert pcap._tasks(100_000, 100_000 << 10) < 1000 < pcap._tasks(100_000, 100_000 << 26)
    monkeypatch.setattr(pcap, "_FEW_TASKS", 3)
    for split in (64, 1 << 20):
        packets = pcap.read_packets(spark, tmp, split_bytes=split)
        assert packets.rdd.getNumPartitions() == 3 and packets.count() == want
        assert packets.select("file", "ordinal").distinct().count() == want
        files = pcap.read_capture_files(spark, tmp, split_bytes=split)
        assert files.filter("packets = 5 and status = 'ok'").count() == 40
