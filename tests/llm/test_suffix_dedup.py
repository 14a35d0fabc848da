"""Repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from flowforge.llm import suffix_dedup
from tests.llm.tables import awkward_rows, clashing, prose


def brute(rows, window=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept) with distinct ids."""
    first, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw) + 1)
        for p in range(len(raw) - window + 1):
            if raw[p:p + window] in first:
                gone[p:p + window] = b"\1" * window
            else:
                first.add(raw[p:p + window])
        left = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[i] = (len(raw), len(raw) - len(left), sum(gone[k] and not gone[k - 1] for k in range(len(raw))), left)
    return out


def distinct(rows):
    return list({i: (i, t) for i, t in rows if i is not None}.values())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    passage = prose(2, 60)
    more = [(100 + i, prose(50 + i, 20 + 7 * i) + " " + passage + " " + prose(1, 200)[30 * i:]) for i in range(8)]
    more += [(200, "a" * 3000), (201, "ab" * 400 + "a" * 150), (202, "日本語" * 200 + "x"), (203, "語" + "日本語" * 90), (204, "\0" * 250 + "\x01" * 120),
             (205, "abcdefghij" * 9 + "abcdefghi"), (206, "abcdefghij" * 10), (207, "x" + "abcdefghij" * 10 + "y")]
    base = prose(90, 120)
    for i in range(30):  # near copies
        w = base.split()
        for _ in range(3):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        more.append((300 + i, " ".join(w)))
    return distinct(awkward_rows()) + more


@pytest.mark.parametrize("options", [{}, {"group": 3}, {"batch": 1}, {"window": 30, "gram": 8}])
def test_repeated_bytes(spark, rows, options):
    got = suffix_dedup.removal_digests(clashing(spark, rows), **options).collect()
    want = brute(rows, options.get("window", 100))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == {i: v[:3] for i, v in want.items()}
    assert {r.doc_id: r.kept_sha256 for r in got} == {i: hashlib.sha256(v[3]).hexdigest() for i, v in want.items()}


def test_repeated_ids_and_nulls(spark, rows):
    text = prose(1, 80)
    table = [(5, text), (5, text), (6, "short"), (6, prose(8, 90)), (None, text), (None, None), (7, "x" + text), (4, None)]
    got = suffix_dedup.kept_bytes(clashing(spark, table)).collect()
    assert len(got) == len(table)
    assert {(r.doc_id, r.n_removed) for r in got if r.doc_id in (5, None)} == {(5, 0), (None, 0)}
    assert {bytes(r.kept) for r in got if r.doc_id == 7} == {b"x"}
    assert all(r.n_removed == 0 for r in got if r.doc_id == 6)
    again = suffix_dedup.kept_bytes(clashing(spark, [*table, (8, prose(8, 90)), (9, text), (9, text)])).collect()
    assert {r.n_removed for r in again if r.doc_id == 9} == {len(text)} and len(again) == 11


def test_texts_longer_than_a_slice(spark, monkeypatch):
    long = prose(3, 60_000)
    table = [(1, prose(4, 50) + long[5000:9000]), (2, long), (3, long[-700_000 // 4:])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.kept_bytes(clashing(spark, table)).collect()}
    assert got == {i: v[:3] for i, v in brute(table).items()}
    pieces = [g for part in range(0, len(long) - 99, 1 << 12) for g in suffix_dedup.anchors(np.frombuffer(long[part:part + (1 << 12) + 99].encode(), np.uint8), np.array([0, len(long[part:part + (1 << 12) + 99])]), 100, 24)[5] + 1]
    assert sum(pieces) == len(long) - 99


def test_empty_table(spark):
    assert suffix_dedup.removal_digests(clashing(spark, [])).count() == suffix_dedup.kept_bytes(clashing(spark, [])).count() == 0


def test_suffix_array_and_prefixes():
    r = random.Random(1)
    for k in range(60):
        text = np.frombuffer(bytes(r.choice(b"\0ab\xff" if k % 2 else b"aaab") for _ in range(r.randrange(1, 300))) + (b"a" * 40 if k % 3 else b""), np.uint8)
        raw = text.tobytes()
        assert suffix_dedup.smaller_than_successor(text).tolist() == [raw[i:] < raw[i + 1:] for i in range(len(raw))]
        order = suffix_dedup.suffix_array(text, 500).tolist()
        assert order == sorted(range(len(raw)), key=lambda i: raw[i:])
        short = suffix_dedup.suffix_array(text, 8)
        cut = [raw[i:i + 8] for i in short]
        assert cut == sorted(cut) and sorted(short.tolist()) == list(range(len(raw)))
        a, b = short[:-1], short[1:]
        want = [next((d for d in range(30) if raw[x + d:x + d + 1] != raw[y + d:y + d + 1] or x + d >= len(raw)), 30) for x, y in zip(a, b, strict=True)]
        got = suffix_dedup.common_prefixes(text, a, b, 30).tolist()
        assert all(g == w or (w < 30 and max(x, y) + w >= len(raw)) for g, w, x, y in zip(got, want, a, b, strict=True))
