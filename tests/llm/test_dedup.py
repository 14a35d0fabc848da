"""Exact copies, near copies and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from flowforge.llm import content_sort, near_dups, substring_dedup
from tests.llm.tables import awkward_rows, brute_exact, brute_near, brute_repeats, clashing, prose


def distinct(rows):
    return list({i: (i, t) for i, t in rows if i is not None}.values())


@pytest.fixture(scope="module")
def rows():
    return distinct(awkward_rows())


def frame(spark, rows):
    return clashing(spark, rows)


def test_exact_groups(spark, rows):
    got = content_sort.exact_groups(frame(spark, rows)).collect()
    want = brute_exact(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_one_group_over_many_partitions(spark):
    rows = [(i, "same  text" if i == 50 else "same text") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(40)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r for r in content_sort.exact_groups(frame(spark, rows)).collect()}
        left = {r.doc_id for r in content_sort.drop_exact_copies(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {(got[i].keep_id, got[i].group_size, got[i].kept) for i in range(300) if i != 50} == {(50, 300, False)}
    assert got[50].kept and left == {50, *range(1000, 1040)}


def test_exact_repeated_rows_and_nulls(spark):
    got = content_sort.exact_groups(frame(spark, awkward_rows())).collect()
    assert len(got) == len(awkward_rows())
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({r.text_sha256 for r in got})
    left = content_sort.drop_exact_copies(frame(spark, awkward_rows()))
    assert left.columns == frame(spark, []).columns and left.count() == len(kept)


def test_near_duplicates(spark, rows):
    for words, num in ((3, 85), (5, 80)):
        got = near_dups.near_duplicates(frame(spark, rows), words, num, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, words, num, 100)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_large_spread_group(spark):
    """Copies edited so much that most are linked with few others: the long
    lists' stars don't settle them, the blocks do."""
    rnd = random.Random(3)
    base = prose(9, 150).split()
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 3, 8, 12])):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    got = near_dups.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, 3, 85, 100)


def test_near_duplicates_of_small_sets(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(str(x) for x in range(a, a + n) if rnd.random() > 0.03)) for i, (a, n) in
            enumerate((rnd.randrange(3), rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, 10, 14, 20, 40])) for _ in range(300))]
    for words, num in ((3, 85), (5, 80), (1, 80)):
        got = near_dups.near_duplicates(frame(spark, rows), words, num, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, words, num, 100)


def test_near_nulls_and_repeated_rows(spark):
    got = near_dups.near_duplicates(frame(spark, awkward_rows())).collect()
    assert len(got) == len(awkward_rows())
    assert {r.component_id for r in got if r.doc_id == 5} == {3}
    assert all(r.component_id == r.doc_id and r.kept for r in got if not r.n_shingles)


def test_intersections_equal_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 80))).astype(np.uint64) for _ in range(60)]
    want = [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:30]]
    assert near_dups.intersections(sets[:30], sets[20:]).tolist() == want


@pytest.mark.parametrize("options", [{}, {"limit": 2}, {"window": 8, "gram": 3}])
def test_repeated_passages(spark, rows, options):
    more = rows + [(100 + i, prose(50 + i, 20 + 7 * i) + " " + prose(2, 60) + " " + prose(1, 200)[30 * i:]) for i in range(8)]
    got = substring_dedup.removal_digests(frame(spark, more), **options).collect()
    want = brute_repeats(more, options.get("window", 50))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {i: v[:2] for i, v in want.items()}
    assert {r.doc_id: r.kept_sha256 for r in got} == {i: hashlib.sha256(v[2].encode()).hexdigest() for i, v in want.items()}


def test_drop_repeats_changes_only_what_it_cuts(spark):
    docs = frame(spark, awkward_rows())
    got = substring_dedup.drop_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(awkward_rows())
    want = brute_repeats(distinct(awkward_rows()))
    for r in got.collect():
        if r.doc_id is not None:
            n, gone, left = want[r.doc_id]
            assert r.text == (left if gone else dict(distinct(awkward_rows()))[r.doc_id]), r.doc_id


def test_an_id_with_several_texts(spark):
    long, other = prose(1, 90), prose(2, 90)
    rows = [(5, long), (5, "short a"), (5, other), (9, "x " + long[10:]), (10, other), (11, long)]
    got = substring_dedup.removal_digests(frame(spark, rows)).collect()
    assert len(got) == 6 and all(r.n_removed == 0 for r in got if r.doc_id == 5)
    assert {r.doc_id: r.n_removed > 0 for r in got if r.doc_id == 11} == {11: True}  # 9 has most of it
    assert substring_dedup.drop_repeats(frame(spark, rows)).count() == 6
    near = near_dups.near_duplicates(frame(spark, rows)).collect()
    assert {r.component_id for r in near if r.doc_id in (5, 10, 11)} == {5}


def half_shared(n):
    """Documents that share half of their text, and two pairs of near copies."""
    common = prose(1, 75)
    rows = [(i, common + " " + " ".join(f"d{i}w{k}" for k in range(75))) for i in range(n)]
    return rows + [(n + i, rows[i][1] + " more") for i in (3, n // 2)]


def test_shared_templates_give_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "GROUP", 64)
    pairs = []
    plain = near_dups._pairs
    monkeypatch.setattr(near_dups, "_pairs", lambda *a: (out := plain(*a), pairs.append(out.count()))[0])
    counts = []
    for n in (500, 2000):
        pairs.clear()
        got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(frame(spark, half_shared(n))).collect()}
        assert got == {i: i for i in range(n)} | {n + 3: 3, n + n // 2: n // 2}
        counts.append(sum(pairs))
    assert len(pairs) >= 1 and counts[1] <= 8 * max(1, counts[0]) and counts[1] < 2000


def test_large_groups_by_prefixes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "GROUP", 20)
    rnd = random.Random(5)
    base = prose(9, 120).split()
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 3, 6, 9, 12])):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(40)}"
        rows.append((1000 - i, " ".join(w[rnd.choice([0, 0, 4]):])))
    for words, num in ((3, 85), (5, 80), (1, 90)):
        got = near_dups.near_duplicates(frame(spark, rows), words, num, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, words, num, 100)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert content_sort.exact_groups(empty).count() == content_sort.drop_exact_copies(empty).count() == 0
    assert near_dups.near_duplicates(empty).count() == 0
    assert substring_dedup.removal_digests(empty).count() == substring_dedup.drop_repeats(empty).count() == 0
