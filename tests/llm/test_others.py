"""Toxicity, top-k search, URL filter, license scan and the pipeline."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from flowforge.llm import licenses, topk, toxicity, url_templates
from tests.llm.tables import awkward_rows, brute_exact, brute_near, brute_repeats, clashing, prose

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    got = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    toxic, plain = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.4 * len(toxic)
    assert sum(r.predicted for r in plain) <= 0.02 * len(plain)
    order = sum(a.score > b.score for a in toxic for b in plain) / (len(toxic) * len(plain))
    assert order >= 0.85


def test_toxicity_learns_nothing_from_held_out_labels(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_toxicity_passes_over_absent_labels_and_measures_long_texts(spark, monkeypatch):
    rows = [(i, prose(i, 60) + (" vile rotten scum" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(i, i % 2) for i in range(1000, 3000)], "doc_id long, toxic int")
    own = labels.filter("doc_id < 300")
    monkeypatch.setattr(toxicity, "ROWS", 20)
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, own)  # labels of absent documents use up no quota
    long = spark.createDataFrame([(i, prose(i, 6000) + " vile rotten scum") for i in range(5000, 5012)], "doc_id long, text string")
    more = spark.createDataFrame([(i, 1) for i in range(5000, 5012)], "doc_id long, toxic int")
    short, both = toxicity.fit(docs, own), toxicity.fit(docs.union(long), own.union(more))
    assert (short.ordinary, short.toxic) == (both.ordinary, both.toxic) and short.weights != both.weights


def test_toxicity_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", toxicity.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in got)


def test_toxicity_edge_cases(spark):
    docs = clashing(spark, awkward_rows())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(3, 1), (3, None), (None, 1), (999, 0), (0, 0), (1, 1), (6, 0), (7, 1), (8, 0), (9, 1), (10, 0), (12, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = toxicity.classify(docs, labels).collect()
        assert len(got) == len(awkward_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
        left = toxicity.drop_toxic(docs, labels)
        assert left.columns == docs.columns and left.count() == sum(1 - r.predicted for r in got)
    assert toxicity.classify(clashing(spark, []), odd).count() == 0


def brute_top(rows, k=10, scale=1024):
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows))
    out = []
    for q, x in rows:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def search(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "z", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, v string, part int")
    return topk.top_inner_products(df, F.col("vec_id") % 100 == 0)


def test_top_k_equals_brute_force(spark):
    import random
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(12)]) for i in range(1200)]
    rows = [(i, [float(x) for x in map(lambda y: round(y, 3), v)]) for i, v in rows]
    rows += [(2000 + i, rows[5][1]) for i in range(30)] + [(7, rows[7][1]), (400, rows[400][1])]  # ties and repeated rows
    rows += [(3000, None), (3001, [1.0, None]), (3002, [float("nan")] * 12), (3003, [float("inf")] * 12), (3100, []), (3200, [0.0] * 12), (None, [1.0] * 12),
             (3300, [1.0, 2.0])]
    import numpy as np
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(x) for x in search(spark, rows).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(exact)


def test_top_k_of_large_components_and_few_rows(spark):
    rows = [(0, [3.0e6, -1.0]), (1, [2.0e6, 5.0]), (2, [-1.0, 1.0])]
    got = sorted(tuple(x) for x in search(spark, rows).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows) and len(got) == 2
    assert search(spark, []).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.COM/en/1?x", "https://www.example.com/en/2", "ftp://x.www.example.com/en/", "http://example.com", "http://example.com?/en/",
            "http://notexample.com/en/", "http://a.net/es/1", "http://a.net/fr/1#top", "http://a.net/en/1", "http://a.net/es", "no scheme", "", None, "://", "a://b://c/d",
            "http://h.org/" + "/".join(map(str, range(9)))]
    pages = spark.createDataFrame([(i, u, "h", "p", "r", "t") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, t1 string")
    got = {r.page_id: r for r in url_templates.judge(pages).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", None, None, "com/", "net/es/", "net/fr/",
                                                        None, None, None, None, None, None, None, None]
    assert [(got[i].host, got[i].path) for i in (0, 4, 7, 10, 12, 13, 14)] == [
        ("a.example.com", "/en/1"), ("example.com", ""), ("a.net", "/fr/1"), ("", ""), ("", ""), ("", ""), ("b:", "//c/d")]
    assert [got[i].verdict for i in (0, 1, 5, 6, 7)] == ["block", "allow", "allow", "block", "block"]
    assert url_templates.judge(pages.limit(0)).count() == 0


def test_templates_reject_what_merges_with_blocked_branches(spark):
    """Branches of one host that look like blocked ones are blocked without a rule."""
    urls = [f"http://shop.net/{lang}/{n}" for lang in ("es", "fr") for n in range(40)] + ["http://shop.net/xx/a/b"] + [f"http://good.net/en/{n}" for n in range(40)]
    urls += [f"http://many.org/{w}/x" for w in prose(3, 40).split()]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r.verdict for r in url_templates.judge(pages).collect()}
    assert all(got[u] == ("block" if "/es/" in u or "/fr/" in u else "allow") for u in urls)


def test_templates_carry_labels_to_pages_without_a_rule(spark):
    """A rule's prefix that ends inside a number labels part of one template."""
    urls = [f"http://shop.net/p/{n}" for n in range(10, 60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_templates.judge(pages, rules=(("net", "/p/1", "block"),)).collect()}
    assert all(r.verdict == "block" for r in got.values()) and sum(r.rule is None for r in got.values()) == 40


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [(0, mit), (1, "Copyright (c) 2020 Somebody\n" + mit.upper().replace(",", " ;")), (2, mit.replace("sublicense", "sub-licence")),
            (3, "prose\n  released under the MIT licence\nprose"), (4, mit + " more"), (5, "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0!"),
            (6, None), (7, ""), (8, "Released under the MIT License.")]
    got = {r.doc_id: r for r in licenses.scan(clashing(spark, rows)).collect()}
    assert [got[i].whole_license for i in range(9)] == ["MIT", "MIT", "MIT", None, None, None, None, None, "MIT"]
    assert got[3].licenses == "MIT" and got[5].licenses == "CC-BY-NC-4.0,MIT" and got[5].notice_lines == 2 and got[6].licenses is None
    assert licenses.scan(clashing(spark, [])).count() == 0
    own = spark.createDataFrame([("X", "one two")], "license string, text string")
    assert {r.doc_id for r in licenses.scan(clashing(spark, awkward_rows()), known=own).collect() if r.whole_license == "X"} == {10, 11}


def test_license_lines_count_within_their_row(spark):
    line = "Released under the MIT License."
    rows = [(1, "a\n" + line), (1, "a\n" + line), (1, line + "\n" + line + "\nb"), (None, line), (None, "c\n" + line), (2, "none")]
    docs = clashing(spark, rows)
    want = sorted([("1", 1), ("1", 1), ("1", 2), ("None", 1), ("None", 1), ("2", 0)])
    assert sorted((str(r.doc_id), r.notice_lines) for r in licenses.scan(docs).collect()) == want
    known = spark.createDataFrame([("MIT", line)] + [(f"L{i}", f"text {i}") for i in range(30)], "license string, text string")
    try:
        licenses.BROADCAST_ROWS, limit = 5, licenses.BROADCAST_ROWS
        assert sorted((str(r.doc_id), r.notice_lines) for r in licenses.scan(docs, known=known).collect()) == want
    finally:
        licenses.BROADCAST_ROWS = limit


def test_license_texts_in_any_wrapping_and_under_any_title(spark):
    import textwrap
    rows, want = [], []
    for name, text in licenses.TEXTS.items():
        first, rest = text.split("\n", 1)
        body = rest if first in licenses.TITLES[name] else text
        for width in (70, 72, 75, 78, 80, 100_000):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in body.strip().split("\n\n"))
            for head in ("", *(h + "\n\n" for h in licenses.TITLES[name])):
                rows.append((len(rows), head + "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n" + wrapped))
                want.append(name)
    rows += [(len(rows), licenses.TEXTS["MIT"].replace("sublicense", "sub\nlicence").replace("NONINFRINGEMENT", "NON-\nINFRINGEMENT"))]
    got = {r.doc_id: r.whole_license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [*want, "MIT"]


def test_only_copyright_statements_are_removed(spark):
    gone = ["Copyright (c) 2020 A", "COPYRIGHT (C) A", "Copyright 2019-2020 A", "copyright 1999 a", "Copyright \u00a9 A", "\u00a9 2020 A", "(c) 2020 A", " * Copyright The A Authors",
            "Copyright ACME Inc.", "All rights reserved.", "Copyright [yyyy] [name of copyright owner]", "Copyright (C) <year>  <name>", "copyright by A", "Copyright npm, Inc."]
    kept = ["copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE", "copyright owner or entity", "Copyright License. Subject to",
            "(c) You must retain", "Copyright Holder means", "All rights reserved to nobody and more words", "copyrighted works"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(gone + kept)], "i int, x string")
    got = {r.i: r.t for r in df.select("i", licenses.normal_text(F.col("x")).alias("t")).collect()}
    assert [(gone + kept)[i] for i in sorted(got) if (got[i] == "") != (i < len(gone))] == []


def test_default_registry_has_the_common_licenses(spark):
    import os
    lines = {"Licensed under the MIT License": "MIT", "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
             "This project is licensed under the MIT License - see the LICENSE file for details": "MIT", "# Released under the 3-clause BSD licence.": "BSD-3-Clause",
             'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0", "Distributed under the terms of the Mozilla Public License 2.0": "MPL-2.0",
             "Licensed under the Nobody License": None}
    rows = [(i, "prose\n" + line + "\nprose") for i, line in enumerate(lines)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(lines.values())
    want = {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "BSL-1.0"}
    assert want <= {r.license for r in licenses.known_digests(spark).collect()}
    system = "/usr/share/common-licenses"  # whole texts, where the system has them
    names = [n for n in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0") if os.path.exists(f"{system}/{n}")]
    docs = [(i, open(f"{system}/{n}", encoding="utf-8").read()) for i, n in enumerate(names)]
    got = {r.doc_id: r.whole_license for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i].startswith(n) for i, n in enumerate(names))


def test_oracles_on_the_smallest_tables(spark):
    from flowforge.llm import queries
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    made = queries.queries()
    for name, sql in queries.oracle_sql().items():
        got = made[name](spark, SMALL)
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, rel.fetchall())), name


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as p
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents.filter("doc_id < 300").cache()
    stage = dict(p.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    left = stage["toxicity"](spark, docs, SF)
    scores = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels).collect()}
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, x in scores.items() if not x}

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {keep for keep, _, _ in brute_exact(rows).values()}
    left = stage["exact_dedup"](spark, docs, SF)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == want

    want = {i for i, (_, c) in brute_near(rows, 5, 80, 100).items() if i == c}
    left = stage["near_dedup"](spark, docs, SF)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == want

    left = {r.doc_id: r for r in stage["substring_dedup"](spark, docs, SF).collect()}
    texts = dict(rows)
    for i, (_, gone, kept) in brute_repeats(rows).items():
        assert left[i].text == (kept if gone else texts[i]) and left[i].n_chars == len(left[i].text)

    whole = defaultdict(int)
    for r in stage["packing"](spark, docs, SF).collect():
        whole[r.doc_id] += r.length
        assert r.doc_tokens > 0
    assert set(whole) == set(texts)


def test_pipeline_stages_take_awkward_tables(spark):
    import corpus_pipeline as p
    for rows in (awkward_rows(), []):
        docs = clashing(spark, rows)
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
            assert (out.count() > 0) == bool(rows)
        p.STAGES[-1][1](spark, docs, SF).count()


def test_the_pipeline_leaves_only_its_result(spark):
    import os
    import corpus_pipeline as p
    from flowforge.session import ensure_checkpoint_dir
    base = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "scratch")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    out = p.run(spark, SMALL)
    assert out.count() > 0
    assert [f.rsplit("-", 1)[0] for f in set(os.listdir(base)) - before] == ["pipeline-packing"]
