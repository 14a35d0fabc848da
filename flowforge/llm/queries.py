"""The registered queries: each operator over its whole table with production
parameters, and the DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.llm import alignment, bpe_codec, content_sort, licenses, near_dups, packing, substring_dedup, suffix_dedup, token_counts, topk, toxicity, url_templates, whitening
from flowforge.llm.common import prepare
from flowforge.session import table

#: Where the vocabulary files are; ``set_tokenizer_path`` replaces it.
_PATH: list[Callable[[str], str]] = []


def set_tokenizer_path(path: Callable[[str], str]) -> None:
    """``path(name)`` gives the place of a vocabulary file."""
    _PATH[:] = [path]


def tokenizer_path(name: str) -> str:
    if not _PATH:
        import public_tokenizers
        return public_tokenizers.path(name)
    return _PATH[0](name)


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return content_sort.exact_groups(table(spark, sf_dir, "documents"))


def op3_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_norm_sorted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe_codec.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_suffix_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substring_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op8_bottom_k_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op9_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return licenses.scan(table(spark, sf_dir, "documents"))


#: Lines appended to every document, by doc_id modulo their number.
LICENSE_LINES = ("SPDX-License-Identifier: GPL-3.0-or-later", "copyright notice and more", "Copyright (c) 2020 Somebody", "Released under the 3-clause BSD licence.",
                 "sub\nlicense", "All rights reserved.", "Licensed under the MIT License", "\u00a9 2021 A", "Copyright ACME Inc.", "COPYRIGHT HOLDERS BE LIABLE")


def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 on whole documents with notices, tags, copyright statements and
    lines that only look like them added."""
    prepare(spark)
    more = F.element_at(F.array(*map(F.lit, LICENSE_LINES)), (F.col("doc_id") % len(LICENSE_LINES) + 1).cast("int"))
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", more).alias("text")))


_LICENSE_SOURCE = ("(SELECT doc_id, concat_ws(chr(10), text, replace(([" + ", ".join("'" + x.replace("\n", "|") + "'" for x in LICENSE_LINES)
                   + f"])[doc_id % {len(LICENSE_LINES)} + 1], '|', chr(10))) AS text FROM documents)")


def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op12_pointer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return alignment.alignment_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) = 1 AS kept, sha256(n) AS text_sha256
FROM d
"""


OP7_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS m FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM h JOIN m USING (h) WHERE m < doc_id),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM w),
kept AS (SELECT u.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY u.k) AS t FROM u LEFT JOIN r ON u.doc_id = r.doc_id AND u.k = r.k
      WHERE r.k IS NULL GROUP BY u.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
c AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id),
m AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN m ON w.doc_id = m.doc_id
"""

OP13_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS p FROM d),
h AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS h FROM p),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM h) WHERE k > 1),
b AS (SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM
      (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS n FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM b GROUP BY doc_id, run),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s),
k AS (SELECT doc_id, sum(b - a) AS n, count(*) AS runs, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS x
      FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(d.x) // 2 AS n_bytes, coalesce(k.n, 0)::BIGINT AS n_removed, coalesce(k.runs, 0) AS n_spans,
       sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_compression_toxicity": op1_compression_toxicity,
        "op2_content_sort": op2_content_sort,
        "op3_differencing_packing": op3_differencing_packing,
        "op4_norm_sorted_search": op4_norm_sorted_search,
        "op5_whole_token_counts": op5_whole_token_counts,
        "op6_backtracking_bpe": op6_backtracking_bpe,
        "op7_suffix_subtrees": op7_suffix_subtrees,
        "op8_bottom_k_near_dups": op8_bottom_k_near_dups,
        "op9_path_templates": op9_path_templates,
        "op10_license_digests": op10_license_digests,
        "license_notices": license_notices,
        "op11_cholesky_whitening": op11_cholesky_whitening,
        "op12_pointer_alignment": op12_pointer_alignment,
        "op13_two_stage_suffixes": op13_two_stage_suffixes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_content_sort": OP2_SQL, "op4_norm_sorted_search": topk.SQL, "op7_suffix_subtrees": OP7_SQL,
            "op8_bottom_k_near_dups": OP8_SQL, "op9_path_templates": url_templates.sql(), "op10_license_digests": licenses.sql(), "license_notices": licenses.sql(_LICENSE_SOURCE), "op13_two_stage_suffixes": OP13_SQL}
