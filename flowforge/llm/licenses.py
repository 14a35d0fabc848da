"""License scan: canonical digest lookup.

A text is normalised (letter case, punctuation, copyright statements, equivalent
spellings, also across line breaks), and the digest of the *entire* result is
hash-joined to the digests of known licenses.  Two kinds of text are looked up: the whole document, and
each of its lines, which finds one-line notices at any place of a long text.

Everything is a DataFrame expression, and each text is normalised once.  The table
of known licenses is a parameter.  Up to ``BROADCAST_ROWS`` digests are broadcast
for the whole texts and held as a hash set for the lines, which are then counted
within their row; a larger table is joined by shuffling.

Defined results: null or empty texts match nothing; a document that repeats a
notice counts each line.  Repeated ids and null ids are rows of their own.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.llm.license_registry import DIGESTS, sentences

#: A registry of more digests is joined by shuffling instead.
BROADCAST_ROWS = 20_000

# FIXED VALUES: equivalent spellings (from, to), applied after punctuation is gone.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("noncommercial", "non commercial"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("https", "http"), ("per cent", "percent"),
)

# FIXED VALUES: one-line notices of well-known licenses.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

# FIXED VALUES: texts of short licenses, without their copyright lines.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}

#: (license, text) rows of whole short texts and of the notices above.
KNOWN = tuple([*NOTICES.items(), *TEXTS.items()])

# FIXED VALUES: title lines that stand above the texts.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD", "Zero-Clause BSD (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause License", "BSD-2-Clause", "Simplified BSD License", "BSD License", "The BSD License",
                     'BSD 2-Clause "Simplified" License', "FreeBSD License", "The 2-Clause BSD License", "Two-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause License", "BSD-3-Clause", "New BSD License", "Modified BSD License", "BSD License",
                     "The BSD License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License", "Three-Clause BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib", "zlib/libpng License", "The zlib/libpng License", "zlib License (Zlib)"),
}


def titled(texts: dict[str, str], titles: dict[str, tuple]) -> list[tuple[str, str]]:
    """Each text without a title and below each of its titles, with numbered and with marked points."""
    out = []
    for name, text in texts.items():
        heads = titles.get(name, ())
        body = text.split("\n", 1)[1] if text.split("\n", 1)[0] in heads else text
        for form in dict.fromkeys((body, re.sub(r"(?m)^[0-9]\. ", "* ", body))):
            out += [(name, form), *((name, head + "\n\n" + form) for head in heads)]
    return out


# FIXED VALUES: the third point of the longer BSD licence, before its disclaimer.
THIRD = tuple(f"3. Neither the name of {owner} nor the names of {whose} contributors may be used to endorse or promote products derived from this software "
              "without specific prior written permission.\n\nTHIS SOFTWARE"
              for owner, whose in (("the copyright holder", "its"), ("the copyright holders", "its"), ("the copyright holder", "other"), ("the author", "its"), ("the author", "other")))

#: (license, text) rows looked up by default, besides ``license_registry.DIGESTS``.
REGISTRY = tuple(dict.fromkeys([*KNOWN, *titled(TEXTS, TITLES), *sentences(),
                                *(row for third in THIRD for row in titled({"BSD-3-Clause": TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE", third, 1)}, TITLES))]))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words after 'copyright' that go on with a sentence instead of naming a holder.
BODY_WORDS = ("notices?|holders?|owners?|licen[sc]es?|licensing|laws?|acts?|and|or|in|of|to|is|as|on|for|the following|this|that|a|an|shall|may|can|does|under|if|with|which|has|applies|interests?|statements?|protections?|rights?|"
              "treat(?:y|ies)|disclaimers?|infringements?|claims?|management|permissions?|ownership|material|works?|status|terms?|conditions?|information")
#: A line that is a copyright statement: the sign, a year (or its blank) or a holder after 'copyright', the sign and a year, or the reservation.
COPYRIGHT_LINE = (r"(?m)^[^A-Za-z0-9\n]*?(?:(?i:copyright)[^A-Za-z0-9\n]*(?:\((?i:c)\)|\u00a9|(?:19|20)[0-9]{2}\b|(?i:by)\b|[\[<{(](?i:year|yyyy|date)s?[\]>})])[^\n]*"
                  r"|(?:Copyright[:\t ]+(?!(?i:" + BODY_WORDS + r")\b)[A-Za-z]|COPYRIGHT[:\t ]+(?!(?i:" + BODY_WORDS + r")\b)[A-Z])[^\n]*"
                  r"|(?:\((?i:c)\)|\u00a9)[^A-Za-z0-9\n]*(?:19|20)[0-9]{2}\b[^\n]*"
                  r"|\u00a9[^\n]*|(?i:all rights reserved)(?:[^A-Za-z0-9\n]*| by [^\n]*))$")


def _plain(text: Column) -> Column:
    """Lower-case letters, digits, spaces and line breaks, without copyright
    statements (looked for only in texts that hold a word or sign of one)."""
    t = F.coalesce(text, F.lit(""))
    low = F.translate(t, UPPER, LOWER)
    hint = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("\u00a9")) | F.contains(low, F.lit("reserved"))
    low = F.when(hint, F.translate(F.regexp_replace(t, COPYRIGHT_LINE, ""), UPPER, LOWER)).otherwise(low)
    return F.regexp_replace(low, r"[^a-z0-9\n]+", " ")


def _spelled(t: Column) -> Column:
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def _lines(plain: Column) -> Column:
    return F.filter(F.transform(F.split(_spelled(plain), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def _one_line(plain: Column) -> Column:
    return _spelled(F.trim(F.regexp_replace(plain, r"[ \n]+", " ")))


def normal_lines(text: Column) -> Column:
    """The normalised, non-empty lines of ``text`` as an array."""
    return _lines(_plain(text))


def normal_text(text: Column) -> Column:
    """The normalised text as one line: spellings of two words are found across line breaks."""
    return _one_line(_plain(text))


def known_digests(spark: SparkSession, known=REGISTRY) -> DataFrame:
    """(digest, license): one row per distinct normalised known text; the default
    registry has digests of long texts too."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, text string")
    digests = rows.select("license", normal_text(F.col("text")).alias("t")).filter("t <> ''").select("license", F.sha2("t", 256).alias("digest"))
    if known is REGISTRY:
        digests = digests.union(spark.createDataFrame(list(DIGESTS), "license string, digest string"))
    return digests.groupBy("digest").agg(F.min("license").alias("license"))


def _line_hits(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """``rows`` with found: the licenses of their lines, an entry for each line; the
    digests are a hash set and a table within the expression."""
    known = {r["digest"]: r["license"] for r in digests.collect()}
    if not known:
        return rows.withColumn("found", F.array().cast("array<string>")).drop("lines")
    members = ", ".join(f"'{d}'" for d in known)  # hexadecimal digits
    names = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    hits = F.expr(f"filter(transform(lines, x -> sha2(x, 256)), d -> d IN ({members}))")
    return rows.withColumn("hits", hits).withColumn("found", F.transform("hits", lambda d: F.element_at(names, d))).drop("hits", "lines")


def _line_hits_by_join(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """The same for any number of digests: lines are exploded and joined.  Equal
    rows share a key, so each line number counts once."""
    keyed = rows.withColumn("key", F.sha2(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull().cast("string"), "lines"), 256))
    units = keyed.select("key", F.posexplode("lines").alias("at", "line")).select("key", "at", F.sha2("line", 256).alias("digest"))
    found = units.join(digests, "digest").select("key", "at", "license").distinct().groupBy("key").agg(F.collect_list("license").alias("found"))
    joined = keyed.drop("lines").join(found, "key", "left")
    return joined.withColumn("found", F.coalesce("found", F.array().cast("array<string>"))).drop("key")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=REGISTRY) -> DataFrame:
    """One row per document: doc_id, text_digest (of the whole normalised text),
    whole_license, notice_lines (how many lines are known texts), licenses
    (sorted names, joined by commas; null if none)."""
    digests = known_digests(docs.sparkSession, known)
    small = not isinstance(known, DataFrame) or digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    plain = docs.select(F.col(id_col).alias("doc_id"), _plain(F.col(text_col)).alias("plain"))
    rows = plain.select("doc_id", _one_line(F.col("plain")).alias("whole"), _lines(F.col("plain")).alias("lines"))
    rows = rows.select("doc_id", F.sha2("whole", 256).alias("text_digest"), (F.col("whole") != "").alias("any"), "lines")
    entire = digests.select(F.col("digest").alias("text_digest"), F.col("license").alias("whole_license"))
    rows = (_line_hits if small else _line_hits_by_join)(rows, digests)
    rows = rows.join(F.broadcast(entire) if small else entire, "text_digest", "left")
    whole = F.when(F.col("any"), F.col("whole_license"))
    every = F.array_sort(F.array_distinct(F.concat("found", F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array().cast("array<string>")))))
    return rows.select("doc_id", "text_digest", whole.alias("whole_license"), F.size("found").cast("long").alias("notice_lines"),
                       F.when(F.size(every) > 0, F.array_join(every, ",")).alias("licenses"))


def is_statement_sql(line: str) -> str:
    """DuckDB condition: whether a line is a copyright statement."""
    body = BODY_WORDS.replace("(?:", "(")
    start = "^[^A-Za-z0-9]*"

    def like(pattern: str) -> str:
        return f"regexp_matches({line}, '{start}{pattern}')"

    gap, goes_on = r"[:\t ]+", rf"(?i:{body})\b"
    holder = [f"({like(word + gap + letter)} AND NOT {like(word + gap + goes_on)})"
              for word, letter in (("Copyright", "[A-Za-z]"), ("COPYRIGHT", "[A-Z]"))]
    return "(" + " OR ".join([
        like(r"(?i:copyright)[^A-Za-z0-9]*(\((?i:c)\)|\x{a9}|(19|20)[0-9]{2}\b|(?i:by)\b|[\[<{(](?i:year|yyyy|date)s?[\]>})])"),
        *holder, like(r"(\((?i:c)\)|\x{a9})[^A-Za-z0-9]*(19|20)[0-9]{2}\b"), like(r"\x{a9}"),
        like(r"(?i:all rights reserved)([^A-Za-z0-9]*| by .*)$")]) + ")"


def sql(source: str = "documents") -> str:
    """DuckDB SQL for ``scan`` of the rows (doc_id, text) of ``source``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in REGISTRY)
    digests = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in DIGESTS)

    def spelled(t: str) -> str:
        for old, new in SPELLINGS:
            t = f"replace({t}, '{old}', '{new}')"
        return t

    plain = (f"regexp_replace(translate(array_to_string(list_transform(string_split(coalesce(t, ''), chr(10)), "
             f"lambda x: CASE WHEN {is_statement_sql('x')} THEN '' ELSE x END), chr(10)), '{UPPER}', '{LOWER}'), '[^a-z0-9\n]+', ' ', 'g')")
    whole = spelled("trim(regexp_replace(p, '[ \n]+', ' ', 'g'))")
    lines = f"list_filter(list_transform(string_split({spelled('p')}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    return f"""
WITH k AS (SELECT l, {plain} AS p FROM (VALUES {known}) AS k(l, t)),
known AS (SELECT digest, min(l) AS license FROM (SELECT l, sha256({whole}) AS digest FROM k WHERE {whole} <> '' UNION ALL SELECT * FROM (VALUES {digests}) AS g(l, digest)) GROUP BY digest),
p AS (SELECT row_number() OVER () AS r, doc_id, {plain} AS p FROM (SELECT doc_id, text AS t FROM {source})),
d AS (SELECT r, doc_id, {whole} AS whole, {lines} AS lines FROM p),
u AS (SELECT r, sha256(line) AS digest FROM (SELECT r, unnest(lines) AS line FROM d)),
n AS (SELECT r, count(*) AS hits, list(DISTINCT license) AS found FROM u JOIN known USING (digest) GROUP BY r),
j AS (SELECT d.doc_id, sha256(whole) AS text_digest, CASE WHEN whole <> '' THEN license END AS whole_license, hits, found
      FROM d LEFT JOIN known ON sha256(whole) = known.digest LEFT JOIN n ON d.r = n.r),
e AS (SELECT *, list_sort(list_distinct(list_concat(coalesce(found, []), CASE WHEN whole_license IS NULL THEN [] ELSE [whole_license] END))) AS every FROM j)
SELECT doc_id, text_digest, whole_license, coalesce(hits, 0) AS notice_lines,
       CASE WHEN len(every) > 0 THEN array_to_string(every, ',') END AS licenses FROM e
"""
