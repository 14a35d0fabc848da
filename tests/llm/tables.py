"""Small fixtures and brute-force versions for the operators' tests."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

WORDS = r"[^\x20\x09-\x0D]+"


def prose(seed: int, n: int, words: int = 40) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words * 20)}" for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls, empties, spaces only, ties, repeated rows, a long text, near and
    exact copies, a shared passage: (doc_id, text)."""
    base, passage = prose(1, 200), prose(2, 60)
    edited = " ".join("x" if i == 100 else w for i, w in enumerate(base.split()))
    rows = [(0, None), (1, ""), (2, "  \t\n "), (3, base), (4, base.replace(" ", "  ")), (5, base), (5, base), (6, edited),
            (7, prose(3, 30) + " " + passage + " " + prose(4, 30)), (8, prose(5, 10) + "\n" + passage), (9, passage), (10, "one two"),
            (11, "One two"), (12, prose(6, 20_000)), (13, "a b c"), (14, "A B C"), (15, "abc"), (16, "word " * 300), (17, "word " * 120),
            (18, "né à la 　 café 😀 <|endoftext|> x"), (None, base), (None, None), (19, "\x1c\x85 odd"), (20, passage + " " + passage)]
    return rows


def clashing(spark, rows):
    """The rows with more columns, named like those the operators use inside."""
    extra = ["text_sha256", "g", "c", "doc", "loc", "row", "pid", "n", "key", "rep", "spans", "score", "ids", "start", "label", "sequence_id", "id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in extra)
    return spark.createDataFrame([(i, t, None, "src0", None if t is None else len(t), *["z"] * len(extra)) for i, t in rows], schema)


def brute_exact(rows):
    """(doc_id, keep_id, group_size) with distinct ids."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def shingle_sets(rows, words):
    out = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(WORDS, low)
        out[i] = {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    return out


def brute_near(rows, words, num, den):
    sets = shingle_sets(rows, words)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            inter = len(sets[i] & sets[j])
            if inter and den * inter >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def brute_repeats(rows, window=50):
    first, split = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(WORDS, t or "")
        split.append((i, w))
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), i)
    out = {}
    for i, w in split:
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p:p + window])] < i for q in range(p, p + window)}
        left = " ".join(x for q, x in enumerate(w) if q not in gone)
        out[i] = (len(w), len(gone), left)
    return out
