"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what
recurs in toxic text only.  A window of words that compresses better with the
toxic dictionary at hand than without it is closer to toxic text; the difference
of the two compressed lengths, in bytes, is the window's evidence.  A logistic
curve over the differences of all windows of a text, calibrated on labelled rows
that did not train those dictionaries, turns them into a score of 0 to 1.

* Both dictionaries start from the same ordinary content, so that only toxic
  passages make a difference.
* The toxic dictionary is trained on the words of toxic texts that start with a
  stem (4 bytes or more) much more frequent among toxic than ordinary texts.
* Rows: ids with crc32(id as text) mod 3 = 1 are held out and never read for
  learning.  The other two thirds take turns: each is measured with dictionaries
  trained on the other, which calibrates the curve; the final dictionaries are
  trained on both.  At most ``ROWS`` rows of each class and third, by hash of the
  id, each of at most ``ROW_BYTES``: a bounded sample, the only texts that reach
  the driver.  Copies and near copies in it count once.
* Longer labelled texts, at most ``ROWS`` of each class and third, take part in the
  calibration: tasks measure them, and only their evidence reaches the driver.

Every whole text is scored, all windows of it, in one pass without a shuffle.

Defined results: null text counts as empty; an empty text has no windows and
gets the curve's value at no evidence.  If either class has no labelled rows,
every score is the smoothed share of toxic among those there are.  Labels that
are null, or of unknown documents, are passed over; of several labels of one
document the highest holds.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowforge.llm.common import utf8, written

#: Bounds of the labelled sample.
ROWS, ROW_BYTES = 2500, 1 << 14
#: Bytes of the two dictionaries.
ORDINARY, TOXIC = 8192, 1024
#: Words of a window, words from one to the next, compression level.
WINDOW, STEP, LEVEL = 12, 10, 5
#: A stem counts as toxic in at least this share of toxic texts and so many times the ordinary share.
SHARE, RATIO = 0.01, 8
#: ... and its count gains so much log-likelihood (9: chance one in thousands).
GAIN = 9
THRESHOLD = 0.7


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3


def windows(text: bytes) -> list[bytes]:
    words = text.lower().split()
    return [b" " + b" ".join(words[i:i + WINDOW]) + b" " for i in range(0, max(1, len(words) - WINDOW + STEP), STEP)] if words else []


def _stems(word: bytes) -> set[bytes]:
    return {word[:n] for n in range(4, len(word) + 1)}


def stem_counts(texts: list[bytes], among: set[bytes] | None = None) -> Counter:
    """In how many texts each stem occurs: of ``among``, or twice at least."""
    out: Counter = Counter()
    for text in texts:
        stems = set().union(*map(_stems, set(text.lower().split())))
        out.update(stems if among is None else stems & among)
    return out if among is not None else Counter({s: n for s, n in out.items() if n > 1})


def typical_stems(toxic: Counter, n_toxic: int, ordinary: Counter, n_ordinary: int) -> set[bytes]:
    """Stems far more frequent among toxic texts than chance explains: by the
    ratio of shares, and by the log-likelihood gain over one common share."""
    out = set()
    for stem, n in toxic.items():
        rest = ordinary[stem]
        if n >= 4 and n >= SHARE * n_toxic and n * n_ordinary > RATIO * n_toxic * (rest + 1):
            expected = (n + rest) * n_toxic / (n_toxic + n_ordinary)
            if n * math.log(n / expected) - (n - expected) >= GAIN:
                out.add(stem)
    return out


def toxic_passages(toxic: list[bytes], typical: set[bytes]) -> list[bytes]:
    """Per toxic text, its words with a stem that is typical of toxic texts."""
    runs = ([w for w in text.lower().split() if not typical.isdisjoint(_stems(w))] for text in toxic)
    return [b" " + b" ".join(run) + b" " for run in runs if run]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary's bytes; of too few samples, the samples."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@dataclass
class Model:
    """Two dictionaries and the calibrated curve; a few KB."""

    ordinary: bytes
    toxic: bytes
    mean: list[float]
    spread: list[float]
    weights: list[float]
    constant: float | None = None

    def open(self) -> None:
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.compressors = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress)

    def evidence(self, text: bytes) -> list[float]:
        """Of the window differences: highest, top three, mean, excess over 5, log of their number."""
        plain, toxic = self.compressors
        gaps = sorted((len(plain(w)) - len(toxic(w)) for w in windows(text)), reverse=True)
        if not gaps:
            return [0.0] * 5
        return [gaps[0], sum(gaps[:3]), sum(gaps) / len(gaps), sum(g - 5 for g in gaps if g > 5), math.log1p(len(gaps))]

    def curve(self, evidence: list[float]) -> float:
        if self.constant is not None:
            return self.constant
        z = self.weights[-1] + sum(w * (x - m) / s for w, x, m, s in zip(self.weights, evidence, self.mean, self.spread, strict=False))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def score(self, text: bytes) -> float:
        return self.curve([0.0] * 5 if self.constant is not None else self.evidence(text))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with a slight ridge."""
    a, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w)), a.T @ (y - p) - 0.05 * w)
    return w


def without_copies(texts: list[bytes]) -> list[bytes]:
    """Texts that share no half of their 16 least word hashes with an earlier one."""
    seen: dict[int, list[int]] = {}
    out = []
    for n, text in enumerate(texts):
        least = sorted({zlib.crc32(w) for w in text.lower().split()})[:16]
        shared = Counter(m for h in least for m in seen.get(h, ()))
        if least and max(shared.values(), default=0) * 2 < len(least):
            out.append(text)
            for h in least:
                seen.setdefault(h, []).append(n)
    return out


def _dictionaries(texts: dict[int, list[bytes]], counts: dict[int, Counter]) -> Model:
    """A model without a curve, from the texts and stem counts by label."""
    pieces = []
    for text in texts[0]:
        words = text.lower().split()
        pieces += [b" " + b" ".join(words[i:i + 40]) for i in range(0, len(words), 40)]
    passages = toxic_passages(texts[1], typical_stems(counts[1], len(texts[1]), counts[0], len(texts[0])))
    passages = passages or [b" " + b" ".join(t.lower().split()) + b" " for t in texts[1]]
    return Model(_dictionary(ORDINARY, pieces), _dictionary(TOXIC, [p for p in passages for _ in range(2)]), [], [], [])


def train(rows: list[tuple[int, int, bytes]], measure_long=None) -> Model:
    """A model from (third, label, text) rows; there are thirds 0 and 2.
    ``measure_long`` takes the model to measure each third with and returns
    (label, evidence) of longer texts."""
    texts = {(third, y): without_copies([t for u, label, t in rows if (u, label) == (third, y)]) for third in (0, 2) for y in (0, 1)}
    if not all(texts.values()):
        return Model(b"", b"", [], [], [], constant=(1 + sum(y for _, y, _ in rows)) / (2 + len(rows)))
    counts = {(third, 1): stem_counts(texts[third, 1]) for third in (0, 2)}
    among = {*counts[0, 1], *counts[2, 1]}
    counts |= {(third, 0): stem_counts(texts[third, 0], among) for third in (0, 2)}
    x, y, others = [], [], {}
    for third in (0, 2):
        other = others[third] = _dictionaries(*({label: part[2 - third, label] for label in (0, 1)} for part in (texts, counts)))
        other.open()
        # copies stay in the calibration, in the shares that labelled rows have
        held = [(label, t) for u, label, t in rows if u == third]
        x += [other.evidence(t) for _, t in held]
        y += [float(label) for label, _ in held]
    for label, evidence in measure_long(others) if measure_long else ():
        x.append(evidence)
        y.append(float(label))
    model = _dictionaries(*({label: part[0, label] + part[2, label] for label in (0, 1)} for part in (texts, counts)))
    x = np.array(x)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    model.mean, model.spread = mean.tolist(), spread.tolist()
    model.weights = _logistic((x - mean) / spread, np.array(y)).tolist()
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows outside the held-out third."""
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(label_col).cast("int").alias("label")).withColumn("use", fold(F.col("id"))))
    text = utf8(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # only documents that exist, by their length, take part in the choice
    sizes = (texts.select("id", F.octet_length("text").alias("bytes")).join(known.filter(F.col("use") != 1), "id").groupBy("id", "label", "use")
             .agg((F.min("bytes") > ROW_BYTES).alias("long")))
    sizes = written(sizes, "toxicity-sizes")
    picked = {}
    for long in (False, True):
        for use in (0, 2):
            for label in (0, 1):
                part = (sizes.filter((F.col("use") == use) & (F.col("label") == label) & (F.col("long") == long)).drop("long")
                        .orderBy(F.xxhash64("id"), "id").limit(ROWS))
                picked[long] = picked[long].union(part) if long in picked else part
    rows = (texts.filter(F.octet_length("text") <= ROW_BYTES).join(F.broadcast(picked[False]), "id")
            .orderBy("use", "label", "id").limit(8 * ROWS).select("use", "label", "text").collect())
    over = texts.filter(F.octet_length("text") > ROW_BYTES).join(F.broadcast(picked[True]), "id").select("id", "use", "label", "text")

    def measure_long(others: dict[int, Model]) -> list[tuple[int, list[float]]]:
        models = {third: Model(m.ordinary, m.toxic, [], [], []) for third, m in others.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for model in models.values():
                model.open()
            for batch in batches:
                for at in range(batch.num_rows):
                    part = batch.slice(at, 1)
                    evidence = models[part.column(1)[0].as_py()].evidence(part.column(3)[0].as_py())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int64()), part.column(2).cast(pa.int32()),
                                                      pa.array([evidence], pa.list_(pa.float64()))], names=["id", "use", "label", "evidence"])

        shape = over.select("id", F.col("use").cast("long"), F.col("label").cast("int"), F.array(F.lit(0.0)).alias("evidence")).schema
        found = over.mapInArrow(run, shape).orderBy("use", "label", "id").limit(8 * ROWS).collect()
        return [(r.label, list(r.evidence)) for r in found]

    return train([(r.use, r.label, bytes(r.text)) for r in rows], measure_long)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double) added; labels, sources and ids are not looked at."""
    shape = docs.select("*", F.lit(0.0).cast("double").alias("score")).schema
    names = docs.columns
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.constant is None:
            model.open()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(text_at).cast(pa.binary()).to_pylist()
                scores = pa.array([model.score(t or b"") for t in texts], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*names, "score"])

    return docs.mapInArrow(run, shape)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = score(rows, fit(docs, labels, id_col, text_col, label_col))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents whose score stays below the threshold, columns whole."""
    model = fit(docs, labels, id_col, text_col, label_col)
    names = docs.columns
    return (docs.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(names)])
            .transform(lambda d: score(d, model, f"c{names.index(text_col)}"))
            .filter(F.col("score") < THRESHOLD).select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(names)]))
