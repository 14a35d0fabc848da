"""Token counts by the whole-token shortcut.

Offline, once on the driver, every vocabulary string is run through the merges
alone; those that come out as one token are *proved whole*.  In the tasks a
pre-token that is one of them counts as one; only the rest is merged (by the
library's BPE model), and the counts of recent ones are remembered in a bounded
cache.

Defined results: null text counts as empty: 0 bytes, 0 tokens.  Special strings
inside a text are one token each, as the library does by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowforge.llm.bpe import Vocabulary, letter_bytes
from flowforge.llm.common import BoundedCache, columns, kept, utf8, vocabulary_file

LIMIT = 512


def whole_strings(vocabulary: Vocabulary) -> list[str]:
    """The proved whole tokens that are text (pre-tokens are)."""
    out = []
    for i in vocabulary.whole():
        try:
            out.append(vocabulary.bytes_of[i].decode())
        except UnicodeDecodeError:
            continue
    return out


class Counter:
    def __init__(self, spec: str, whole: list[str]):
        self.vocabulary = Vocabulary(spec)
        letters = {b: c for c, b in letter_bytes().items()}
        merge = Tokenizer.from_str(spec).model.tokenize
        self.counts = BoundedCache(lambda word: len(merge(word.encode().decode("latin-1").translate(letters))), always=dict.fromkeys(whole, 1))

    def count(self, text: str) -> int:
        get = self.counts.__getitem__
        return sum(sum(map(get, words)) + (special is not None) for words, special in self.vocabulary.segments(text))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    spec = vocabulary_file(spark, vocabulary_path)
    whole = spark.sparkContext.broadcast(whole_strings(Vocabulary(spec.value)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("token_counts", len(spec.value), hash(spec.value)), lambda: Counter(spec.value, whole.value))
        for ids, texts in columns(batches, "doc_id", "text"):
            n = [counter.count(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
