"""Token counts, encoding and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from flowforge.llm import bpe_codec, packing, token_counts
from flowforge.llm.bpe import Vocabulary
from flowforge.llm.queries import tokenizer_path
from tests.llm.tables import awkward_rows, clashing

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def texts():
    r = random.Random(1)
    out = ["", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", "   \n\n x", "a" * 50, "ééééé　  x", "😀" * 20, "don't I'll \t\x0b ",
           "ΑΣ ΣΑΣ. İstanbul ﬁ é é ſ ß ẞ", "\x1c a\x85b ̸ x̸", "x<|startoftext|>'S 's"]
    out += ["".join(r.choice("ab \n'sé1É¼²ªµºß") for _ in range(r.randint(1, 60))) for _ in range(500)]
    out += ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x250, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(500)]
    return out


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def test_vocabulary_tokens_are_whole():
    spec = open(BYTES).read()
    v = Vocabulary(spec)
    assert len(v.whole()) == len(v.ids) == 50256


def test_counts_and_codec_equal_the_library(library):
    spec = open(BYTES).read()
    counter = token_counts.Counter(spec, token_counts.whole_strings(Vocabulary(spec)))
    codec = bpe_codec.Codec(spec)
    for t in texts():
        ids = library[0].encode(t, add_special_tokens=False).ids
        found, decimals = codec.encode(t)
        assert found.tolist() == ids and decimals == ",".join(map(str, ids)).encode()
        assert counter.count(t) == len(ids)
        assert codec.decode_text(found) == library[0].decode(ids, skip_special_tokens=False)


def test_every_path_of_the_encoder_equals_plain_merges():
    codec = bpe_codec.Codec(open(BYTES).read())
    r = random.Random(2)
    for _ in range(3000):
        word = "".join(r.choice("theioanrs ") for _ in range(r.randint(1, 14))).encode()
        assert codec.encode_word(word) == codec._backtrack(word.decode("latin-1")) == codec.vocabulary.merge(word)


def test_word_ids_equal_the_library(library):
    encoder = packing.WordEncoder(open(WORDS).read())
    for t in texts():
        ids = library[1].encode(t, add_special_tokens=False).ids
        assert encoder.ids(t.encode()) == b"".join(i.to_bytes(4, "little") for i in ids), t


def test_case_and_marks_equal_the_library(library):
    encoder = packing.WordEncoder(open(WORDS).read())
    for t in ["<|ENDOFTEXT|>\u0130 <|EndOfText|>", "\u0130STANBUL The THE, the", "ÀÉ ŸŒ ŉ'S ſ'S", "H\u0331 h\u0331 E\u0301 The \u03a3", "a\x85B\xa0C,. ?! '.S", "It'S ...'s 10,5"]:
        ids = library[1].encode(t, add_special_tokens=False).ids
        assert encoder.ids(t.encode()) == b"".join(i.to_bytes(4, "little") for i in ids), t


def test_frequent_words_are_not_merged_again():
    encoder, merged = packing.WordEncoder(open(WORDS).read()), []
    merge = encoder.merge
    encoder.merge = lambda word: merged.append(word) or merge(word)
    encoder.chunks.limit = 8
    for i in range(100):
        rare = "".join(chr(97 + int(d)) for d in f"{i:03}")
        encoder.ids(f"The x{rare} the, y{rare} THE".encode())
    assert merged.count("the") == 1
    assert len(encoder.chunks) <= 8 and len(encoder.chunks.older) <= 8


def test_count_query(spark, library):
    got = token_counts.token_counts(clashing(spark, awkward_rows()), BYTES).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(library[0].encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in awkward_rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_round_trip_query(spark, library):
    docs = clashing(spark, awkward_rows())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in awkward_rows():
        ids = library[0].encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(library[0].decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.doc_id), *r[1:]) for r in bpe_codec.round_trip_digests(docs, BYTES).collect()) == sorted(want)
    encoded = bpe_codec.encode(docs, BYTES)
    back = bpe_codec.decode(encoded, BYTES).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in awkward_rows())


def test_bins_hold_each_piece_once():
    r = random.Random(5)
    for n in (0, 1, 2, 7, 100, 600):
        lengths = [r.randint(1, 4095) for _ in range(n)]
        bins = packing.windows(lengths)
        assert sorted(i for b in bins for i in b) == list(range(n))
        assert all(0 < sum(lengths[i] for i in b) <= 4096 for b in bins)


def test_window_count_rises_when_capacity_is_exceeded():
    # seven tokens into bins of four need two bins by sum, three by shape
    assert len(packing.windows([3, 3, 1 + 1], capacity=4)) == 3


def test_differencing_is_near_equal():
    r = random.Random(6)
    lengths = [r.randint(1, 512) for _ in range(800)]
    sums = [sum(lengths[i] for i in b) for b in packing.difference(lengths, 55)]
    assert max(sums) - min(sums) <= 8


def test_packing_query(spark, library):
    rows = [(i, t) for n, (i, t) in enumerate(awkward_rows()) if i is not None and n != 6]  # ids once each
    got = packing.pack_documents(clashing(spark, rows), WORDS).collect()
    want = {i: [*library[1].encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        part = want[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for spans, sizes in ((pieces, {i: len(v) for i, v in want.items()}), (windows, None)):
        for k, parts in spans.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == sizes[k] if sizes else 0 < at <= 4096


def test_packing_leaves_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = [r.n for r in packing.pack_documents(docs, WORDS).groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()]
    padding = sum(4096 - n for n in sums if n & (n - 1))
    assert padding < 0.01 * sum(sums)


def test_packing_repeats_nulls_and_ids(spark):
    got = packing.pack_documents(clashing(spark, awkward_rows()), WORDS, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert sum(r.length for r in got if r.doc_id == 5) == 2 * next(r.doc_tokens for r in got if r.doc_id == 5)
    assert sum(r.length for r in got if r.doc_id is None) > 0


def test_empty_tables(spark):
    empty = clashing(spark, [])
    assert token_counts.token_counts(empty, BYTES).count() == bpe_codec.round_trip_digests(empty, BYTES).count() == 0
    assert packing.pack_documents(empty, WORDS).count() == 0
