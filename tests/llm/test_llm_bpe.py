from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import LONG, ODD, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grantmill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, encoding="utf-8") as file:
        return bpe.vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def as_library(library, text: str) -> list[int]:
    return library.encode(text, add_special_tokens=False).ids


CASES = [
    "", " ", "it's we'll 'twas I'D", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|> <|endoftext|",
    "ＦＵＬＬ ½ ² Ⅷ ٣", "é Ḿ İ ΑΣ ﬁ K Å", "a\x1cb\x85c d e​f", "中文字 кот 😀‍", "ab" * 3000, LONG,
]


@pytest.mark.parametrize("text", CASES)
def test_encoding_and_counting_agree_with_the_library(vocab, library, text):
    ids = as_library(library, text)
    assert np.frombuffer(bpe.encode_texts(vocab, [text])[0], "<u4").tolist() == ids
    assert bpe.count_texts(vocab, [text]) == [len(ids)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("aAéß'stT ,.|<>́Σİ中\x1c ", max_size=60))
def test_any_text_agrees_with_the_library(text):
    with open(PATH, encoding="utf-8") as file:
        vocab = bpe.vocabulary(file.read())
    ids = as_library(vocab.library, text)
    assert np.frombuffer(bpe.encode_texts(vocab, [text])[0], "<u4").tolist() == ids
    assert bpe.count_texts(vocab, [text]) == [len(ids)]


def test_both_trees_and_the_heap_merge_alike(vocab):
    words = ["a", "ab", "internationalisation", "thththth", "é" * 40, "zq" * 31, "x" * 63, "y" * 200]
    for word, coded in zip(words, bpe.merge_by_trees(vocab, words), strict=True):
        one = bpe.merge_by_tree(vocab, word)
        assert np.frombuffer(coded, "<u4").tolist() == one
        assert bpe.count_by_heap(vocab, word) == len(one)


def test_a_full_memory_changes_nothing(vocab, library):
    memory = bpe.Remembered(3)
    old, vocab.ids_of_block = vocab.ids_of_block, memory
    try:
        texts = [f"word{i} other{i % 4} the" for i in range(30)]
        got = [np.frombuffer(bpe.encode_texts(vocab, [t])[0], "<u4").tolist() for t in texts]
    finally:
        vocab.ids_of_block = old
    assert got == [as_library(library, t) for t in texts]
    assert len(memory.now) < 20


def test_runs_are_looked_up_once_for_all_texts(vocab, library):
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    memory = bpe.Remembered(1000)
    memory.now = Counted()
    old, vocab.ids_of_block = vocab.ids_of_block, memory
    try:
        got = bpe.encode_texts(vocab, ["the cat, the dog"] * 50)
    finally:
        vocab.ids_of_block = old
    assert got == [np.array(as_library(library, "the cat, the dog"), "<u4").tobytes()] * 50
    assert Counted.asked <= 6


def test_all_kinds_of_blanks_marks_and_scripts_together(vocab, library):
    texts = [
        "", " ", "  a  b ", "".join(f"x{chr(c)}y{chr(c)}{chr(c)}" for c in range(33)), "a\x85b\xa0c\u1680d\u2000e\u2028f\u3000",
        "x<|endoftext|>y <|endoftext|> <|end <|startoftext|><|endoftext|>\u2003z", "\xa0", "İΣ ΑΣ.", "e\u0301. \u0301 E\u0301x",
        "<| |>", "кот,кот cat中文\u3000cat", "it's IT'S 'll",
    ]
    want = [np.array(as_library(library, t), "<u4").tobytes() for t in texts]
    assert bpe.encode_texts(vocab, texts) == want
    assert [bpe.encode_texts(vocab, [t])[0] for t in texts] == want
    assert bpe.encode_texts(vocab, []) == []


def test_round_trip_of_a_table(spark, library):
    vocab = bpe.load(spark, PATH)
    encoded = bpe.encode(documents(spark), vocab).withColumn("decoded", bpe.decode(vocab)("ids"))
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in encoded.collect()), key=repr)
    want = []
    for i, text in ODD:
        ids = as_library(library, text or "")
        want.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)


def test_digests_of_a_table(spark, library):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    found = bpe.roundtrip(documents(spark), bpe.load(spark, PATH))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, text in ODD:
        ids = as_library(library, text or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_counts_of_a_table(spark, library):
    vocab = bpe.load(spark, PATH)
    got = sorted((tuple(r) for r in bpe.count_tokens(documents(spark), vocab).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(as_library(library, t or ""))) for i, t in ODD]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    vocab = bpe.load(spark, PATH)
    empty = documents(spark, [])
    assert bpe.encode(empty, vocab).withColumn("decoded", bpe.decode(vocab)("ids")).collect() == []
    assert bpe.count_tokens(empty, vocab).collect() == []


def test_decode_of_null_and_empty_ids(spark):
    vocab = bpe.load(spark, PATH)
    df = spark.createDataFrame([(None,), ([],), ([320, 49407],)], "ids array<int>")
    assert [r[0] for r in df.select(F.col("ids"), bpe.decode(vocab)("ids").alias("d")).select("d").collect()] == [
        None, "", "a</w> <|endoftext|>",
    ]


def test_other_vocabularies_are_refused(spark):
    with pytest.raises((ValueError, KeyError)):
        bpe.load(spark, public_tokenizers.path("byte_bpe_50k.json"))
