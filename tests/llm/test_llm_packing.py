from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pytest
from llm_data import ODD, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grantmill.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(sizes, limit):
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect_left(gaps, size)
        gap = gaps.pop(at) if at < len(gaps) else limit
        opened += gap == limit
        if gap > size:
            insort(gaps, gap - size)
    return opened


def packed(spark, sizes, limit, **options):
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "id long, size long")
    rows = packing.assign(df, limit, **options).collect()
    assert sorted(r.id for r in rows) == list(range(len(sizes)))
    loads: dict[int, int] = {}
    for r in rows:
        loads[r.sequence] = loads.get(r.sequence, 0) + int(sizes[r.id])
    assert max(loads.values(), default=0) <= limit
    return len(loads)


@pytest.mark.parametrize("sweep_rows", [200_000, 60])
def test_close_to_sequential_best_fit(spark, sweep_rows):
    rng = np.random.default_rng(3)
    sizes = np.minimum(1000, rng.lognormal(5, 1, 500).astype(int) + 1)
    assert packed(spark, sizes, 1000, sweep_rows=sweep_rows) <= 1.01 * best_fit_decreasing(sizes, 1000) + 1


@pytest.mark.parametrize(
    ("sizes", "want"),
    [([], 0), ([10], 1), ([10] * 7, 7), ([5] * 8, 4), ([1] * 25, 3), ([6, 4, 6, 4, 10], 3), ([9, 1, 1, 1, 1], 2)],
)
def test_small_cases(spark, sizes, want):
    assert packed(spark, sizes, 10) == want


def test_lone_pieces_take_the_gaps_left_over_before_them():
    # Range 0 leaves 2 gaps; range 1 needs 1, leaves 3; range 2 needs 5 of the 4 left.
    assert packing._across([(0, 0, 2), (1, 1, 3), (2, 5, 0)]) == [(1, 0, 1, 0, 1), (2, 0, 3, 1, 2), (2, 3, 1, 0, 0)]


def test_whole_documents_come_out(spark):
    vocab = bpe.load(spark, PATH)
    library = Tokenizer.from_file(PATH)
    pieces = packing.cut(documents(spark), vocab, limit=64)
    rows = packing.pack(pieces.withColumn("offset", F.lit("clash")), 64).collect()
    want = []
    for i, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 64):
            raw = np.array(ids[at : at + 64], "<u4").tobytes()
            want.append((i, at // 64, at, len(raw) // 4, zlib.crc32(raw)))
    got = [(r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    places: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 64


def test_empty_table_and_unfit_pieces(spark):
    vocab = bpe.load(spark, PATH)
    assert packing.pack(packing.cut(documents(spark, []), vocab)).collect() == []
    odd = spark.createDataFrame([(0,), (None,), (99,), (3,)], "length long")
    assert sorted((r.length or -1, r.sequence_id is None) for r in packing.pack(odd, 10).collect()) == [
        (-1, True), (-1, True), (3, False), (99, True),
    ]
