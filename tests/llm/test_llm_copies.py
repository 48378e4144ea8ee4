from __future__ import annotations

import hashlib
import random
import re

from llm_data import ODD, documents

from grantmill.llm import copies


def slow_groups(rows):
    """Rows (id, keep_id, group_size, sha) by comparing the normalised texts themselves."""
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), text in zip(rows, normal, strict=True):
        same = [j for (j, _), other in zip(rows, normal, strict=True) if other == text]
        ids = [j for j in same if j is not None]
        out.append((i, min(ids, default=None), len(same), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "text_sha256")) for r in df.collect()), key=repr)


def test_odd_rows_against_comparing_all(spark):
    rows = [*ODD, (20, "a\x0bb"), (21, "a \t\r\nb"), (22, "a b"), (23, " a b"), (24, "a\x1cb"), (25, "a b"), (26, "a b ")]
    df = copies.group_copies(documents(spark, rows))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found(df) == slow_groups(rows)


def test_one_row_of_each_group_is_kept(spark):
    rows = [(3, "x"), (None, "x"), (1, "x"), (1, "x"), (None, "y"), (None, "y"), (2, None), (5, "")]
    kept = [(r.doc_id, r.keep_id, r.group_size) for r in copies.group_copies(documents(spark, rows)).collect() if r.kept]
    assert sorted(kept, key=repr) == [(1, 1, 4), (2, 2, 2), (None, None, 2)]
    left = copies.drop_copies(documents(spark, rows))
    assert left.columns == documents(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == [(1, "x"), (2, None), (None, "y")]


def test_a_group_with_a_third_of_all_rows(spark, settings):
    settings(shuffle__partitions="40", autoBroadcastJoinThreshold="-1")
    rng = random.Random(1)
    rows = [(i, "copied  text" if i % 3 == 0 else f"text {rng.randint(0, 900)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    assert found(copies.group_copies(df)) == slow_groups(rows)


def test_rounds_cover_all_runs():
    for rows, least in ((0, 1), (1000, 12), (10**6, 51), (10**6, 211), (10**11, 5000)):
        ways, rounds = copies.shape(rows, least)
        assert 2 <= ways <= copies.MOST_WAYS and rounds >= 2
        assert ways**rounds >= max(least, rows / copies.ROWS_OF_A_RUN)
    assert copies.shape(50 * 10**9, 5000)[1] == 4


def test_runs_merge_alike_whatever_their_number(spark):
    rows = [(i, f"text {i % 37}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    results = set()
    for ways, rounds in ((2, 2), (3, 3), (16, 2)):
        made = copies.digests(df, "doc_id", "text", copies.F.col("doc_id"))
        merged = copies.merge_runs(made, ways, rounds).collect()
        results.add(frozenset((bytes(r.sha), r["first"].id, r.n) for r in merged))
    assert len(results) == 1
    assert {n for _, _, n in results.pop()} == {13, 14}


def test_empty_table(spark):
    assert copies.group_copies(documents(spark, [])).collect() == []
