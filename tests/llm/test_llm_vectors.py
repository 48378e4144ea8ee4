from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from grantmill.llm import queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, score string, rank int, cell int"
NAN, INF = float("nan"), float("inf")
ODD = [
    (900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [NAN]), (904, [INF] + [1.0] * 7), (905, [1.0] * 7 + [None]),
    (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [1.0] * 8), (908, [1.0] * 8), (908, [1.0] * 8), (1000, [-0.0] + [1.0] * 7), (1100, [0.0] + [1.0] * 7),
]


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "y", 1, 2) for i, v in rows], SCHEMA)


def clusters(n, seed=0, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    near = base[rng.integers(0, len(base), n - len(base))]
    all_ = np.concatenate([base, near + rng.normal(size=near.shape) * 0.12]).astype(np.float32)
    return [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(all_)), all_, strict=True)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def slow_links(rows, threshold):
    unit = [np.array(v, float) / np.linalg.norm(v) if usable(v) and any(v) else None for _, v in rows]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]):
                linked[i, j] = unit[i] @ unit[j] >= threshold
    root = np.arange(n)
    for _ in range(n):
        new = np.array([min([root[i], *root[linked[i]]]) for i in range(n)])
        if (new == root).all():
            break
        root = new
    out = []
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((own, int(linked[i].sum()), least, own == least))
    return out


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_near_duplicates_as_by_comparing_all(spark, block_rows):
    rows = clusters(240) + ODD
    got = vectors.near_duplicates(table(spark, rows), block_rows=block_rows, margin=0.4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(slow_links(rows, 0.9), key=repr)


def test_recall_with_the_margin_in_use(spark):
    rows = clusters(1200, seed=5, dim=32)
    got = vectors.near_duplicates(table(spark, rows)).collect()
    want = sum(r[1] for r in slow_links(rows, 0.9))
    found = sum(r.n_links for r in got)
    assert 0.98 * want <= found <= want


def slow_top_k(rows, k, divisor):
    """Every row against every other, whatever the ids."""
    valid = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for at, (own, q) in enumerate(valid):
        if own % divisor == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for n, (i, v) in enumerate(valid) if n != at and len(v) == len(q))
            out += [(own, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_repeated_rows_and_ids_are_rows_of_their_own(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(0, [float(x) for x in rng.normal(size=4)]) for _ in range(13)]
    rows += [(1, [2.0, 2.0, 2.0, 2.0])] * 3 + [(100, [1.0, 0.0, 0.0, 1.0])] * 2
    rows += [(i, [float(x) for x in rng.normal(size=4)]) for i in range(2, 17)]
    found = vectors.top_k(table(spark, rows), F.col("vec_id") % 100 == 0, k=10, chunk_rows=7, group_queries=3, pivots=4)
    assert sorted(tuple(r) for r in found.collect()) == slow_top_k(rows, 10, 100)
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(queries.TOP_K_SQL).fetchall()) == slow_top_k(rows, 10, 100)


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 50, "group_queries": 4, "pivots": 6}])
def test_top_k_as_by_comparing_all(spark, options):
    hot = [(2000 + i, [0.5] * 8) for i in range(40)]
    rows = clusters(200, seed=2) + ODD + hot
    got = vectors.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, k=10, **options)
    assert sorted(tuple(r) for r in got.collect()) == slow_top_k(rows, 10, 20)


def test_pruned_rows_are_not_needed(spark):
    # Two far groups of unequal length: most bounds fall below what a query reaches.
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in (10 if i % 2 else 0.01) * (1 + 0.01 * rng.normal(size=4))]) for i in range(200)]
    got = vectors.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, k=3, pivots=8)
    assert sorted(tuple(r) for r in got.collect()) == slow_top_k(rows, 3, 50)


def test_large_components_are_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, -1.0]), (2, [1e6, 1.5])]
    got = vectors.top_k(table(spark, rows), F.col("vec_id") == 0, k=2)
    assert sorted(tuple(r) for r in got.collect()) == slow_top_k(rows, 2, 10)


def test_empty_tables(spark):
    empty = table(spark, [])
    assert vectors.near_duplicates(empty).collect() == []
    assert vectors.top_k(empty, F.lit(True)).collect() == []
    bad = table(spark, [(1, None), (2, [NAN])])
    assert sorted(tuple(r) for r in vectors.near_duplicates(bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert vectors.top_k(bad, F.lit(True)).collect() == []
