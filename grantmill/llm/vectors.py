"""Near-duplicates and exact search over tables of vectors.

near_duplicates: spherical k-means assigns vectors to cells, blocked cosine products
compare within cells, one representative of each group is kept.

top_k: a Voronoi join. Queries and data are grouped by pivots; summaries of the groups
bound every score; only rows that a group of queries may need are sent to it; each group
is solved in chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.llm.common import checkpoint, ship
from grantmill.llm.graph import components, forest

# Vectors that k-means is fitted on, and its rounds.
FIT_ROWS = 20_000
FIT_ROUNDS = 10
# A vector also joins cells whose centroid is nearly as close as the nearest one.
MARGIN = 0.12
BLOCK_ROWS = 1024


def usable(vector: str) -> Column:
    """Not null, not empty, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first so that squares neither vanish nor overflow."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spherical_k_means(unit: np.ndarray, k: int, rounds: int = FIT_ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors, at most k of them."""
    rng = np.random.default_rng(seed)
    centroids = unit[rng.choice(len(unit), min(k, len(unit)), replace=False)]
    for _ in range(rounds):
        cell = np.concatenate([(unit[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(unit), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def near_duplicates(
    df: DataFrame,
    threshold: float = 0.9,
    margin: float = MARGIN,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one for each row.

    n_links counts the other rows whose cosine with this one is at least the threshold,
    component_id is the smallest id that links lead to, kept says whether that is the
    row's own. Rows with equal vectors are linked and compared as one. Vectors that are
    null, empty or zero, or have a null or non-finite component, and vectors of another
    length link with nothing. Pairs in cells that neither vector reaches are missed; the
    tests measure how many. k-means is fitted on at most FIT_ROWS vectors, and the number
    of cells is half the root of the number of different vectors.
    """
    spark = ship(df.sparkSession)
    given = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = usable("v") & F.exists("v", lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    valid = given.where(good)
    # -0.0 and 0.0 are the same component.
    valid = valid.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    classes = checkpoint(
        valid.groupBy("v")
        .agg(F.min("id").alias("least"), F.count("*").alias("n"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().collect()}
    found = None
    for dim, total in sorted(sizes.items()):
        some = _links(spark, classes.where(F.size("v") == dim), dim, total, threshold, margin, block_rows)
        found = some if found is None else found.unionByName(some)
    alone = given.where(~good).select(
        F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    if found is None:
        return alone.withColumn("kept", F.lit(True))
    found = checkpoint(found)
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root"), "node", "root")
    told = classes.join(linked, "node", "left").join(roots, "node", "left").select(
        "v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    told = checkpoint(told)
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    named = told.join(least, "root").select("v", "n_links", "component_id")
    out = valid.join(named, "v").select(F.col("id").alias(id_col), "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _links(spark, classes: DataFrame, dim: int, total: int, threshold: float, margin: float, block_rows: int) -> DataFrame:
    """Rows (node, links, root): links found of a node in one block, and a node it is connected with."""
    k = max(1, math.ceil(math.sqrt(total) / 2))
    sample = classes.orderBy(F.xxhash64("v")).limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
    centroids = spark.sparkContext.broadcast(spherical_k_means(_unit(_matrix(sample, dim)), k))
    cell_type = "node long, n long, v array<double>, cells array<int>"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = _unit(_matrix(part.column("v"), dim)) @ centroids.value.T
                best = near.argmax(axis=1)
                close = near >= near[np.arange(len(near)), best][:, None] - margin
                cells = [[b, *(c for c in np.flatnonzero(row).tolist() if c != b)] for b, row in zip(best.tolist(), close, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("n"), part.column("v"), pa.array(cells, pa.list_(pa.int32()))],
                    names=["node", "n", "v", "cells"],
                )

    assigned = checkpoint(classes.select("node", "n", "v").mapInArrow(assign, cell_type))
    core = assigned.withColumn("cell", F.col("cells")[0])
    every = assigned.withColumn("cell", F.explode("cells"))
    # One row per cell: how many blocks its own vectors and all its vectors make.
    per_cell = F.broadcast(
        checkpoint(
            every.groupBy("cell")
            .agg(F.count("*").alias("all_rows"), F.count_if(F.col("cell") == F.col("cells")[0]).alias("core_rows"))
            .select(
                "cell",
                F.ceil(F.col("core_rows") / block_rows).cast("int").alias("lefts"),
                F.ceil(F.col("all_rows") / block_rows).cast("int").alias("rights"),
            )
        )
    )
    spread = F.pmod(F.xxhash64("node"), F.lit(2**31)).cast("int")
    left = core.join(per_cell, "cell").select(
        "cell", (spread % F.col("lefts")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), "node", "n", "v", "cells"
    )
    right = (
        every.join(per_cell, "cell")
        .where("lefts > 0")
        .select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), (spread % F.col("rights")).alias("j"), *(F.col(c).alias(f"other_{c}") for c in ("node", "n", "v", "cells"))
        )
    )

    def compare(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"node": [], "links": [], "root": []}
        if a.num_rows and b.num_rows:
            cell = key[0].as_py()
            b = b.rename_columns([c.removeprefix("other_") for c in b.column_names])
            x, y = (_unit(_matrix(t.column("v").combine_chunks(), dim)) for t in (a, b))
            xn, yn = a.column("node").to_numpy(), b.column("node").to_numpy()
            r, c = np.nonzero(x @ y.T >= threshold)
            other = xn[r] != yn[c]
            r, c = r[other], c[other]
            links_x = np.bincount(r, b.column("n").to_numpy()[c], len(xn)).astype(np.int64)
            # A guest's links are counted here unless its own cell sees the pair as well.
            homes = np.array([row[0] for row in b.column("cells").to_pylist()])
            reach = [set(row) for row in a.column("cells").to_pylist()]
            once = np.array([homes[j] != cell and homes[j] not in reach[i] for i, j in zip(r.tolist(), c.tolist(), strict=True)], bool)
            links_y = np.bincount(c[once], a.column("n").to_numpy()[r[once]], len(yn)).astype(np.int64)
            nodes, place = np.unique(np.concatenate([xn, yn]), return_inverse=True)
            root = nodes[forest(place[: len(xn)][r], place[len(xn) :][c], len(nodes))]
            links = np.bincount(place, np.concatenate([links_x, links_y]), len(nodes)).astype(np.int64)
            some = (links > 0) | (root != nodes)
            out = {"node": nodes[some], "links": links[some], "root": root[some]}
        return pa.table(out, schema=pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    keys = ["cell", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "node long, links long, root long")


# --- exact search ---------------------------------------------------------------------------

PIVOTS = 32
QUERIES_OF_A_GROUP = 512
ROWS_OF_A_CHUNK = 8192
LARGEST = float(2**62)


def whole_numbers(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component; far beyond what a long holds it stops at 2**62."""
    return F.transform(
        vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST)))
    )


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond a long they stop at its ends."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    group_queries: int = QUERIES_OF_A_GROUP,
    chunk_rows: int = ROWS_OF_A_CHUNK,
) -> DataFrame:
    """Rows (query_id, rank, id_col, score): each query's k highest inner products of
    floor(scale * vector), ties to the smaller id, all rows if there are fewer.

    Queries are the rows for which is_query holds; a query is compared with every row but
    itself. Rows without an id take no part, nor do vectors that are null or empty or have a
    null or non-finite component; vectors of different lengths aren't compared. Repeated
    rows and ids are rows of their own: each can be a result, and each query row has its
    own k results. Of rows with equal vectors only the k + 1 smallest ids can be in a
    result, so only they are sent to queries.

    A score s = q.x of a query at most R from pivot p and a row at distance d from pivot o
    lies within p.o +- (R |o| + (|p| + R) d). The k + 1 best lower bounds, known from the
    nearest rows of each pivot, give a score that every query of the group reaches; rows
    whose upper bound is lower aren't sent.
    """
    spark = ship(df.sparkSession)
    valid = df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        whole_numbers(vector_col, scale).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    # Written, so that a row keeps its number.
    valid = checkpoint(valid)
    kind = df.schema[id_col].dataType.simpleString()
    result = f"query_row long, query_id {kind}, row long, {id_col} {kind}, score long"
    best = None
    for dim, total, asking in sorted(tuple(r) for r in valid.groupBy(F.size("v")).agg(F.count("*"), F.count_if("asks")).collect()):
        if asking:
            some = _search(spark, valid.where(F.size("v") == dim), dim, total, asking, k, pivots, group_queries, chunk_rows, result, id_col)
            best = some if best is None else best.unionByName(some)
    if best is None:
        best = spark.createDataFrame([], result)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), id_col, "row"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def _search(
    spark, valid: DataFrame, dim: int, total: int, asking: int, k: int, pivots: int, group_queries: int, chunk_rows: int, result: str, id_col: str
) -> DataFrame:
    """Rows of each chunk's best k for every query."""
    picked = valid.orderBy(F.xxhash64("id"), "id", "row").limit(pivots).select("v").toArrow().column("v").combine_chunks()
    centers = _matrix(picked, dim)
    of_queries = max(1, min(len(centers), math.ceil(asking / group_queries)))
    told = spark.sparkContext.broadcast(centers)
    fields = [
        *valid.schema.fields,
        *(T.StructField(c, T.IntegerType()) for c in ("cell", "home")),
        *(T.StructField(c, T.DoubleType()) for c in ("cell_d", "home_d")),
    ]
    schema = T.StructType(fields)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = told.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column("v"), dim)
                square = (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * x @ p.T
                cell, home = square.argmin(axis=1), square[:, :of_queries].argmin(axis=1)
                # The distances themselves, as squares lose digits near a pivot.
                far = [np.linalg.norm(x - p[c], axis=1) for c in (cell, home)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(home.astype(np.int32)), *map(pa.array, far)],
                    names=schema.names,
                )

    located = checkpoint(valid.mapInArrow(locate, schema))
    queries = located.where("asks")
    same = Window.partitionBy("v").orderBy("id", "row")
    data = located.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1)
    # Summaries: at most k + 1 distances for each pivot, and two numbers for each group of queries.
    near = located.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("cell_d", "id", "row"))).where(F.col("n") <= k + 1)
    nearest = [(r[0], r[1]) for r in near.select("cell", "cell_d").collect()]
    groups = {r[0]: (r[1], r[2]) for r in queries.groupBy("home").agg(F.count("*"), F.max("home_d")).collect()}
    norm = np.linalg.norm(centers, axis=1)
    plan = []
    for home, (n, radius) in groups.items():
        middle = centers @ centers[home]
        slope = norm[home] + radius
        lower = sorted((middle[c] - radius * norm[c] - slope * d for c, d in nearest), reverse=True)
        reached = lower[k] if len(lower) > k else -math.inf
        reached -= 1e-6 * (1 + abs(reached)) if math.isfinite(reached) else 0
        for cell in range(len(centers)):
            least = (reached - middle[cell] - radius * norm[cell]) / slope if slope > 0 else -math.inf
            plan.append((cell, home, max(1, math.ceil(n / group_queries)), float(least)))
    needs = F.broadcast(spark.createDataFrame(plan, "cell int, home int, parts int, least double"))
    spread = F.pmod(F.xxhash64("id", "row"), F.lit(2**31)).cast("int")
    reached = data.select("id", "row", "v", "cell", "cell_d").join(needs, "cell").where(F.col("cell_d") >= F.col("least"))
    # Chunks by the rows that a group of queries needs, not by those there are.
    needed = {r[0]: r[1] for r in reached.groupBy("home").count().collect()}
    sizes = sorted({(h, n, math.ceil(needed[h] / chunk_rows)) for _, h, n, _ in plan if needed.get(h)})
    if not sizes:
        return spark.createDataFrame([], result)
    parts = F.broadcast(spark.createDataFrame(sizes, "home int, of_parts int, chunks int"))
    sent = (
        reached.drop("parts")
        .join(parts, "home")
        .select("home", F.explode(F.sequence(F.lit(0), F.col("of_parts") - 1)).alias("part"), (spread % F.col("chunks")).alias("chunk"),
                F.col("id").alias("other_id"), F.col("row").alias("other_row"), F.col("v").alias("other_v"))
    )
    asked = queries.join(parts, "home").select(
        "home", (spread % F.col("of_parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "row", "v"
    )

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list = [[], [], [], [], []]
        if a.num_rows and b.num_rows:
            found = (a.column("v"), b.column("other_v"))
            q, x = (np.array(v.combine_chunks().flatten()).reshape(-1, dim) for v in found)
            b_ids, b_rows = np.array(b.column("other_id").to_pylist(), object), b.column("other_row").to_numpy()
            by_row = np.argsort(b_rows, kind="stable")
            by_id = by_row[np.argsort(b_ids[by_row], kind="stable")]
            x, b_ids, b_rows = x[by_id], b_ids[by_id], b_rows[by_id]
            askers = zip(a.column("row").to_pylist(), a.column("id").to_pylist(), strict=True)
            for at in range(0, len(q), 128):
                scores = _products(q[at : at + 128], x)
                for row in scores:
                    own, own_id = next(askers)
                    cut = np.partition(row, -(k + 1))[-(k + 1)] if len(row) > k + 1 else row.min()
                    some = np.flatnonzero((row >= cut) & (b_rows != own))
                    some = some[np.argsort(-row[some].astype(np.float64), kind="stable")] if np.abs(row).max() < 1 << 53 else np.array(sorted(some.tolist(), key=lambda i: -int(row[i])), int)
                    some = some[:k]
                    out[0] += [own] * len(some)
                    out[1] += [own_id] * len(some)
                    out[2] += b_rows[some].tolist()
                    out[3] += b_ids[some].tolist()
                    out[4] += row[some].tolist()
        kind = a.schema.field("id").type
        kinds = (pa.int64(), kind, pa.int64(), kind, pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["query_row", "query_id", "row", id_col, "score"])

    keys = ["home", "part", "chunk"]
    return asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, result)
