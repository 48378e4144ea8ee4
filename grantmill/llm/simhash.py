"""SimHash near-duplicates: fingerprints, and meet-in-the-middle ball hashing to link them.

Two fingerprints at most `radius` bits apart share a value that is at most half the
radius from each. Every fingerprint emits all such values; equal values meet in a
shuffle. Values are shuffled by their leading bits: one row (bucket, fingerprint)
stands for all values of a fingerprint in that bucket, which its task spells out.
With b leading bits and radius 4 that is 1 + b + b(b-1)/2 rows, and not 2081.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.llm.common import checkpoint, chunks, free_name, ship, texts
from grantmill.llm.graph import components, forest

BITS = 64
# Values that one bucket should hold, and that one step inside a bucket may hold.
BUCKET_VALUES = 1 << 20
STEP_VALUES = 1 << 22
MOST_BUCKET_BITS = 24
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; zero without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) <= shingle:
        return digest(line)
    ends = (np.fromiter(map(len, words), np.int64, len(words)) + 1).cumsum() - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    begin, end = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(begin), SHINGLES_AT_ONCE):
        cuts = zip(begin[at : at + SHINGLES_AT_ONCE], end[at : at + SHINGLES_AT_ONCE], strict=True)
        hashes = np.array([digest(line[i:j]) for i, j in cuts], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = (2 * counts > len(begin)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(
    df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """Rows (id_col, fp) and row_col if given: the fingerprint as a signed long, one row for each row.

    ASCII letters are lowered and words are what ASCII white space separates. A text of
    fewer words than a shingle has one shingle. Null and empty texts have fingerprint 0.
    """
    ship(df.sparkSession)
    kept = [id_col, *([row_col] if row_col else [])]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("fp", T.LongType(), False)])
    if row_col:
        schema.add(T.StructField(row_col, df.schema[row_col].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                made = np.array([fingerprint(t, shingle) for t in texts(part, 1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made), *part.columns[2:]], names=schema.names)

    return df.select(id_col, text_col, *kept[1:]).mapInArrow(run, schema)


@lru_cache(maxsize=16)
def flips(bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of at most so many of the lowest bits, and how many bits each has."""
    found = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]
    return np.array(found, np.uint64), np.array([m.bit_count() for m in found], np.int8)


def bucket_links(prints: np.ndarray, used: np.ndarray, low_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of one bucket, as a forest: (fingerprint, its root).

    prints: fingerprints; used: the leading bits each flips to reach this bucket. Equal
    values join a value's fingerprints to one of them that is at most radius // 2 away
    (the others may be one further for an odd radius), so no pairs within a group are
    spelled out. Each joined pair's bit distance is checked.
    """
    near, far = radius // 2, radius - radius // 2
    masks, weights = flips(low_bits, far)
    low = prints & np.uint64((1 << low_bits) - 1)
    total = sum(int((used == t).sum()) * int((weights <= far - t).sum()) for t in range(far + 1))
    step_bits = min(low_bits, max(0, math.ceil(math.log2(max(total, 1) / STEP_VALUES))))
    step_mask = np.uint64((1 << step_bits) - 1)
    parts = masks & step_mask
    own = low & step_mask
    by_part = {int(p): np.flatnonzero(parts == p) for p in np.unique(parts)}
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange((1 << step_bits) + 1, dtype=np.uint64))
    root = np.arange(len(prints))
    for step in range(1 << step_bits):
        values, owners, costs = [], [], []
        for part, which in by_part.items():
            home = step ^ part
            rows = order[edges[home] : edges[home + 1]]
            for t in range(far + 1):
                some, m = rows[used[rows] == t], which[weights[which] <= far - t]
                if len(some) and len(m):
                    values.append((low[some][:, None] ^ masks[m]).ravel())
                    owners.append(np.repeat(some, len(m)))
                    costs.append(np.tile(weights[m] + t, len(some)))
        if not values:
            continue
        value, owner = np.concatenate(values), np.concatenate(owners)
        if near == far:
            by_value = np.argsort(value, kind="stable")
        else:
            by_value = np.lexsort((np.concatenate(costs), value))
        value, owner = value[by_value], owner[by_value]
        same = np.concatenate([[False], value[1:] == value[:-1]])
        if not same.any():
            continue
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(value))))
        ok = same
        if near != far:
            ok = same & (np.concatenate(costs)[by_value][first] <= near)
        a, b = owner[ok], owner[first[ok]]
        pairs = np.unique(a.astype(np.int64) * len(prints) + b)
        a, b = pairs // len(prints), pairs % len(prints)
        close = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        a, b = a[close], b[close]
        rest = np.arange(len(prints))
        root = forest(np.concatenate([a, rest]), np.concatenate([b, root]), len(prints))
    moved = np.flatnonzero(root != np.arange(len(prints)))
    return prints[moved], prints[root[moved]]


def link_fingerprints(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Rows (fp, root) for the different fingerprints in column fp that have a link.

    Two fingerprints have the same root exactly if steps of at most `radius` differing
    bits lead from one to the other through given fingerprints. Null fingerprints go.
    """
    if not 0 <= radius <= 8:
        raise ValueError("the ball of half the radius is spelled out: radius is 0 to 8")
    spark = ship(prints.sparkSession)
    different = checkpoint(prints.select("fp").where("fp is not null").distinct())
    n = different.count()
    far = radius - radius // 2
    values = n * sum(math.comb(BITS, k) for k in range(far + 1))
    bits = min(MOST_BUCKET_BITS, max(1, math.ceil(math.log2(max(values, 1) / BUCKET_VALUES))))
    low_bits = BITS - bits
    # Fixed by radius and bits: at most a few thousand masks.
    masks = F.array(*[F.lit(int(m)) for m in flips(bits, far)[0]])
    spread = different.select("fp", F.explode(masks).alias("mask")).select(
        "fp",
        F.shiftrightunsigned("fp", low_bits).cast("int").bitwiseXOR(F.col("mask")).alias("bucket"),
        F.bit_count("mask").alias("used"),
    )

    def run(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        a, b = bucket_links(fp, group.column("used").to_numpy(), low_bits, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    links = spread.groupBy("bucket").applyInArrow(run, "a long, b long")
    found = components(links, "a", "b")
    return found.select(F.col("node").alias("fp"), "root")


def near_duplicates(
    df: DataFrame,
    shingle: int = 4,
    radius: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """Rows (id_col, fp, component_id) and row_col if given, one for each row.

    component_id is the smallest id among the documents that steps of at most `radius`
    differing bits lead to, itself included; null if all their ids are null. Repeated
    rows and texts without words (fingerprint 0) link like any others. With row_col, a
    column of different longs, there is also `first`: the row of the component with the
    smallest id, nulls last, then the smallest number.
    """
    own = checkpoint(fingerprints(df, shingle, id_col, text_col, row_col))
    first = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), *([F.col(row_col).alias("row")] if row_col else []))
    classes = own.groupBy("fp").agg(F.min(first).alias("least"))
    rooted = classes.join(link_fingerprints(own, radius), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = checkpoint(rooted)
    # The least of each root is joined back by an exchange of its own, which can be split
    # at a root with very many fingerprints.
    roots = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("root").bitwiseXOR(F.lit(0)).alias("root"), "least")
    named = rooted.select("fp", "root").join(roots, "root").select("fp", F.col("least.id").alias("component_id"), "least")
    found = own.join(named, "fp")
    if row_col is None:
        return found.select(id_col, "fp", "component_id")
    return found.select(id_col, "fp", "component_id", row_col, F.col("least.row").alias("first"))


def keep_one(df: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of near-duplicates: that of the smallest id, nulls last.

    Rows are told apart by their place, so repeated and null ids neither keep nor lose
    another text; of equal ids in a group the first row stays.
    """
    row = free_name("row_number", df)
    numbered = checkpoint(df.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(numbered, shingle, radius, id_col, text_col, row)
    kept = found.where(F.col(row) == F.col("first")).select(row)
    return numbered.join(kept, row, "left_semi").select(*df.columns)
