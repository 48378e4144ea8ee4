"""Connected components of links, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantmill.llm.common import checkpoint


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the smallest node reachable by the links (a, b) of one task."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        open_ = label[a] != label[b]
        if not open_.any():
            break
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root): every node of a link once, with the smallest node it can reach.

    Large and small stars in turn: each node first hands its larger neighbours, then its
    smaller ones, to the least node it knows. Minima are combined before the shuffle;
    the joins have one row per node on one side, so that adaptive execution can split a
    node with very many links. Links with a null end and self links say nothing and go.
    No links give no rows.
    """
    edges = checkpoint(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where((F.col(a) != F.col(b)))
        .distinct()
    )
    seen = _signature(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("low").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                )
            ).alias("edge")
        )
        edges = checkpoint(small.select("edge.*").where("u <> v").distinct())
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _signature(edges: DataFrame) -> tuple:
    """Changes with the set of edges: their number and a sum of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
