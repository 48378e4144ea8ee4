"""Joins that keep working when one key holds a large part of the rows.

No side is broadcast by hint unless its size has a stated bound. Spark
broadcasts what its size check allows; beyond that a join sorts and merges, and
adaptive execution splits a hot key where the join type lets it: inner on both
sides, left outer, semi and anti on the left. Hence the rules of this module:
the side that may be hot is the left one or the join is inner, a full outer join
is put together from others, and both sides reach the join straight from an
exchange, as only those can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NULL_BUCKETS = 1024


def fresh_key(df: DataFrame, *keys: str) -> DataFrame:
    """The same table with text keys that no earlier grouping is known to be grouped by.

    A join below which a table was just grouped by the key would use that
    grouping in place, and a hot key could then not be split. With a computed
    key it gets an exchange of its own. A table read from files needs that
    exchange anyway.
    """
    return df.withColumns({key: F.concat(F.col(key), F.lit("")) for key in keys})


def lookup_left(left: DataFrame, right: DataFrame, key: str, spread_by: str, keep_as: str | None = None) -> DataFrame:
    """Left join to a table with one row per key, where ``left`` may hold many null keys.

    Null keys match nothing but would all go to one task. They get a stand-in
    text, spread by another column, and their right side is set to null. ``keep_as`` names a column
    for the key with its stand-ins, which the rows are then grouped by.
    """
    bucket = F.pmod(F.xxhash64(spread_by), F.lit(_NULL_BUCKETS)).cast("string")
    spread = left.withColumn("_lookup", F.coalesce(F.col(key), F.concat(F.lit("\x00"), bucket)))
    found = spread.join(fresh_key(right, key).withColumnRenamed(key, "_lookup"), "_lookup", "left")
    added = [c for c in right.columns if c != key]
    kept = [F.col("_lookup").alias(keep_as)] if keep_as else []
    return found.select(*left.columns, *kept, *[F.when(F.col(key).isNotNull(), F.col(c)).alias(c) for c in added])


def keep_valid_patents(pairs: DataFrame, patents: DataFrame) -> DataFrame:
    """Rows whose patent exists."""
    return pairs.join(fresh_key(patents.select("patent_id"), "patent_id"), "patent_id", "left_semi")


def null_out_orphans(df: DataFrame, key: str, dimension: DataFrame, spread_by: str = "patent_id") -> DataFrame:
    """Set a key to null where it has no row in the dimension, which holds each key once; the row stays."""
    known = dimension.select(key).where(F.col(key).isNotNull()).withColumn("_known", F.lit(True))
    kept = F.when(F.col("_known"), F.col(key))
    return lookup_left(df, known, key, spread_by).withColumn(key, kept).select(*df.columns)


def _with_id(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("patent_id").isNotNull())


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of the patents that the other table does not have.

    Both sides are filtered as the inner join filters them, so that Spark sees the same
    exchange and makes it once.
    """
    return rows.join(others.select("patent_id"), "patent_id", "left_anti")


def pair_per_patent(inventors: DataFrame, companies: DataFrame) -> DataFrame:
    """Every inventor of a patent with every company of it; one-sided patents keep nulls.

    The full outer join is put together from an inner join and the two
    unmatched parts, each of which can be split at a hot patent. Columns beside
    the ids are carried along. Rows without a patent go.
    """
    inventors = _with_id(fresh_key(_with_id(inventors), "patent_id"))
    companies = _with_id(fresh_key(_with_id(companies), "patent_id"))
    return (
        inventors.join(companies, "patent_id")
        .unionByName(_without(inventors, companies), allowMissingColumns=True)
        .unionByName(_without(companies, inventors), allowMissingColumns=True)
    )


def with_patent(pairs: DataFrame, patents: DataFrame, paired: DataFrame | None = None) -> DataFrame:
    """Left join of patents to pairs of loaded patents, written so that a patent with many pairs can be split.

    ``paired`` names the patents that have pairs, where that is cheaper to read than the pairs.
    """
    with_pairs = fresh_key(pairs, "patent_id").join(fresh_key(patents, "patent_id"), "patent_id")
    others = pairs if paired is None else paired
    alone = _without(fresh_key(patents, "patent_id"), fresh_key(others.select("patent_id").distinct(), "patent_id"))
    return with_pairs.unionByName(alone, allowMissingColumns=True)
