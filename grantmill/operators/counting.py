"""Counts of patents per entity, country and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantmill.functions.text import share


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def year_min_max(patents: DataFrame, first: str = "first_year", last: str = "last_year") -> DataFrame:
    return patents.agg(F.min("year").alias(first), F.max("year").alias(last))


def year_between(first: int, last: int) -> Column:
    return F.col("year").between(first, last)


def patents_per_year(patents: DataFrame, first: int, last: int, name: str = "patent_count") -> DataFrame:
    return patents.where(year_between(first, last)).groupBy("year").agg(F.count("*").alias(name))


def distinct_patents_by(pairs: DataFrame, *keys: str, name: str = "patent_count") -> DataFrame:
    """Distinct patents per key, for rows in which a patent may repeat under a key.

    Spark first removes repeats by key and patent, so a hot key is counted by many tasks.
    """
    return pairs.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.countDistinct("patent_id").alias(name))


def count_pairs_by(pairs: DataFrame, key: str, name: str = "patent_count") -> DataFrame:
    """The same count for pairs that are already distinct: one combined count, no set of patents."""
    return pairs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("patent_id").alias(name))


def with_share(df: DataFrame, total: DataFrame, name: str, digits: int = 2, value: str = "patent_count") -> DataFrame:
    """Add a rounded percentage of a total; ``total`` is one row of one column."""
    return df.withColumn(name, share(F.col(value), total.scalar(), digits))


def rows_dropped(df: DataFrame, *keys: str) -> DataFrame:
    """Rows before, after and removed by a null-key filter, in one pass."""
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return df.agg(
        F.count("*").alias("rows_before"),
        F.count_if(complete).alias("rows_after"),
        F.count_if(~complete).alias("rows_dropped"),
    )
