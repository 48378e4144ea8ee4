"""Top-k lists and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked_size(k: int, least: int = 0, most: int | None = None) -> int:
    """A row limit as a plain integer inside its range."""
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError(f"a row limit must be an integer, not {k!r}")
    if k < least or (most is not None and k > most):
        raise ValueError(f"row limit {k} is outside {least}..{most}")
    return k


MOST_BROADCAST_ROWS = 10_000


def few(df: DataFrame, k: int) -> DataFrame:
    """A result of at most k rows, to be broadcast if that is few; a longer one is joined as its size asks for."""
    return F.broadcast(df) if k <= MOST_BROADCAST_ROWS else df


def top_k(df: DataFrame, k: int, value: str, *ties: str) -> DataFrame:
    """The k largest, ties in key order; every task keeps only its own k rows."""
    return df.orderBy(F.desc(value), *ties).limit(checked_size(k))


def head_n(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(checked_size(n))


def tail_n(df: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows with the largest keys, in ascending order."""
    return df.orderBy(F.desc(key)).limit(checked_size(n)).orderBy(key)


def with_position(top: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """Number the rows of a top-k result from 1. Only for results with a limit."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def with_ranks_of_top(top: DataFrame, value: str) -> DataFrame:
    """``rank`` and ``dense_rank`` of a top-k result by falling value.

    All larger values are in the result itself, so the ranks equal those among all rows.
    """
    falling = Window.orderBy(F.desc(value))
    return top.withColumns({"rank": F.rank().over(falling), "dense_rank": F.dense_rank().over(falling)})


def rank_by_counts(df: DataFrame, value: str, within: Sequence[str] = (), *, rank: str = "rank", dense: str = "dense_rank") -> DataFrame:
    """``rank`` and ``dense_rank`` of every row by falling count, with no sort of all rows.

    ``value`` holds positive integer counts. Rows of equal count share their
    ranks, so it is enough to rank the histogram of counts. Counts that add up
    to N have at most sqrt(2 N) different values, some million for a trillion
    pairs, which bounds the histogram that is broadcast back.
    """
    histogram = df.groupBy(*within, value).agg(F.count("*").alias("_rows"))
    falling = Window.partitionBy(*within).orderBy(F.desc(value))
    above = falling.rowsBetween(Window.unboundedPreceding, -1)
    ranks = histogram.select(
        *within,
        value,
        (F.coalesce(F.sum("_rows").over(above), F.lit(0)) + 1).cast("bigint").alias(rank),
        F.row_number().over(falling).cast("bigint").alias(dense),
    )
    return df.join(F.broadcast(ranks), [*within, value])


def top_k_per_group(df: DataFrame, k: int, group: str, value: str, rank: str = "rank") -> DataFrame:
    """Rows of rank k or better in their group; ties may give more than k.

    The rank limit is applied before the shuffle too, so no task sees a whole group.
    """
    falling = Window.partitionBy(group).orderBy(F.desc(value))
    return df.withColumn(rank, F.rank().over(falling)).where(F.col(rank) <= checked_size(k))
