"""One row per key, without gathering a key's rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ranks(columns: Sequence[str]) -> Column:
    """A struct that orders by the columns, each with nulls last."""
    flagged = [[F.col(c).isNull().alias(f"_null_{i}"), F.col(c)] for i, c in enumerate(columns)]
    return F.struct(*[x for pair in flagged for x in pair])


def keep_first(
    df: DataFrame, key: str, order: Sequence[str] = (), where: Column | None = None, by_column: bool = False
) -> DataFrame:
    """The first row of every key, by ``order`` and then by the other columns as listed; nulls come last.

    A minimum is combined before the shuffle, so a key that holds a third of
    all rows still sends one row per task. ``where`` limits the rows that may be
    first; unlike a filter below it, it does not compute a derived column twice.

    With ``by_column`` each column is taken from the minimum over the columns up
    to it. All of them still belong to the same first row, but the optimizer
    can drop the columns a caller does not read: order wide texts last.
    """
    ranked = [*order, *[c for c in df.columns if c != key and c not in order]]
    if not by_column:
        row = _ranks(ranked)
        first = df.groupBy(key).agg(F.min(row if where is None else F.when(where, row)).alias("_first"))
        return first.where(F.col("_first").isNotNull()).select(key, *[F.col("_first")[c].alias(c) for c in ranked]).select(*df.columns)
    if where is not None:
        df = df.where(where)
    head = ranked[0]
    # A plain minimum passes over nulls as well, and a number or date is aggregated by hash.
    firsts = [F.min(head).alias(head)]
    firsts += [F.min(_ranks(ranked[: i + 1]))[c].alias(c) for i, c in enumerate(ranked) if i > 0]
    return df.groupBy(key).agg(*firsts).select(*df.columns)


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows with no null in them; duplicates go before the shuffle, the rest after it."""
    return df.select(*columns).na.drop("any").distinct()
