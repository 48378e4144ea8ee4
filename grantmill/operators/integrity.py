"""Key checks, foreign-key repair and surrogate ids."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantmill.operators.joins import keep_valid_patents, null_out_orphans
from grantmill.session import materialize


def check_unique_key(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(key).agg(F.count("*").alias("row_count")).where("row_count > 1")


def check_not_null(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of the rows that lack a required value."""
    return df.where(F.col(column).isNull()).select(key)


def check_foreign_keys(relationships: DataFrame, dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """``(foreign_key, missing_id, row_count)`` of every id without a dimension row.

    Ids are counted before they are looked up, so each is sent and joined once.
    """

    def orphans(key: str, dimension: DataFrame) -> DataFrame:
        used = relationships.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("row_count"))
        lost = used.join(dimension.select(key), key, "left_anti")
        return lost.select(F.lit(key).alias("foreign_key"), F.col(key).alias("missing_id"), "row_count")

    return functools.reduce(DataFrame.unionByName, [orphans(k, d) for k, d in dimensions.items()])


def repair_foreign_keys(
    relationships: DataFrame, patents: DataFrame, inventors: DataFrame, companies: DataFrame
) -> DataFrame:
    """Keep relationships of loaded patents and set orphaned inventor and company ids to null."""
    kept = keep_valid_patents(relationships, patents)
    kept = null_out_orphans(kept, "inventor_id", inventors.select("inventor_id").distinct())
    return null_out_orphans(kept, "company_id", companies.select("company_id").distinct())


def surrogate_id(df: DataFrame, *order: str | Column, name: str = "id") -> DataFrame:
    """Number all rows 1..n without a gap, in the given order if there is one.

    Rows are numbered inside their partition and each partition adds the row
    count of those before it. The numbers are written before they are used,
    because a partition computed again may hold other rows. The input of a sort
    is written too: the sort samples it first and would compute it twice. What
    is broadcast, and summed in one task, is one row per partition.
    """
    placed = df
    if order:
        placed = materialize(df, "unordered").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumns(
        {
            # The id packs the partition number above 33 bits of row number.
            "_partition": F.shiftright("_place", 33),
            "_row": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_partition").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_partition", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_partition").select(
        (F.col("_offset") + F.col("_row") + 1).cast("bigint").alias(name), *df.columns
    )
