"""Writing cleaned tables, the target tables and reports."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from grantmill.operators.columns import align_to_schema
from grantmill.operators.integrity import surrogate_id
from grantmill.schemas import TARGETS

# Names of the report files.
REPORT_FILES = ("top_inventors", "top_companies", "country_trends", "yearly_trends")


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Replace one cleaned table and return its row count, counted while writing."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(fmt).save(path)
    return seen.get["rows"]


def write_raw(df: DataFrame, path: str, sep: str = "\t") -> str:
    """Write a table in the raw delimited form the readers take."""
    (
        df.write.mode("overwrite")
        .option("sep", sep)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def write_table(df: DataFrame, path: str) -> None:
    """Append rows to a target table."""
    df.write.mode("append").parquet(path)


def recreate_tables(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Replace the four target tables, typed, in dependency order, and read them back.

    Relationships without an id are numbered 1..n.
    """
    loaded = {}
    for name, schema in TARGETS.items():
        path = f"{root}/{name}"
        df = tables[name]
        if name == "relationships" and "id" not in df.columns:
            df = surrogate_id(df)
        align_to_schema(df, schema).write.mode("overwrite").parquet(path)
        loaded[name] = spark.read.schema(schema).parquet(path)
    return loaded


def export_reports_csv(results: Mapping[str, DataFrame], root: str) -> dict[str, str]:
    """One CSV file per report. Each report has at most 50 rows, so one task writes it."""
    paths = {}
    for name in REPORT_FILES:
        paths[name] = f"{root}/{name}"
        results[name].coalesce(1).write.mode("overwrite").option("header", True).csv(paths[name])
    return paths


def export_report_json(report: DataFrame, path: str) -> str:
    """The nested one-row summary as one JSON document."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, row_count)`` of every target table."""
    counts = [
        tables[name].agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        for name in TARGETS
    ]
    return functools.reduce(DataFrame.unionByName, counts)
