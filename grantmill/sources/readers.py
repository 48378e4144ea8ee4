"""Reading raw delimited tables, cleaned tables and query results."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.functions.text import blank_to_null, tokens_to_null
from grantmill.operators.columns import missing_columns
from grantmill.operators.integrity import surrogate_id
from grantmill.sources.splits import split_records

log = logging.getLogger(__name__)

CORRUPT = "_corrupt_record"


def _csv_reader(spark: SparkSession, sep: str, multi_line: bool):
    # Part files must repeat one header; enforceSchema=False makes Spark check that.
    return (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
    )


def select_available(df: DataFrame, want: Sequence[str], source: str = "table") -> DataFrame:
    """The wanted columns that exist; an error when none does."""
    missing = missing_columns(df, want)
    if len(missing) == len(want):
        raise ValueError(f"none of the columns {list(want)} exist in {source}; it has {df.columns}")
    if missing:
        log.info("%s has no columns %s", source, missing)
    return df.select(*[f"`{c}`" for c in want if c not in missing])


def nullify_tokens(df: DataFrame, tokens: Iterable[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Turn blank text, and any given token, into null in every column but those to keep."""
    tokens = tuple(tokens)

    def clean(name: str):
        c = blank_to_null(F.col(f"`{name}`")) if not tokens else tokens_to_null(F.col(f"`{name}`"), tokens)
        return c.alias(name)

    return df.select(*[F.col(f"`{name}`") if name in keep else clean(name) for name in df.columns])


def _records(spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str, ordinal: str | None, read) -> DataFrame:
    """All records with the given columns, and their place in the files as a struct column if one is asked for."""
    header = [name for name in schema.names if name != CORRUPT]
    found = split_records(spark, path, header, sep)
    if found is None:
        log.info("%s has very long records; each file is read by one task", path)
        rows = read.option("multiLine", True).schema(schema).csv(path)
        if ordinal is None:
            return rows
        place = [F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("row")]
        return rows.select("*", F.struct(*place).alias(ordinal))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{name.replace('`', '``')}` string" for name in schema.names)
    parsed = found.where(F.length("record") > 0).select(F.from_csv("record", ddl, options).alias("_row"), F.struct("file", "block", "row").alias("_place"))
    # Fields by position: names may hold any character.
    columns = [F.col("_row").getField(name).alias(name) for name in schema.names]
    return parsed.select(*columns, *([F.col("_place").alias(ordinal)] if ordinal else []))


def scan_raw_table(
    spark: SparkSession,
    path: str | list[str],
    want: Sequence[str],
    *,
    sep: str = "\t",
    multi_line: bool = True,
    null_tokens: Iterable[str] = (),
    ordinal: str | None = None,
) -> DataFrame:
    """A delimited table with a header row, all text, narrowed to the wanted columns.

    With ``multi_line``, fields may hold quoted line breaks; files are still read by many
    tasks each. ``ordinal`` names a column to add that orders the rows as they stand in the
    files: file, range of the file, and record of the range.
    """
    header = _csv_reader(spark, sep, multi_line).csv(path)
    wanted = select_available(header, want, str(path)).columns
    if multi_line or ordinal:
        rows = _records(spark, path, header.schema, sep, ordinal, _csv_reader(spark, sep, True))
    else:
        rows = header
    df = rows.select(*[f"`{c}`" for c in wanted], *([ordinal] if ordinal else []))
    tokens = tuple(null_tokens)
    if not tokens:
        return df
    return nullify_tokens(df, tokens, keep=(ordinal,) if ordinal else ())


def tolerant_parse(spark: SparkSession, path: str | list[str], *, sep: str = "\t", multi_line: bool = True) -> DataFrame:
    """Every line kept: short ones padded, long ones cut, both with their text in ``_corrupt_record``."""
    header = _csv_reader(spark, sep, multi_line).csv(path).columns
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*header, CORRUPT]])
    reader = _csv_reader(spark, sep, multi_line).option("enforceSchema", True).option("columnNameOfCorruptRecord", CORRUPT)
    if multi_line:
        return _records(spark, path, schema, sep, None, reader)
    return reader.schema(schema).csv(path)


def land_raw_table(spark: SparkSession, path: str | list[str], want: Sequence[str], out: str, **options) -> DataFrame:
    """Copy a raw table to Parquet once, so that later scans split and prune columns."""
    scan_raw_table(spark, path, want, **options).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The table, or ``None`` where its file is missing."""
    try:
        return read()
    except AnalysisException as error:
        if not _is_missing(error):
            raise
        return None


def resolve_source(spark: SparkSession, preferred: str, fallback: str, want: Sequence[str], **options) -> DataFrame:
    """The dedicated table where it exists, else the one that holds the same columns."""
    found = if_present(lambda: scan_raw_table(spark, preferred, want, **options))
    return scan_raw_table(spark, fallback, want, **options) if found is None else found


def optional_source(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """The table, or an empty one of the same columns where the file is missing."""
    found = if_present(lambda: scan_raw_table(spark, path, schema.names, **options))
    if found is not None:
        return found
    log.info("%s not found", path)
    return spark.createDataFrame([], schema)


def source_status(spark: SparkSession, paths: Mapping[str, str], want: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows per raw table, and the error condition of each that cannot be read."""
    found = []
    for name, path in paths.items():
        try:
            rows = scan_raw_table(spark, path, want[name]).agg(F.count("*").alias("row_count"))
            condition = F.lit("OK")
        except AnalysisException as error:
            rows = spark.range(1).select(F.lit(None).cast("bigint").alias("row_count"))
            condition = F.lit(error.getCondition())
        found.append(rows.select(F.lit(name).alias("source"), condition.alias("condition"), "row_count"))
    status = found[0]
    for part in found[1:]:
        status = status.unionByName(part)
    return status


def sample_rows(df: DataFrame, rows: int | None = None, order: str = "patent_id") -> DataFrame:
    """The first rows by key, rows without a key left out; ``None`` keeps all.

    A sort with so large a limit would send that many rows of every task to one task. So
    the key at the limit is found first, from the numbered key column. Rows below it are
    all taken as they come; only of the rows with that key some are left out.
    """
    if rows is None:
        return df
    keyed = df.where(F.col(order).isNotNull())
    places = surrogate_id(keyed.select(order), order)
    last = places.where(F.col("id") == rows).select(order).first()
    if last is None:
        return keyed
    before = places.where(F.col(order) < F.lit(last[0])).count()
    return keyed.where(F.col(order) < F.lit(last[0])).unionByName(keyed.where(F.col(order) == F.lit(last[0])).limit(rows - before))


def read_clean(spark: SparkSession, path: str) -> DataFrame | None:
    """A cleaned table, or ``None`` with a warning where it was never written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if not _is_missing(error):
            raise
        log.warning("%s not found", path)
        return None


def read_table_query(
    spark: SparkSession, text: str, tables: Mapping[str, DataFrame], args: Mapping[str, object] | list | None = None
) -> DataFrame:
    """Run SQL text in which ``{name}`` stands for a table and ``:name`` or ``?`` for a value."""
    return spark.sql(text, args=args, **tables)


def read_key_column(df: DataFrame, key: str) -> DataFrame:
    """The distinct non-null values of one key column."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()
