"""Exact copies: sorted runs of digests, merged along a tree.

Every partition of the input is a run of digests. In each round runs that differ in one
digit of their number exchange rows: a row moves to the run that has the digest's own
digit there, and the runs that meet are merged, which keeps one row per digest with the
smallest identifier and the number of rows behind it. With runs numbered by m digits of
base b, m rounds of b-way merging leave every digest in one run, and no run ever holds
more than its share of the digests, whatever one digest's number of copies.

Equal digests are verified at each level: rows merge if the whole SHA-256 and the length of
the text agree. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantmill.llm.common import free_name
from grantmill.session import materialize

ROWS_OF_A_RUN = 1 << 20
MOST_WAYS = 16
# Digests with a share of all rows of at least one in so many are looked up by broadcast:
# there are at most so many of them.
HOT_SHARE = 1024


def normal_text(text: Column) -> Column:
    """White space runs as one space each; null as an empty text. Single spaces are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digests(df: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """Rows (id, sha, bytes, row, part), one for each row."""
    normal = df.select(F.col(id_col).alias("id"), normal_text(F.col(text_col)).alias("normal"), row.alias("row"))
    return normal.select(
        "id",
        F.unhex(F.sha2("normal", 256)).alias("sha"),
        F.octet_length("normal").alias("bytes"),
        "row",
        F.spark_partition_id().alias("part"),
    )


def shape(rows: int, least_runs: int) -> tuple[int, int]:
    """Ways of each merge and rounds: two rounds at least, and as few as MOST_WAYS allows."""
    runs = max(2, least_runs, math.ceil(rows / ROWS_OF_A_RUN))
    rounds = 2
    while MOST_WAYS**rounds < runs:
        rounds += 1
    ways = 2
    while ways**rounds < runs:
        ways += 1
    return ways, rounds


def merge_runs(own: DataFrame, ways: int, rounds: int) -> DataFrame:
    """Rows (sha, bytes, first, n): each digest once, with the first of its rows and their number.

    `first` orders by identifier, nulls last, then by row.
    """
    runs = ways**rounds
    first = F.struct(F.col("id").isNull().alias("missing"), "id", "row")
    level = own.select(
        F.pmod("part", F.lit(runs)).alias("run"), "sha", "bytes", first.alias("first"), F.lit(1).cast("long").alias("n")
    )
    home = F.pmod(F.xxhash64("sha"), F.lit(runs)).cast("int")
    for digit in range(rounds):
        step = ways**digit

        def at(number: Column, step: int = step) -> Column:
            return F.floor(number / F.lit(step)).cast("int") % F.lit(ways)

        moved = level.withColumn("run", (F.col("run") + (at(home) - at(F.col("run"))) * step).cast("int"))
        if digit:
            moved = moved.repartitionById(runs, "run")
        # The first round merges each run by itself before its rows move.
        level = moved.groupBy("run", "sha", "bytes").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    return level.drop("run")


def group_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """Rows (id_col, keep_id, group_size, kept, text_sha256) and row_col if given, one for each row.

    Texts are equal if they are identical once each run of ASCII white space is a single
    space; null is an empty text. `keep_id` is the smallest identifier of the equal texts
    (null if none has one), and `kept` marks one row of them: the first with that
    identifier, by row_col or else by place in the input. Repeated rows are rows of their
    group, an empty table gives no rows, other columns are not read.
    """
    spark = df.sparkSession
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    own = materialize(digests(df, id_col, text_col, row), "digests")
    rows = own.count()
    ways, rounds = shape(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = materialize(merge_runs(own, ways, rounds), "merged")

    share = F.col("n") * HOT_SHARE >= rows
    told = ["sha", "bytes", F.col("first.id").alias("keep_id"), F.col("first.row").alias("first_row"), "n"]
    hot = F.broadcast(merged.where(share).select(*told))
    copied = merged.where(~share & (F.col("n") > 1)).select(*told)
    found = own.join(hot, ["sha", "bytes"]).unionByName(
        own.join(hot, ["sha", "bytes"], "left_anti").join(copied, ["sha", "bytes"], "left"), allowMissingColumns=True
    )
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that `group_copies` marks as kept."""
    row = free_name("row_number", df)
    numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = group_copies(numbered, id_col, text_col, row).where("kept").select(row)
    return numbered.join(kept, row, "left_semi").select(*df.columns)
