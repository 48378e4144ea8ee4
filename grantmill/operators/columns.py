"""Choosing, adding, renaming and ordering columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_columns(df: DataFrame, want: Iterable[str]) -> list[str]:
    return [c for c in want if c not in df.columns]


def extra_columns(df: DataFrame, want: Iterable[str]) -> list[str]:
    want = set(want)
    return [c for c in df.columns if c not in want]


def schema_difference(df: DataFrame, want: Sequence[str]) -> tuple[list[str], list[str]]:
    """Wanted columns the table lacks, and columns nobody wants."""
    return missing_columns(df, want), extra_columns(df, want)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def _add_missing(df: DataFrame, names: Sequence[str], value: Column) -> DataFrame:
    return df.withColumns({name: value for name in missing_columns(df, names)})


def add_missing_default(df: DataFrame, names: Sequence[str], default: str = "") -> DataFrame:
    return _add_missing(df, names, F.lit(default))


def add_missing_null(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return _add_missing(df, names, F.lit(None).cast("string"))


def pick_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate that exists."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(candidates)} found in {df.columns}")


def drop_artifact_columns(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Drop the copies a reader made of repeated header names.

    ``x.1`` goes where ``x`` exists; other names with a dot are names of their own. Spark itself reads a repeated ``x`` as ``x``
    plus the column position, which could also be a real name, so that form is
    only undone for the given ``names``: the first copy becomes ``x``.
    """
    present = set(df.columns)
    dropped = {c for c in df.columns if (copy := re.fullmatch(r"(.+)\.\d+", c)) and copy[1] in present}
    renamed = {}
    for name in names:
        copies = [c for i, c in enumerate(df.columns) if c == f"{name}{i}"]
        if name not in present and len(copies) > 1:
            renamed[copies[0]] = name
            dropped.update(copies[1:])
    return df.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in df.columns if c not in dropped])


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the target columns: missing ones null, extra ones dropped, all cast and in order."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(field.name) if field.name in present else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in schema.fields
        ]
    )
