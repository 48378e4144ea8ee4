"""Country codes and names in one spelling."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantmill.functions.text import strip, title_case
from grantmill.operators.joins import lookup_left

UNKNOWN = "Unknown"

# Names of the most frequent codes.
COUNTRY_NAMES = {
    "US": "United States",
    "JP": "Japan",
    "DE": "Germany",
    "CN": "China",
    "KR": "South Korea",
    "FR": "France",
    "CA": "Canada",
    "GB": "United Kingdom",
    "TW": "Taiwan",
    "IN": "India",
    "IT": "Italy",
    "NL": "Netherlands",
    "SE": "Sweden",
    "CH": "Switzerland",
    "AU": "Australia",
}


_iso_names: dict[str, str] = {}


def iso_country_names(spark: SparkSession) -> dict[str, str]:
    """English names of all two-letter codes of ISO 3166, as the Java platform has them."""
    if not _iso_names:
        locale = spark._jvm.java.util.Locale
        _iso_names.update({code: locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()})
        _iso_names.update(COUNTRY_NAMES)
    return _iso_names


def _code(c: Column) -> Column:
    return F.upper(strip(c))


def _spell(code: Column, name: Column) -> Column:
    return (
        F.when(code.isNull() | code.isin("", "UNKNOWN"), F.lit(UNKNOWN))
        .when(F.length(code) > 2, title_case(code))
        .otherwise(F.coalesce(name, code))
    )


def normalize_country(c: Column, names: Mapping[str, str] = COUNTRY_NAMES) -> Column:
    """One spelling per country: unknown, title-cased name, looked-up name, or the code."""
    lookup = F.create_map(*(F.lit(x) for x in chain.from_iterable(names.items())))
    return _spell(_code(c), F.try_element_at(lookup, _code(c)))


def country_lookup(df: DataFrame, column: str, dimension: DataFrame, out: str = "country") -> DataFrame:
    """The same rule with the names taken from a ``(code, name)`` table.

    Its codes are trimmed and upper-cased like the values, and all of them are kept;
    Spark decides by its size whether the table is broadcast.
    """
    names = dimension.groupBy(_code(F.col("code")).alias("_code")).agg(F.min("name").alias("_name"))
    coded = df.withColumn("_code", _code(F.col(column)))
    found = lookup_left(coded, names.where(F.col("_code").isNotNull()), "_code", spread_by=df.columns[0])
    return found.withColumn(out, _spell(F.col("_code"), F.col("_name"))).drop("_code", "_name")
