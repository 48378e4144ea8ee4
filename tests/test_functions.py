"""Expressions on literal rows."""

from __future__ import annotations

import datetime

import pytest
from hypothesis import HealthCheck, given, settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grantmill.functions import country, text
from tests.conftest import rows


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", expression(F.col("v"))).collect())]


COUNTRIES = {
    None: "Unknown",
    "": "Unknown",
    "  ": "Unknown",
    "unknown": "Unknown",
    "us": "United States",
    " us ": "United States",
    "se": "Sweden",
    "KR": "South Korea",
    "XX": "XX",
    "Brazil": "Brazil",
    "NEW ZEALAND": "New Zealand",
    "côte d'ivoire": "Côte D'Ivoire",
    "U": "U",
    "1A": "1A",
    "USA": "Usa",
}


def test_normalize_country(spark):
    assert apply(spark, list(COUNTRIES), country.normalize_country) == list(COUNTRIES.values())


def test_country_lookup_uses_a_table_of_names(spark):
    names = spark.createDataFrame(
        [*country.COUNTRY_NAMES.items(), ("NZ", "New Zealand"), ("NZ", "Zealand"), ("USA", "no"), ("é1", "no")],
        "code string, name string",
    )
    df = spark.createDataFrame([(c,) for c in [*COUNTRIES, "nz"]], "v string")
    found = {r.v: r.country for r in country.country_lookup(df, "v", names).collect()}
    assert found == {**COUNTRIES, "nz": "New Zealand"}


def test_country_lookup_keeps_every_code(spark):
    names = spark.createDataFrame([(" us", "United States"), ("1A", "Special"), (None, "no")], "code string, name string")
    df = spark.createDataFrame([("US",), ("1a ",), (None,)], "v string")
    found = {r.v: r.country for r in country.country_lookup(df, "v", names).collect()}
    assert found == {"US": "United States", "1a ": "Special", None: "Unknown"}


@pytest.mark.parametrize("value", ["2020-01-05", "2020-1-5", " 2020-01-05\t"])
def test_parse_date(spark, value):
    assert apply(spark, [value], text.parse_date) == [datetime.date(2020, 1, 5)]


def test_parse_date_gives_null(spark):
    assert apply(spark, ["x", "2020-02-30", "", None], text.parse_date) == [None] * 4


def test_strip_agrees_with_python(spark):
    values = ["a", " a ", "\ta b\n", "　a ", "\x1ca\x85", " \t ", "", "​a", "  x  "]
    assert apply(spark, values, text.strip) == [v.strip() for v in values]


@hypothesis_settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet=" \t\n\x85\xa0 abcÉß1'-", max_size=12), min_size=20, max_size=60))
def test_strip_and_title_case_of_any_text(spark, values):
    assert apply(spark, values, text.strip) == [v.strip() for v in values]
    upper = [v.upper() for v in values]
    assert apply(spark, upper, text.title_case) == [v.title() for v in upper]


def test_full_name(spark):
    df = spark.createDataFrame(
        [(None, " b "), ("A", None), (" Ada ", " Lovelace"), (None, None), ("", " ")], "first string, last string"
    )
    names = {r[0] for r in df.select(text.full_name(F.col("first"), F.col("last"))).collect()}
    assert names == {"b", "A", "Ada Lovelace", ""}


def test_label_is_null_without_country(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "n string, c string")
    assert rows(df.select(text.label(F.col("n"), F.col("c")))) == [("a  [b]",), (None,)]


@pytest.mark.parametrize(
    ("keyword", "matches"),
    [
        ("tion", ["NATION", "motion", "Tion"]),
        ("A_B", ["axb", "zA bz"]),
        ("a\\b", ["a\\b"]),
        ("a~^!|b", ["xA~^!|b"]),
        ("50%", ["costs 50 cents", "50"]),
        ("é", ["café"]),
    ],
)
def test_keyword_match(spark, keyword, matches):
    others = ["nothing", "ab", "CAFÉ", "a\nb?"]
    if keyword == "A_B":
        matches, others = [*matches, "a\nb?"], others[:-1]
    found = spark.createDataFrame([(v,) for v in [*matches, *others]], "v string")
    found = found.where(text.matches_keyword(F.col("v"), keyword))
    assert {r.v for r in found.collect()} == set(matches)


def test_null_tokens(spark):
    values = ["NA", "null", "None", "", "x", "nan", None]
    assert apply(spark, values, text.tokens_to_null) == [None, None, None, None, "x", None, None]
    assert apply(spark, values, text.blank_to_null) == ["NA", "null", "None", None, "x", "nan", None]


def test_share_of_nothing_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 3)], "part int, total int")
    assert rows(df.select(text.share(F.col("part"), F.col("total"), 2))) == [(33.33,), (None,)]


def test_report_formats(spark):
    df = spark.range(1).select(
        text.thousands(F.lit(1234567)), text.percent(F.lit(12.345), 1), text.pad_right(F.lit("longer"), 3),
        text.pad_left(F.lit("a"), 3), text.bar(text.scaled_bar_length(F.lit(5), F.lit(30.0), 30)),
    )
    assert rows(df) == [("1,234,567", "12.3%", "longer", "  a", "█████")]
