"""Cleaning, integrity and ranking rules on literal rows."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from grantmill import schemas
from grantmill.operators import columns, counting, dedupe, integrity, joins, ranking
from grantmill.plans import clean, datasets
from grantmill.plans.star import RawStar, RawTables, load_patents, load_relationships
from grantmill.sources import readers
from tests.conftest import rows


def table(spark, schema: str, *values):
    return spark.createDataFrame(list(values), schema)


def test_clean_patents(spark):
    raw = table(
        spark,
        "patent_id string, patent_title string, patent_date string, patent_type string",
        ("1", " T ", "2020-01-05", "Utility "),
        ("2", None, "2020-1-5", None),
        ("3", "t", "x", "utility"),
        ("4", "t", "2020-01-05", "design"),
        (None, "t", "2020-01-05", "utility"),
    )
    day = datetime.date(2020, 1, 5)
    cleaned = clean.clean_patents(raw)
    assert cleaned.columns == schemas.PATENTS.names
    assert rows(cleaned) == [("1", "T", "", day, 2020, "utility", ""), ("2", None, "", day, 2020, "", "")]
    assert rows(integrity.check_not_null(cleaned, "patent_id", "title")) == [("2",)]
    assert [r.patent_id for r in load_patents(cleaned).collect()] == ["1"]


def test_patent_cap_is_by_id(spark):
    raw = table(
        spark, "patent_id string, patent_title string, patent_date string", *[(str(i), "t", "2020-01-01") for i in range(9)]
    )
    assert [r.patent_id for r in clean.clean_patents(raw, 3).orderBy("patent_id").collect()] == ["0", "1", "2"]


def test_sample_of_a_table_with_repeated_keys(spark):
    df = spark.range(0, 900, 1, 5).select((F.col("id") % 300).cast("string").alias("k"), "id")
    ordered = sorted(str(i % 300) for i in range(900))
    for n in (1, 2, 100, 899, 900, 5000):
        assert sorted(r.k for r in readers.sample_rows(df, n, "k").collect()) == ordered[:n]
    assert readers.sample_rows(df, None, "k").count() == 900


def test_loaded_patents_keep_the_first_row_of_an_id(spark):
    cleaned = table(
        spark,
        "patent_id string, title string, abstract string, filing_date date, year int, patent_type string, wipo_kind string",
        ("1", "b", "z", datetime.date(2001, 1, 1), 2001, "utility", None),
        ("1", "a", "y", datetime.date(2001, 1, 1), 2001, "utility", "B"),
        ("1", "c", "x", datetime.date(2001, 1, 1), 2001, "utility", None),
        ("1", "0", "0", datetime.date(2002, 1, 1), 2002, "reissue", "A"),
    )
    assert rows(integrity.check_unique_key(cleaned, "patent_id")) == [("1", 4)]
    # A missing kind comes after a given one.
    assert rows(load_patents(cleaned)) == [
        ("1", "a", "y", datetime.date(2001, 1, 1), 2001, "utility", "B"),
    ]


INVENTORS = (
    "n int, inventor_id string, disambig_inventor_name_first string, disambig_inventor_name_last string, "
    "inventor_country string, location_id string"
)


def test_inventors_are_filtered_before_the_first_row_is_kept(spark):
    raw = table(spark, INVENTORS, (1, "i", "X", None, "us", None), (2, "i", "Xavier", None, "se", None))
    assert rows(clean.clean_inventors(raw, None, order=["n"])) == [("i", "Xavier", "Sweden")]


def test_companies_are_filtered_after_the_first_row_is_kept(spark):
    schema = "n int, assignee_id string, disambig_assignee_organization string"
    raw = table(spark, schema, (1, "c", "X"), (2, "c", "Xavier"), (3, "d", " D Ltd "), (4, "e", None))
    assert rows(clean.clean_companies(raw, None, order=["n"])) == [("d", "D Ltd", "Unknown")]


def test_country_comes_from_the_entity_then_from_its_location(spark):
    raw = table(
        spark,
        INVENTORS,
        (1, "a", "Ann", None, "se", "l1"),
        (2, "b", "Bob", None, "  ", "l1"),
        (3, "c", "Cyd", None, None, "l9"),
        (4, "d", "Dee", None, None, None),
    )
    locations = clean.clean_locations(
        table(spark, "location_id string, disambig_country string", ("l1", " us "), (None, "us"))
    )
    assert rows(clean.clean_inventors(raw, locations)) == [
        ("a", "Ann", "Sweden"),
        ("b", "Bob", "United States"),
        ("c", "Cyd", "Unknown"),
        ("d", "Dee", "Unknown"),
    ]


def test_disambiguated_id_is_preferred_everywhere(spark):
    raw = table(
        spark,
        "patent_id string, disambig_inventor_id string, inventor_id string, disambig_inventor_name_first string, "
        "disambig_inventor_name_last string",
        ("p", "d", "i", "Ann", "B"),
    )
    patents = table(spark, "patent_id string", ("p",))
    assert rows(clean.clean_inventors(raw, None)) == [("d", "Ann B", "Unknown")]
    assert rows(clean.clean_patent_inventor(raw, patents)) == [("p", "d")]
    with pytest.raises(ValueError, match="none of"):
        clean.clean_patent_company(raw, patents)


def test_relationships_pair_both_sides(spark):
    pi = table(spark, "patent_id string, inventor_id string", ("p", "a"), ("p", "b"), ("q", "a"))
    pc = table(spark, "patent_id string, company_id string", ("p", "x"), ("p", "y"), ("r", "x"))
    assert rows(joins.pair_per_patent(pi, pc)) == [
        ("p", "a", "x"),
        ("p", "a", "y"),
        ("p", "b", "x"),
        ("p", "b", "y"),
        ("q", "a", None),
        ("r", None, "x"),
    ]


def test_foreign_keys_are_repaired(spark):
    pairs = table(
        spark,
        "patent_id string, inventor_id string, company_id string",
        ("p1", "i1", "c9"),
        ("p9", "i1", "c1"),
        ("p1", None, "c1"),
    )
    patents = table(spark, "patent_id string", ("p1",))
    inventors = table(spark, "inventor_id string", ("i1",))
    companies = table(spark, "company_id string", ("c1",))
    repaired = integrity.repair_foreign_keys(pairs, patents, inventors, companies)
    assert rows(repaired) == [("p1", "i1", None), ("p1", None, "c1")]
    dimensions = {"patent_id": patents, "inventor_id": inventors, "company_id": companies}
    assert rows(integrity.check_foreign_keys(pairs, dimensions)) == [("company_id", "c9", 1), ("patent_id", "p9", 1)]
    assert rows(integrity.check_foreign_keys(repaired, dimensions)) == []


def test_repair_before_or_after_pairing_gives_the_same_rows(spark):
    pi = table(spark, "patent_id string, inventor_id string", ("p", "a"), ("p", "o1"), ("p", "o2"), ("q", "o1"))
    pc = table(spark, "patent_id string, company_id string", ("p", "x"), ("p", "o"), ("s", "x"))
    patents = table(spark, "patent_id string", ("p",), ("q",))
    inventors, companies = table(spark, "inventor_id string", ("a",)), table(spark, "company_id string", ("x",))
    before = load_relationships(pi, pc, inventors, companies, patents, with_id=False)
    after = integrity.repair_foreign_keys(joins.pair_per_patent(pi, pc), patents, inventors, companies)
    assert rows(before) == rows(after)
    assert rows(before).count(("p", None, "x")) == 2


def test_surrogate_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5000).cast("string").alias("k"))
    numbered = integrity.surrogate_id(df, "k").orderBy("id").collect()
    assert [r.id for r in numbered] == list(range(1, 5001))
    assert [r.k for r in numbered] == sorted(r.k for r in numbered)
    assert sorted(r.id for r in integrity.surrogate_id(df).collect()) == list(range(1, 5001))


def test_keep_first_orders_nulls_last_in_both_forms(spark):
    df = table(spark, "k string, a int, b string", ("x", 1, None), ("x", 1, "a"), ("x", 2, ""), ("y", None, "b"), ("y", 0, "a"))
    expected = [("x", 1, "a"), ("y", 0, "a")]
    assert rows(dedupe.keep_first(df, "k")) == expected
    assert rows(dedupe.keep_first(df, "k", by_column=True)) == expected
    assert rows(dedupe.keep_first(df, "k", ["b"], where=F.col("a") > 0)) == [("x", 2, "")]


def test_ranks(spark):
    counts = table(spark, "k string, n bigint", ("a", 9), ("b", 7), ("c", 7), ("d", 3))
    assert rows(ranking.rank_by_counts(counts, "n").select("k", "rank", "dense_rank")) == [
        ("a", 1, 1),
        ("b", 2, 2),
        ("c", 2, 2),
        ("d", 4, 3),
    ]
    top = ranking.with_ranks_of_top(ranking.top_k(counts, 3, "n", "k"), "n")
    assert rows(top.select("k", "rank", "dense_rank")) == [("a", 1, 1), ("b", 2, 2), ("c", 2, 2)]


def test_row_limits_are_checked():
    assert ranking.checked_size(15, 5, 50) == 15
    for wrong in (4, 51):
        with pytest.raises(ValueError, match="outside"):
            ranking.checked_size(wrong, 5, 50)
    with pytest.raises(TypeError):
        ranking.checked_size("15; DROP TABLE patents")


def test_recent_years_keeps_eleven(spark):
    trend = spark.range(2000, 2022).select(F.col("id").cast("int").alias("year"))
    assert [r.year for r in datasets.recent_years(trend).orderBy("year").collect()] == list(range(2011, 2022))


def test_names_with_a_dot_are_kept(spark):
    df = table(spark, "`address` string, `address.city` string, `address.1` string, `a.b` int, `a.b.2` int", ("x", "y", "z", 1, 2))
    assert columns.drop_artifact_columns(df).columns == ["address", "address.city", "a.b"]


def test_artifact_columns_are_dropped(spark):
    df = table(spark, "`a` int, `a.1` int, `b.1` int, c3 int, c4 int", (1, 2, 3, 4, 5))
    assert columns.drop_artifact_columns(df).columns == ["a", "b.1", "c3", "c4"]
    kept = columns.drop_artifact_columns(df, ["c"])
    assert kept.columns == ["a", "b.1", "c"] and rows(kept) == [(1, 3, 4)]


def test_rows_dropped(spark):
    df = table(spark, "a string, b string", ("1", "1"), (None, "1"), ("1", None))
    assert rows(counting.rows_dropped(df, "a", "b")) == [(3, 1, 2)]


def test_select_available(spark):
    df = table(spark, "a string, `b.c` string", ("1", "2"))
    assert readers.select_available(df, ["b.c", "z", "a"]).columns == ["b.c", "a"]
    with pytest.raises(ValueError, match="none of the columns"):
        readers.select_available(df, ["z"])


def test_star_without_locations_uses_dedicated_pairs(spark):
    raw = RawTables(
        raw_patent=table(
            spark, "patent_id string, patent_title string, patent_date string", ("p", "t", "2020-01-01")
        ),
        raw_inventor=table(spark, INVENTORS, (1, "i", "Ann", "B", None, "l")),
        raw_assignee=table(spark, "assignee_id string, disambig_assignee_organization string", ("c", "Co")),
        raw_patent_inventor=table(spark, "patent_id string, inventor_id string", ("p", "i"), ("p", "i"), ("q", "i")),
        raw_patent_assignee=table(spark, "patent_id string, assignee_id string", ("p", "zz"), ("p", None)),
    )
    star = RawStar(raw)
    assert rows(star.inventors) == [("i", "Ann B", "Unknown")]
    assert rows(star.relationships()) == [("p", "i", None)]
