"""Raw files, landed tables, sinks and the stored star."""

from __future__ import annotations

import json
import logging
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks.fixtures import Fixtures
from grantmill import schemas
from grantmill.functions.text import CSV_NULL_TOKENS
from grantmill.operators import integrity
from grantmill.plans import datasets, reports
from grantmill.plans.star import RawStar, StoredStar
from grantmill.sources import readers, writers
from tests.conftest import rows

LINES = 'a\tb\tc\n1\tx\ty\n2\tx\n3\tx\ty\tz\n4\t"q\tq"\tNA\n5\t"m\nn"\tnull\n6\t\tNone\n7\t"say ""so"""\tz\n'


@pytest.fixture
def raw_file(tmp_path):
    path = tmp_path / "raw.tsv"
    path.write_text(LINES, encoding="utf-8")
    return str(path)


def test_lines_of_any_length_are_kept(spark, raw_file):
    assert rows(readers.scan_raw_table(spark, raw_file, ["a", "b", "c"])) == [
        ("1", "x", "y"),
        ("2", "x", None),
        ("3", "x", "y"),
        ("4", "q\tq", "NA"),
        ("5", "m\nn", "null"),
        ("6", None, "None"),
        ("7", 'say "so"', "z"),
    ]


def test_null_tokens_are_optional(spark, raw_file):
    df = readers.scan_raw_table(spark, raw_file, ["c"], null_tokens=CSV_NULL_TOKENS)
    assert sorted(str(r.c) for r in df.collect()) == ["None", "None", "None", "None", "y", "y", "z"]


def test_columns_are_found_by_name(spark, raw_file):
    df = readers.scan_raw_table(spark, raw_file, ["c", "missing", "a"])
    assert df.columns == ["c", "a"]
    assert ("y", "1") in rows(df)


def test_uneven_lines_are_marked(spark, raw_file):
    df = readers.tolerant_parse(spark, raw_file)
    marked = df.where(F.col(readers.CORRUPT).isNotNull()).select("a")
    assert df.count() == 7
    assert rows(marked) == [("2",), ("3",)]


def test_part_files_must_share_one_header(spark, tmp_path):
    (tmp_path / "1.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "2.tsv").write_text("b\ta\n1\t2\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        readers.scan_raw_table(spark, str(tmp_path), ["a"]).collect()


def test_missing_sources(spark, raw_file, tmp_path):
    absent = str(tmp_path / "absent.tsv")
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.scan_raw_table(spark, absent, ["a"])
    assert readers.resolve_source(spark, absent, raw_file, ["a"]).count() == 7
    assert readers.resolve_source(spark, raw_file, absent, ["a"]).count() == 7
    with pytest.raises(ValueError, match="none of the columns"):
        readers.resolve_source(spark, raw_file, absent, ["z"])
    empty = readers.optional_source(spark, absent, schemas.RAW_LOCATION)
    assert empty.columns == schemas.LOCATION_COLUMNS and empty.count() == 0
    status = readers.source_status(spark, {"x": raw_file, "y": absent}, {"x": ["a"], "y": ["a"]})
    assert rows(status) == [("x", "OK", 7), ("y", "PATH_NOT_FOUND", None)]


def test_absent_clean_table_is_skipped(spark, tmp_path, caplog):
    with caplog.at_level(logging.WARNING):
        assert readers.read_clean(spark, str(tmp_path / "none")) is None
    assert "not found" in caplog.text


def test_raw_text_survives_a_round_trip(spark, fx, tmp_path):
    path = writers.write_raw(fx.raw_patent, str(tmp_path / "patents"))
    back = readers.scan_raw_table(spark, path, schemas.PATENT_COLUMNS)
    expected = fx.raw_patent.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in schemas.PATENT_COLUMNS])
    assert rows(back) == rows(expected)


def test_write_clean_counts_rows(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit(' "a"\n').alias("t"))
    assert writers.write_clean(df, str(tmp_path / "p")) == 100
    assert writers.write_clean(df, str(tmp_path / "c"), fmt="csv") == 100
    options = {"header": True, "multiLine": True, "escape": '"'}
    assert rows(spark.read.options(**options).csv(str(tmp_path / "c"))) == rows(df)


def test_report_files(spark, stored, tmp_path):
    paths = writers.export_reports_csv(reports.csv_reports(stored), str(tmp_path))
    assert list(paths) == list(writers.REPORT_FILES)
    assert len([f for f in os.listdir(paths["top_inventors"]) if f.endswith(".csv")]) == 1
    path = writers.export_report_json(reports.report_json(stored), str(tmp_path / "report"))
    (part,) = [f for f in os.listdir(path) if f.endswith(".json")]
    report = json.loads(open(f"{path}/{part}", encoding="utf-8").read())
    assert list(report) == ["total_patents", "top_inventors", "top_companies", "top_countries", "yearly_trend"]
    assert [e["rank"] for e in report["top_inventors"]] == list(range(1, 11))
    assert list(report["top_countries"][0]) == ["country", "patents", "share"]
    years = [e["year"] for e in report["yearly_trend"]]
    assert years == sorted(years)


def test_stored_star_keeps_its_rules(spark, stored):
    for name, key in schemas.PRIMARY_KEYS.items():
        table = getattr(stored, name)
        assert integrity.check_unique_key(table, key).isEmpty()
        assert integrity.check_not_null(table, key, schemas.NOT_NULL[name]).isEmpty()
    dimensions = {"patent_id": stored.patents, "inventor_id": stored.inventors, "company_id": stored.companies}
    assert integrity.check_foreign_keys(stored.relationships(), dimensions).isEmpty()
    assert stored.patents.schema == schemas.PATENTS
    ids = stored.numbered_relationships.agg(F.min("id"), F.max("id"), F.countDistinct("id"), F.count("*")).first()
    assert ids[0] == 1 and ids[1] == ids[2] == ids[3]


def test_stored_and_lazy_star_give_the_same_reports(spark, fx, stored):
    lazy = reports.all_reports(fx.star)
    for name, result in reports.all_reports(stored).items():
        assert result.collect() == lazy[name].collect(), name
    assert rows(stored.relationships()) == rows(fx.star.relationships())
    assert rows(reports.patents_full_detail(stored)) == rows(reports.patents_full_detail(fx.star))
    assert reports.report_json(stored).collect() == reports.report_json(fx.star).collect()


def test_counts_from_pairs_equal_counts_from_relationships(stored):
    found = stored.relationships().where("inventor_id IS NOT NULL").groupBy("inventor_id")
    assert rows(found.agg(F.countDistinct("patent_id"))) == rows(reports.inventor_counts(stored))


def test_detail_limit_equals_the_limit_of_the_whole_join(stored):
    p, r = stored.patents, stored.relationships()
    inventors = stored.inventors.select("inventor_id", F.col("name").alias("i"), F.col("country").alias("ic"))
    companies = stored.companies.select("company_id", F.col("name").alias("c"))
    whole = p.where("year >= 2000").join(r, "patent_id", "left")
    whole = whole.join(inventors, "inventor_id", "left").join(companies, "company_id", "left")
    for k in (1, 7, 500):
        expected = whole.orderBy("patent_id", "inventor_id", "company_id").limit(k)
        expected = expected.select("patent_id", "title", "year", "i", "ic", "c")
        assert [tuple(r) for r in reports.patent_detail(stored, k=k).collect()] == [tuple(r) for r in expected.collect()]


def test_search(stored):
    assert datasets.search_patents(stored, "").count() == 0
    hits = datasets.search_patents(stored, "THE", 1990, 2024, limit=40).collect()
    assert all("the" in r.title.lower() for r in hits)
    assert [(-r.year, r.patent_id) for r in hits] == sorted((-r.year, r.patent_id) for r in hits)


def test_reading_back_a_stored_star(spark, stored):
    again = StoredStar(spark, stored._root)
    assert again.patents.count() == stored.patents.count()


def test_repeated_patent_ids_are_loaded_once(spark, fx, tmp_path):
    from grantmill.plans.star import RawTables, build_star

    again = fx.raw_patent.where("patent_id LIKE '1%'").withColumn("patent_title", F.concat("patent_title", F.lit(" (again)")))
    raw = RawTables(fx.raw_patent.unionByName(again), fx.raw_inventor, fx.raw_assignee, fx.raw_location)
    star = build_star(spark, raw, str(tmp_path), relationships=False)
    assert rows(star.patents.select("patent_id", "title")) == rows(fx.star.patents.select("patent_id", "title"))


def test_fixtures_have_the_known_sizes(spark):
    small = Fixtures(spark, "/root/testdata/sf0.001")
    assert small.clean_patents.count() == 985
    assert small.clean_patent_inventor.count() == 3755
    assert small.clean_patent_company.count() == 1075
    assert small.clean_relationships.count() == 5951


def test_reports_of_a_lazy_star_read_what_was_written_once(spark, fx):
    """Patents and inventors' pairs are shared by the CSV reports; none of them reads the raw tables of these again."""
    lazy = reports.csv_reports(RawStar(fx))
    for name in ("top_inventors", "country_trends", "yearly_trends"):
        files = " ".join(lazy[name].inputFiles())
        assert "lineitem.parquet" not in files and "orders.parquet" not in files
    assert rows(lazy["top_inventors"]) == rows(reports.top_inventors(RawStar(fx)))


def test_rows_in_order_are_as_many_files_as_they_need(spark, fx, settings):
    """The files of spellings are ranges of their rows, and their number grows with the rows."""
    settings(adaptive__coalescePartitions__enabled="false")
    path = fx.spelling_file("patent_id", "location_id")
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".csv")]) > 4
