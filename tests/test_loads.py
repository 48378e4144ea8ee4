"""Loads that replace a star, add to it, fail, and report their rows."""

from __future__ import annotations

import time
import uuid

import pytest

from grantmill import session
from grantmill.operators import integrity
from grantmill.plans import load, reports
from grantmill.plans.star import RawTables, build_star
from tests.conftest import rows

PATENT = "patent_id string, patent_title string, patent_abstract string, patent_date string, patent_type string, wipo_kind string"
INVENTOR = "patent_id string, inventor_id string, disambig_inventor_name_first string, disambig_inventor_name_last string, inventor_country string"
ASSIGNEE = "patent_id string, assignee_id string, disambig_assignee_organization string, assignee_country string"


def raw(spark, patents, inventors, assignees):
    return RawTables(spark.createDataFrame(patents, PATENT), spark.createDataFrame(inventors, INVENTOR), spark.createDataFrame(assignees, ASSIGNEE))


def patent(number, title="T", date="2020-01-02", kind="utility"):
    return (number, title, "text", date, kind, "A")


def inventor(number, who, name="Ann"):
    return (number, who, name, "Lee", "US")


def company(number, who, name="Firm"):
    return (number, who, name, "DE")


FIRST = (
    [patent("p1", "B"), patent("p1", "A"), patent("p1", "A"), patent("p2"), patent("p3", None), patent(None), patent("p4", date="x"), patent("p5", kind="design")],
    [inventor("p1", "i1"), inventor("p1", "i1"), ("p2", "i9", "", None, "US"), inventor("p9", "i1"), inventor("p2", None)],
    [company("p1", "c1"), company("p2", "c1"), company("p3", "c1")],
)
SECOND = ([patent("p2", "Z"), patent("p6")], [inventor("p2", "i1"), inventor("p6", "i2", "Bo"), inventor("p6", "i1", "Other")], [company("p6", "c2", "New")])


def outcomes(star):
    return {(t, o): n for t, o, n in star.manifest.report if n}


def test_every_row_has_one_outcome(spark, tmp_path):
    star = load.replace_star(spark, raw(spark, *FIRST), f"{tmp_path}/star")
    assert outcomes(star) == {
        ("patents", "kept"): 2, ("patents", "repeated"): 2, ("patents", "untitled"): 1, ("patents", "no_id"): 1,
        ("patents", "no_date"): 1, ("patents", "other_type"): 1,
        ("patent_inventor", "kept"): 1, ("patent_inventor", "repeated"): 1, ("patent_inventor", "orphaned"): 1,
        ("patent_inventor", "unknown_patent"): 1, ("patent_inventor", "no_id"): 1,
        ("patent_company", "kept"): 2, ("patent_company", "unknown_patent"): 1,
        ("relationships", "kept"): 2,
    }
    assert rows(star.patents.select("patent_id", "title")) == [("p1", "A"), ("p2", "T")]
    assert rows(star.relationships()) == [("p1", "i1", "c1"), ("p2", None, "c1")]
    assert rows(star.rejected("patents").select("patent_id", "title", "reason")) == sorted(
        [("p1", "A", "repeated"), ("p1", "B", "repeated"), ("p3", None, "untitled"), (None, "T", "no_id"), ("p4", "T", "no_date"), ("p5", "T", "other_type")],
        key=repr,
    )
    assert rows(star.rejected("patent_inventor")) == sorted(
        [("p1", "i1", "repeated", 1), ("p9", "i1", "unknown_patent", 1), ("p2", None, "no_id", 1)], key=repr
    )
    assert rows(star.load_report)


def test_a_load_that_fails_leaves_the_old_star(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/star"
    old = load.replace_star(spark, raw(spark, *FIRST), root)
    before = rows(old.relationships())
    monkeypatch.setattr(load, "_company_years", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        load.replace_star(spark, raw(spark, *SECOND), root)
    with pytest.raises(ZeroDivisionError):
        load.add_to_star(spark, raw(spark, *SECOND), root)
    star = load.VersionedStar(spark, root)
    assert rows(star.relationships()) == before and star.manifest == old.manifest
    load.drop_old_loads(spark, root)
    assert all(len(list((tmp_path / "star" / t).glob("load=*"))) == 1 for t in ("patents", "relationships", "year_counts"))
    assert rows(load.VersionedStar(spark, root).relationships()) == before


def test_a_reader_keeps_its_version(spark, tmp_path):
    root = f"{tmp_path}/star"
    old = load.replace_star(spark, raw(spark, *FIRST), root)
    new = load.replace_star(spark, raw(spark, *SECOND), root)
    assert rows(old.patents.select("patent_id")) == [("p1",), ("p2",)]
    assert rows(new.patents.select("patent_id")) == [("p2",), ("p6",)]
    assert new.manifest.version == 2


def test_added_batches(spark, tmp_path):
    root = f"{tmp_path}/star"
    load.add_to_star(spark, raw(spark, *FIRST), root)
    star = load.add_to_star(spark, raw(spark, *SECOND), root)
    assert outcomes(star)[("patents", "known")] == 1
    assert outcomes(star)[("patent_inventor", "unknown_patent")] == 1
    found = rows(star.relationships())
    assert found == sorted([("p1", "i1", "c1"), ("p2", None, "c1"), ("p6", "i1", "c2"), ("p6", "i2", "c2")], key=repr)
    assert rows(star.inventors.select("inventor_id", "name")) == [("i1", "Ann Lee"), ("i2", "Bo Lee")]
    again = load.add_to_star(spark, raw(spark, *SECOND), root)
    assert rows(again.relationships()) == found
    assert [r.id for r in again.numbered_relationships.orderBy("id").collect()] == [1, 2, 3, 4]
    for table, key in (("patents", "patent_id"), ("inventors", "inventor_id"), ("companies", "company_id")):
        assert integrity.check_unique_key(getattr(again, table), key).isEmpty()
    assert rows(reports.yearly_trend(again)) == [(2020, 3)]
    assert rows(reports.company_counts_by_year(again)) == [(2020, "Firm", 2), (2020, "New", 1)]


def test_kept_counts_read_no_patents(spark, tmp_path):
    star = load.replace_star(spark, raw(spark, *FIRST), f"{tmp_path}/star")
    for report in (reports.yearly_trend(star), reports.top_companies_per_year(star)):
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        assert "patent_id" not in plan and "Join" not in plan


def test_empty_raw_tables_and_no_star(spark, tmp_path):
    assert load.VersionedStar(spark, f"{tmp_path}/none").patents.isEmpty()
    star = load.replace_star(spark, raw(spark, [], [], []), f"{tmp_path}/star")
    assert star.patents.isEmpty() and star.relationships().isEmpty() and star.rejected("patents").isEmpty()
    assert rows(reports.yearly_trend(star)) == []


def test_a_load_leaves_no_scratch(spark, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    made = []

    def scratch_path(_, name):
        made.append(name)
        return f"{shared}/{uuid.uuid4().hex}/{name}"

    monkeypatch.setattr(session, "scratch_path", scratch_path)
    load.replace_star(spark, raw(spark, *FIRST), f"{tmp_path}/star")
    build_star(spark, raw(spark, *FIRST), f"{tmp_path}/plain")
    assert made and not list(shared.iterdir())


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def left_after(spark, before, seconds=10):
    """New shuffle files that are still there; Spark deletes them in the background."""
    for _ in range(seconds * 10):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_shuffles_of_a_load_do_not_pile_up(spark, tmp_path, monkeypatch):
    """They go with the action that made them: one pair table's before the other's are written, and all of them at the end."""
    before, left, write = shuffle_files(spark), {}, load._write_routed

    def write_routed(df, path, table, *more, **named):
        if table == "patent_company":
            left[table] = left_after(spark, before)
        counts = write(df, path, table, *more, **named)
        if table != "patents":
            left[f"{table}, written"] = left_after(spark, before)
        return counts

    monkeypatch.setattr(load, "_write_routed", write_routed)
    star = load.add_to_star(spark, raw(spark, *FIRST), f"{tmp_path}/star")
    star = load.add_to_star(spark, raw(spark, *SECOND), f"{tmp_path}/star")
    left["loads"] = left_after(spark, before)
    assert len(left) == 4 and not any(left.values())
    assert rows(reports.yearly_trend(star)) == [(2020, 3)]


def test_loads_leave_the_shuffle_setting_as_it_was(spark, tmp_path, monkeypatch, settings):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    inside = []
    monkeypatch.setattr(load, "_company_years", lambda *_: inside.append(spark.conf.get(name)) or 1 / 0)
    for old in (None, "false", "true"):
        if old is not None:
            settings(classic__shuffleDependency__fileCleanup__enabled=old)
        given = spark.conf.get(name, None)
        with pytest.raises(ZeroDivisionError):
            load.replace_star(spark, raw(spark, *FIRST), f"{tmp_path}/star")
        assert spark.conf.get(name, None) == given
    assert inside == ["true"] * 3


def test_stored_tables_are_small_files(spark, tmp_path):
    load.replace_star(spark, raw(spark, *FIRST), f"{tmp_path}/star")
    files = [f.name for f in (tmp_path / "star").rglob("*.parquet")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
