"""Pairings over raw tables: patents and pairs are made once and written before they are paired."""

from __future__ import annotations

from grantmill.operators.joins import pair_per_patent
from grantmill.plans import reports
from grantmill.plans import star as star_plans
from grantmill.plans.star import RawStar, RawTables
from tests.conftest import rows

RAW = ("raw_patent", "raw_inventor", "raw_assignee")


def _raw_folder_star(spark, folder) -> RawStar:
    """A star over raw tables in files: two inventors, one known company and patents without pairs."""
    tables = {
        "raw_patent": ([("p1", "One", "2020-01-02", "utility"), ("p2", "Two", "2021-01-02", "utility"), ("p2", "Two", "2021-01-02", "utility"),
                        ("p3", "Three", "2021-05-06", "utility"), ("p4", None, "2021-05-06", "utility")],
                       "patent_id string, patent_title string, patent_date string, patent_type string"),
        "raw_inventor": ([("p1", "i1", "Ann", "Lee", "US"), ("p1", "i1", "Ann", "Lee", "US"), ("p1", "i2", "Bo", "Ek", "SE"), ("p2", "i3", "X", None, None),
                          ("p4", "i1", "Ann", "Lee", "US"), (None, "i2", "Bo", "Ek", "SE")],
                         "patent_id string, inventor_id string, disambig_inventor_name_first string, disambig_inventor_name_last string, inventor_country string"),
        "raw_assignee": ([("p1", "c1", "Group"), ("p2", "c2", "Z"), ("p9", "c1", "Group")],
                         "patent_id string, assignee_id string, disambig_assignee_organization string"),
    }
    for name, (content, schema) in tables.items():
        spark.createDataFrame(content, schema).write.parquet(f"{folder}/{name}")
    return RawStar(RawTables(*[spark.read.parquet(f"{folder}/{name}") for name in tables]))


def _reads(df, *tables: str) -> bool:
    """Whether the plan reads files of these tables."""
    return any(f"/{t}/" in file for file in df.inputFiles() for t in tables)


def test_relationships_of_raw_tables_read_patents_once(spark, tmp_path):
    star = _raw_folder_star(spark, tmp_path)
    found = star.relationships()
    assert rows(found) == [("p1", "i1", "c1"), ("p1", "i2", "c1"), ("p2", None, None)]
    # They and the pairs are in scratch files by now.
    assert not _reads(found, *RAW)


def test_numbered_relationships_pair_written_tables(spark, tmp_path, monkeypatch):
    star, asked = _raw_folder_star(spark, tmp_path), []
    monkeypatch.setattr(star_plans, "pair_per_patent", lambda *pairs: asked.extend(pairs) or pair_per_patent(*pairs))
    found = star_plans.load_relationships(star.patent_inventor, star.patent_company, star.inventors, star.companies, star.patents)
    assert rows(found) == [(1, "p1", "i1", "c1"), (2, "p1", "i2", "c1"), (3, "p2", None, None)]
    assert len(asked) == 2 and not any(_reads(pairs, *RAW) for pairs in asked)


def test_full_detail_of_raw_tables_reads_patents_once(spark, tmp_path):
    star = _raw_folder_star(spark, tmp_path)
    found = reports.patents_full_detail(star)
    assert rows(found) == [
        ("p1", "One", 2020, "Ann Lee", "United States", "Group"),
        ("p1", "One", 2020, "Bo Ek", "Sweden", "Group"),
        ("p2", "Two", 2021, None, None, None),
        ("p3", "Three", 2021, None, None, None),
    ]
    assert not _reads(found, "raw_patent")
