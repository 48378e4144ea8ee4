"""Patents and pairs in buckets: the same detail, without exchanges but for hot patents."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from grantmill.plans import buckets, reports
from grantmill.plans.star import StoredStar
from tests.conftest import executed_plan, rows


@pytest.fixture(scope="module")
def bucketed(stored, tmp_path_factory):
    return buckets.bucket_star(stored, str(tmp_path_factory.mktemp("buckets")), 7)


def no_broadcast(settings):
    settings(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")


def test_tables_and_reports_are_the_same(stored, bucketed):
    for name in ("patents", "patent_inventor", "patent_company"):
        assert Counter(rows(getattr(bucketed, name))) == Counter(rows(getattr(stored, name)))
    assert Counter(rows(reports.patents_full_detail(bucketed))) == Counter(rows(reports.patents_full_detail(stored)))
    assert rows(reports.top_companies_per_year(bucketed)) == rows(reports.top_companies_per_year(stored))
    assert rows(reports.patent_detail(bucketed)) == rows(reports.patent_detail(stored))


def test_joins_by_patent_have_no_exchange(bucketed, settings):
    no_broadcast(settings)
    pairs = bucketed.in_buckets("patents").join(bucketed.in_buckets("patent_inventor"), "patent_id")
    plan = executed_plan(pairs.join(bucketed.in_buckets("patent_company"), "patent_id", "left"))
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan


def test_a_hot_patent_stands_apart_and_is_split(spark, stored, tmp_path, settings):
    n = F.col("id")
    many = spark.range(0, 24_000, 1, 8).select(
        F.when(n % 3 == 0, "1000001").otherwise((n % 4000).cast("string")).alias("patent_id"), n.cast("string").alias("inventor_id")
    )
    star = StoredStar(spark, "none")
    star.patents = stored.patents.limit(0).unionByName(
        spark.range(4001).select(F.when(n == 4000, "1000001").otherwise(n.cast("string")).alias("patent_id"), F.lit("t").alias("title"), F.lit(2000).alias("year")),
        allowMissingColumns=True,
    )
    star.patent_inventor = many
    star.patent_company = spark.range(500).select((n % 300).cast("string").alias("patent_id"), n.cast("string").alias("company_id"))
    star.inventors, star.companies = stored.inventors, stored.companies
    found = buckets.bucket_star(star, str(tmp_path / "buckets"), 5)
    assert "1000001" in {r.patent_id for r in found.hot("patents").collect()}
    assert found.in_buckets("patent_inventor").where("patent_id = '1000001'").isEmpty()
    no_broadcast(settings)
    settings(
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20000",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="20000",
        adaptive__coalescePartitions__enabled="false",
    )
    detail = found.detail_ids()
    assert "SortMergeJoin(skew=true)" in executed_plan(detail)
    assert detail.count() == star.detail_ids().count()


def test_another_session_reads_the_buckets(spark, stored, bucketed):
    other = spark.newSession()
    again = buckets.BucketedStar(other, bucketed._root, stored)
    assert again.buckets == 7
    assert again.in_buckets("patent_inventor").count() == bucketed.in_buckets("patent_inventor").count()
