"""Plan shapes and hot keys: what must hold when one key has a third of all rows."""

from __future__ import annotations

import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from checks import joins_counts  # noqa: F401
from checks.registry import CHECKS
from grantmill.operators import counting, dedupe, integrity, joins, ranking
from grantmill.plans import clean, reports
from tests.conftest import executed_plan, rows

N = 30_000


@pytest.fixture
def no_broadcast(settings):
    """Joins as they are on large tables, with thresholds that make small data look skewed."""
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20000",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="20000",
        adaptive__coalescePartitions__enabled="false",
    )


@pytest.fixture(scope="module")
def hot_pairs(spark, tmp_path_factory):
    """Pairs in which one patent and one inventor each hold a third of the rows."""
    path = str(tmp_path_factory.mktemp("hot") / "pairs")
    n = F.col("id")
    spark.range(0, N, 1, 8).select(
        F.when(n % 3 == 0, "hot").otherwise((n % 5000).cast("string")).alias("patent_id"),
        F.when(n % 3 == 1, "hot").otherwise(n.cast("string")).alias("inventor_id"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def patents(spark):
    return spark.range(4000).select(F.col("id").cast("string").alias("patent_id")).union(spark.sql("SELECT 'hot'"))


def test_hot_patent_is_split_in_the_semi_join(spark, hot_pairs, no_broadcast):
    raw = hot_pairs.withColumn("disambig_inventor_id", F.col("inventor_id"))
    found = clean.clean_patent_inventor(raw, patents(spark))
    plan = executed_plan(found)
    assert "SortMergeJoin(skew=true)" in plan
    valid = {str(i) for i in range(4000)} | {"hot"}
    expected = {(p, i) for p, i in rows(hot_pairs) if p in valid}
    assert set(rows(found)) == expected and found.count() == len(expected)


def test_hot_patent_is_split_where_patents_were_just_grouped(spark, hot_pairs, no_broadcast):
    loaded = dedupe.keep_first(patents(spark).withColumn("n", F.lit(1)), "patent_id")
    raw = hot_pairs.withColumn("disambig_inventor_id", F.col("inventor_id"))
    found = clean.clean_patent_inventor(raw, loaded)
    assert "SortMergeJoin(skew=true)" in executed_plan(found)


def test_hot_inventor_is_split_in_the_country_count(spark, hot_pairs, no_broadcast):
    inventors = hot_pairs.select("inventor_id").distinct()
    inventors = inventors.select("inventor_id", F.lit("n").alias("name"), F.lit("Here").alias("country"))
    star = SimpleNamespace(inventors=inventors, patent_inventor=hot_pairs)
    counted = reports.country_counts(star, ())
    assert "SortMergeJoin(skew=true)" in executed_plan(counted)
    assert rows(counted) == [("Here", len({p for p, _ in rows(hot_pairs)}))]


def test_hot_patent_is_split_in_the_whole_detail(spark, hot_pairs, no_broadcast):
    few = hot_pairs.where("inventor_id <> 'hot'").distinct()
    named = patents(spark).select("patent_id", F.lit("t").alias("title"), F.lit(2000).alias("year"))
    with_pairs = joins.with_patent(joins.keep_valid_patents(few, named), named)
    assert "SortMergeJoin(skew=true)" in executed_plan(with_pairs)
    used = Counter(p for p, _ in rows(few))
    assert with_pairs.count() == sum(max(used[p], 1) for (p,) in rows(patents(spark)))


def test_hot_patent_is_split_on_both_sides_of_the_pairing(spark, hot_pairs, no_broadcast):
    n = F.col("id")
    companies = spark.range(0, 3000, 1, 8).select(
        F.when(n < 60, "hot").otherwise((n + 3000).cast("string")).alias("patent_id"),
        n.cast("string").alias("company_id"),
    )
    few = hot_pairs.where("inventor_id <> 'hot'")
    paired = joins.pair_per_patent(few, companies)
    plan = executed_plan(paired)
    assert "FullOuter" not in plan and "SortMergeJoin(skew=true)" in plan
    by_patent = Counter(p for p, _ in rows(few))
    by_patent_c = Counter(p for p, _ in rows(companies))
    expected = sum(max(by_patent[p], 1) * max(by_patent_c[p], 1) for p in by_patent | by_patent_c)
    assert paired.count() == expected


def test_hot_inventor_is_split_in_the_orphan_lookup(spark, hot_pairs, no_broadcast):
    known = spark.sql("SELECT 'hot' AS inventor_id").union(spark.range(900).select(F.col("id").cast("string")))
    repaired = joins.null_out_orphans(hot_pairs, "inventor_id", known)
    assert "SortMergeJoin(skew=true)" in executed_plan(repaired)
    ids = {"hot"} | {str(i) for i in range(900)}
    assert Counter(rows(repaired)) == Counter((p, i if i in ids else None) for p, i in rows(hot_pairs))


@pytest.mark.parametrize("key", ["sql_cte_chain", "sql_scalar_subquery", "sql_order_by_alias"])
def test_hot_keys_are_split_in_sql(spark, hot_pairs, no_broadcast, key):
    """A third of the pairs have one inventor, or one company; the dimensions were just grouped."""
    named = hot_pairs.groupBy("inventor_id").agg(F.first(F.lit("n")).alias("name"), F.first(F.lit("Here")).alias("country"))
    pairs = hot_pairs.distinct()
    companies = named.withColumnRenamed("inventor_id", "company_id")
    dated = patents(spark).withColumn("year", F.lit(2020))
    star = SimpleNamespace(patents=dated, inventors=named, companies=companies, patent_inventor=pairs, patent_company=pairs.withColumnRenamed("inventor_id", "company_id"))
    found = CHECKS[key].run(SimpleNamespace(spark=spark, star=star))
    assert "SortMergeJoin(skew=true)" in executed_plan(found)
    known = {str(i) for i in range(4000)} | {"hot"}
    used = {p for p, _ in rows(hot_pairs)}
    counts = {"sql_cte_chain": len(used & known), "sql_order_by_alias": len(used), "sql_scalar_subquery": round(100 * len(used) / 4001, 2)}
    assert counts[key] in rows(found)[0]


@pytest.mark.parametrize("key", ["sql_derived_table", "sql_checked_limit"])
def test_sql_counts_before_it_joins(spark, hot_pairs, no_broadcast, key):
    named = hot_pairs.select("inventor_id", F.lit("n").alias("name"), F.lit("Here").alias("country")).distinct()
    star = SimpleNamespace(
        patents=None, inventors=named, companies=named.withColumnRenamed("inventor_id", "company_id"),
        patent_inventor=hot_pairs, patent_company=hot_pairs.withColumnRenamed("inventor_id", "company_id"),
    )
    plan = CHECKS[key].run(SimpleNamespace(spark=spark, star=star))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi.*\n(.*\n)?.*Aggregate \[(inventor|company)_id", plan)


def test_null_keys_do_not_meet_in_one_task(spark, settings):
    settings(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    left = spark.range(0, N, 1, 8).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("k"), "id")
    right = spark.range(0, N, 100).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    joined = joins.lookup_left(left, right, "k", spread_by="id")
    per_task = joined.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) < 2 * N / len(per_task)
    assert joined.where("v IS NOT NULL").count() == N / 100
    assert joined.where("k IS NULL AND v IS NOT NULL").count() == 0


def test_counts_are_combined_before_the_shuffle(spark, hot_pairs):
    for counts in (
        counting.count_pairs_by(hot_pairs, "inventor_id"),
        integrity.check_unique_key(hot_pairs, "inventor_id"),
    ):
        assert "partial_count" in executed_plan(counts)
    distinct = executed_plan(counting.distinct_patents_by(hot_pairs, "inventor_id"))
    assert re.search(r"Exchange hashpartitioning\(inventor_id#\d+, patent_id#\d+", distinct)


def test_first_row_of_a_hot_key_is_combined_before_the_shuffle(spark, hot_pairs):
    first = dedupe.keep_first(hot_pairs, "inventor_id")
    plan = executed_plan(first)
    assert "partial_min" in plan and "Window" not in plan
    assert dict(rows(first.select("inventor_id", "patent_id")))["hot"] == min(
        p for p, i in rows(hot_pairs) if i == "hot"
    )


def test_rank_of_all_rows_equals_a_window_without_one(spark, hot_pairs):
    counts = counting.count_pairs_by(hot_pairs, "inventor_id")
    ranked = ranking.rank_by_counts(counts, "patent_count")
    plan = executed_plan(ranked)
    before_histogram = plan[plan.index("Window") :]
    assert "hashpartitioning(patent_count" in before_histogram, "only the histogram reaches the window"
    values = dict(rows(counts))
    expected = {k: 1 + sum(v > n for v in values.values()) for k, n in values.items() if k in ("hot", "2", "5")}
    found = {r.inventor_id: r["rank"] for r in ranked.collect()}
    assert {k: found[k] for k in expected} == expected


def test_top_lists_keep_k_rows_per_task(stored):
    for result in (reports.top_inventors(stored), reports.top_companies(stored), reports.inventor_ranking(stored)):
        plan = executed_plan(result)
        assert "TakeOrderedAndProject(limit=" in plan
        assert "SortMergeJoin" not in plan


def test_rank_limit_is_applied_before_the_shuffle(stored):
    plan = executed_plan(reports.top_companies_per_year(stored))
    assert plan.count("WindowGroupLimit") == 2


def test_years_prune_partitions_and_columns(stored):
    plan = executed_plan(reports.yearly_trend(stored, 2000, 2010))
    assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ >= 2000", plan)
    assert "ReadSchema: struct<>" in plan


def test_trend_over_raw_tables_reads_no_abstract(fx):
    plan = executed_plan(reports.yearly_trend(fx.star))
    assert "SortAggregate" not in plan
    assert not re.search(r"Exchange.*abstract", plan)


def test_detail_broadcasts_only_limited_rows(stored, settings):
    settings(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    plan = executed_plan(reports.patent_detail(stored))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert len(rows(reports.patent_detail(stored))) == 500


def test_no_cross_joins(stored, fx):
    for star in (stored, fx.star):
        for name, result in reports.all_reports(star).items():
            plan = result._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_numbering_hands_no_task_all_rows(spark, hot_pairs, settings):
    settings(adaptive__advisoryPartitionSizeInBytes="20000", adaptive__coalescePartitions__minPartitionSize="1000")
    numbered = integrity.surrogate_id(hot_pairs.distinct(), "patent_id", "inventor_id")
    total = hot_pairs.distinct().count()
    assert [r.id for r in numbered.orderBy("id").select("id").collect()] == list(range(1, total + 1))
    assert "SinglePartition" not in re.sub(r"Window.*", "", executed_plan(numbered), flags=re.S)


def written_rows(df) -> list[int]:
    """Rows that each shuffle of a query wrote."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, open_ = [], [plan]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            open_.append(node.plan())
            continue
        if name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return found


def test_pairs_of_dropped_patents_stay_out_of_the_shuffle(spark, settings, tmp_path):
    """The Bloom filter of the valid patents is asked where the pairs are read; the join stays exact."""
    n = F.col("id")
    spark.range(0, 60_000, 1, 4).select(
        n.cast("string").alias("patent_id"), (n % 700).cast("string").alias("disambig_inventor_id")
    ).write.parquet(f"{tmp_path}/pairs")
    spark.range(3000).select(
        n.cast("string").alias("patent_id"), F.lit("t").alias("patent_title"), F.lit("2020-01-01").alias("patent_date"), F.lit("utility").alias("patent_type")
    ).write.parquet(f"{tmp_path}/patents")
    pairs, raw = spark.read.parquet(f"{tmp_path}/pairs"), spark.read.parquet(f"{tmp_path}/patents")
    bloom = "optimizer__runtime__bloomFilter__"
    settings(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1", **{bloom + "applicationSideScanSizeThreshold": "0"})
    found = clean.clean_patent_inventor(pairs, clean.clean_patents(raw))
    assert "might_contain" in found._jdf.queryExecution().optimizedPlan().toString()
    assert max(written_rows(found)) < 4000
    assert found.count() == 3000
    settings(**{bloom + "enabled": "false"})
    assert max(written_rows(clean.clean_patent_inventor(pairs, clean.clean_patents(raw)))) == 60_000


def test_compressed_tables_are_not_taken_for_small(spark, tmp_path):
    """A file of repeated text is some kilobytes, its rows in memory are not: it must not be broadcast by its file size."""
    n = F.col("id")
    wide = spark.range(0, 400_000, 1, 1).select(n.alias("k"), F.lit("much the same text in every row").alias("a"), F.lit("and more of it").alias("b"))
    wide.write.parquet(f"{tmp_path}/wide")
    table = spark.read.parquet(f"{tmp_path}/wide")
    size = sum(f.stat().st_size for f in (tmp_path / "wide").iterdir())
    assert size < 10 << 20
    counted = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert counted > 10 << 20


def test_a_cluster_cuts_large_shuffles_finely(monkeypatch):
    """The share of one task is bounded by settings wherever there are executors; a local session keeps its own."""
    from grantmill import session

    def tuned(master):
        conf = {}
        session.tune(SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(set=conf.__setitem__)))
        return conf

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert name not in tuned("local[8]") and name not in tuned("local")
    assert int(tuned("local-cluster[2,4,1024]")[name]) > 200 and int(tuned("yarn")[name]) > 200


def test_pairs_of_a_load_are_counted_where_they_are_looked_up(spark, settings, hot_pairs):
    """One exchange by patent and one by inventor; equal pairs are counted between them without another."""
    from grantmill.plans import load

    settings(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1", adaptive__forceOptimizeSkewedJoin="false")
    raw = hot_pairs.unionByName(hot_pairs.limit(100))
    entities = spark.range(50).select(F.col("id").cast("string").alias("inventor_id"))
    routed = load.route_pairs(raw, ["inventor_id"], "inventor_id", patents(spark), entities)
    moved = [n for n in written_rows(routed) if n > N // 2]
    assert len(moved) <= 2
    kept = routed.where("reason IS NULL OR reason = 'orphaned'").count()
    valid = {str(i) for i in range(4000)} | {"hot"}
    assert kept == len({(p, i) for p, i in rows(hot_pairs) if p in valid})
