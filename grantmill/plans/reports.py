"""The seven reports and the summary built from them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantmill.functions.country import UNKNOWN
from grantmill.functions.text import bar, scaled_bar_length
from grantmill.operators.counting import (
    count_pairs_by,
    count_rows,
    distinct_patents_by,
    patents_per_year,
    with_share,
    year_between,
)
from grantmill.operators.joins import fresh_key, lookup_left, null_out_orphans
from grantmill.operators.ranking import (
    checked_size,
    few,
    head_n,
    rank_by_counts,
    tail_n,
    top_k,
    top_k_per_group,
    with_position,
    with_ranks_of_top,
)
from grantmill.plans.star import Star
from grantmill.session import materialize


def top_entities(
    pairs: DataFrame, dimension: DataFrame, key: str, k: int, resolved: bool, name: str = "patent_count"
) -> DataFrame:
    """The k entities with most patents: ``key, name, country`` and the count.

    Pairs are counted before any join. Where every id has its dimension row
    the k rows are cut first, and k is at most some dozens, so they are what is
    broadcast. Else counts and dimension meet one to one, both grouped by the key.
    """
    counts = count_pairs_by(pairs, key, name)
    if resolved:
        found = dimension.join(few(top_k(counts, k, name, key), k), key)
    else:
        found = counts.join(dimension, key)
    return top_k(found, k, name, key).select(key, "name", "country", name)


def top_inventors(star: Star, k: int = 20) -> DataFrame:
    """Q1."""
    top = top_entities(star.patent_inventor, star.inventors, "inventor_id", k, star.resolved)
    return top.select(F.col("name").alias("inventor"), "country", "patent_count")


def top_companies(star: Star, k: int = 20) -> DataFrame:
    """Q2."""
    top = top_entities(star.patent_company, star.companies, "company_id", k, star.resolved)
    return top.select(F.col("name").alias("company"), "country", "patent_count")


def country_counts(star: Star, excluded: tuple[str, ...], name: str = "patent_count") -> DataFrame:
    """Distinct patents by inventor country, some countries left out."""
    placed = star.inventors.select("inventor_id", "country").where(~F.col("country").isin(*excluded))
    found = star.patent_inventor.join(fresh_key(placed, "inventor_id"), "inventor_id")
    return distinct_patents_by(found, "country", name=name)


def top_countries(
    star: Star, k: int = 20, excluded: tuple[str, ...] = (UNKNOWN, ""), share_name: str = "pct_share"
) -> DataFrame:
    """Q3: shares may add up to more than 100, a patent counts in each of its countries."""
    top = top_k(country_counts(star, excluded), k, "patent_count", "country")
    return with_share(top, count_rows(star.patents, "total"), share_name)


def year_counts(star: Star, first: int, last: int, name: str = "patent_count") -> DataFrame:
    """Patents per year: added up where every load kept its own counts, else counted."""
    kept = star.kept_counts("year_counts")
    if kept is None:
        return patents_per_year(star.patents, first, last, name)
    return kept.where(year_between(first, last)).groupBy("year").agg(F.sum("patent_count").alias(name))


def yearly_trend(star: Star, first: int = 1976, last: int = 2025, name: str = "patent_count") -> DataFrame:
    """Q4."""
    return year_counts(star, first, last, name).orderBy("year")


def patent_detail(star: Star, since: int = 2000, k: int = 500) -> DataFrame:
    """Q5: patents with inventors and companies, the first k rows by patent, inventor and company.

    Every row of one step gives at least one row of the next, in the same order,
    so k patents, then k pairs, are enough. The k patents and the k rows of
    detail are written, as several joins read them; only they are broadcast.
    Every other table is scanned once and none is shuffled whole.
    """
    k = checked_size(k)
    relevant = star.patents.where(F.col("year") >= since).select("patent_id", "title", "year")
    patents = materialize(head_n(relevant, k, "patent_id"), "first_patents")
    pi, pc = star.patent_inventor, star.patent_company
    ids = few(patents.select("patent_id"), k)
    pi = _first_per_patent(pi.join(ids, "patent_id", "left_semi"), "inventor_id", star.inventors, star.resolved, k)
    pc = _first_per_patent(pc.join(ids, "patent_id", "left_semi"), "company_id", star.companies, star.resolved, k)
    with_inventors = head_n(
        patents.join(pi, "patent_id", "left"), k, "patent_id", F.asc_nulls_first("inventor_id")
    )
    detail = head_n(
        with_inventors.join(pc, "patent_id", "left"),
        k,
        "patent_id",
        F.asc_nulls_first("inventor_id"),
        F.asc_nulls_first("company_id"),
    )
    detail = materialize(detail, "detail")
    inventors = star.inventors.select(
        "inventor_id", F.col("name").alias("inventor_name"), F.col("country").alias("inventor_country")
    )
    companies = star.companies.select("company_id", F.col("name").alias("company_name"))
    return (
        _names_of(detail, inventors, "inventor_id", k)
        .transform(_names_of, companies, "company_id", k)
        .orderBy("patent_id", F.asc_nulls_first("inventor_id"), F.asc_nulls_first("company_id"))
        .select("patent_id", "title", "year", "inventor_name", "inventor_country", "company_name")
    )


def _names_of(rows: DataFrame, dimension: DataFrame, key: str, k: int) -> DataFrame:
    """Names for a short list of rows: the dimension is filtered by their ids, not shuffled."""
    named = dimension.join(few(rows.select(key), k), key, "left_semi")
    return rows.join(named, key, "left")


def _first_per_patent(pairs: DataFrame, key: str, dimension: DataFrame, resolved: bool, k: int) -> DataFrame:
    """At most k pairs of each patent, in key order, orphaned ids null and first."""
    if not resolved:
        pairs = null_out_orphans(pairs, key, dimension)
    order = Window.partitionBy("patent_id").orderBy(F.asc_nulls_first(key))
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def patents_full_detail(star: Star) -> DataFrame:
    """Every patent with every inventor and company of it: the join of Q5 without its limit.

    Ids alone go through the pairing; titles and names are looked up for its rows.
    """
    inventors = star.inventors.select(
        "inventor_id", F.col("name").alias("inventor_name"), F.col("country").alias("inventor_country")
    )
    companies = star.companies.select("company_id", F.col("name").alias("company_name"))
    named = lookup_left(star.detail_ids(), inventors, "inventor_id", spread_by="patent_id")
    return lookup_left(named, companies, "company_id", spread_by="patent_id").select(
        "patent_id", "title", "year", "inventor_name", "inventor_country", "company_name"
    )


def company_counts_by_year(star: Star, first: int = 2015, last: int = 2024) -> DataFrame:
    """Distinct patents per year and company name; companies of one name count together.

    Years are filtered before the pairs are joined, and names are looked up last. Where
    every load kept its counts they are added up: a patent is in one load only.
    """
    kept = star.kept_counts("company_year_counts")
    if kept is not None:
        return kept.where(year_between(first, last)).groupBy("year", "company").agg(F.sum("patent_count").alias("patent_count"))
    dated = star.patents.where(year_between(first, last)).select("patent_id", "year")
    named = star.companies.where(F.col("name").isNotNull()).select("company_id", F.col("name").alias("company"))
    pairs = fresh_key(star.patent_company, "patent_id")
    rows = pairs.join(fresh_key(dated, "patent_id"), "patent_id").join(fresh_key(named, "company_id"), "company_id")
    return distinct_patents_by(rows, "year", "company")


def top_companies_per_year(star: Star, first: int = 2015, last: int = 2024, k: int = 5) -> DataFrame:
    """Q6."""
    ranked = top_k_per_group(company_counts_by_year(star, first, last), k, "year", "patent_count", "yearly_rank")
    return ranked.select("year", "yearly_rank", "company", "patent_count").orderBy(
        F.desc("year"), "yearly_rank", "company"
    )


def inventor_counts(star: Star) -> DataFrame:
    """Patents of every inventor that has any: ``inventor_id, patent_count``."""
    counts = count_pairs_by(star.patent_inventor, "inventor_id")
    return counts if star.resolved else counts.join(star.inventors.select("inventor_id"), "inventor_id", "left_semi")


def inventor_ranking(star: Star, k: int = 50) -> DataFrame:
    """Q7: ranks and share of all counts, for the k inventors with most patents."""
    counts = inventor_counts(star)
    total = counts.agg(F.sum("patent_count").alias("total"))
    top = with_ranks_of_top(top_k(counts, k, "patent_count", "inventor_id"), "patent_count")
    ranked = star.inventors.join(few(top, k), "inventor_id")
    return with_share(ranked, total, "pct_of_total", 4).orderBy(F.desc("patent_count"), "inventor_id").select(
        "rank", "dense_rank", F.col("name").alias("inventor"), "country", "patent_count", "pct_of_total"
    )


def rank_all_inventors(star: Star) -> DataFrame:
    """The ranks and share of Q7 for every inventor."""
    counts = inventor_counts(star)
    total = counts.agg(F.sum("patent_count").alias("total"))
    return with_share(rank_by_counts(counts, "patent_count"), total, "pct_of_total", 4).select(
        "inventor_id", "patent_count", "rank", "dense_rank", "pct_of_total"
    )


def report_header(star: Star) -> DataFrame:
    """Total, first and last year, in one pass."""
    return star.patents.agg(
        F.count("*").alias("total_patents"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


def report_top10(star: Star, k: int = 10) -> DataFrame:
    """Ranked top-k inventors, companies and countries in one table."""
    inventors = top_entities(star.patent_inventor, star.inventors, "inventor_id", k, star.resolved)
    companies = top_entities(star.patent_company, star.companies, "company_id", k, star.resolved)
    countries = top_countries(star, k)
    no_share = F.lit(None).cast("double")

    def section(name: str, rows: DataFrame, label: str, tie: str, share) -> DataFrame:
        placed = with_position(rows, F.desc("patent_count"), tie)
        return placed.select(
            F.lit(name).alias("section"),
            F.col("rank").cast("bigint").alias("rank"),
            F.col(label).alias("name"),
            "country",
            F.col("patent_count").alias("patents"),
            share.alias("share"),
        )

    return functools.reduce(
        DataFrame.unionByName,
        [
            section("inventors", inventors, "name", "inventor_id", no_share),
            section("companies", companies, "name", "company_id", no_share),
            section("countries", countries, "country", "country", F.col("pct_share")),
        ],
    )


def report_trend_bars(star: Star, years: int = 10, width: int = 30) -> DataFrame:
    """The last years of Q4 with a bar scaled to the largest of them."""
    recent = tail_n(yearly_trend(star), years, "year")
    # At most ``years`` rows reach this window.
    largest = F.max("patent_count").over(Window.partitionBy())
    length = scaled_bar_length(F.col("patent_count"), largest, width)
    return recent.select("year", length.alias("bar_len"), bar(length).alias("bar"), "patent_count").orderBy("year")


def report_json(star: Star, k: int = 10) -> DataFrame:
    """The nested summary as one row. Its lists hold k or, for the years, at most 50 entries."""

    def ordered_list(rows: DataFrame, order, *fields) -> DataFrame:
        entry = F.struct(order.alias("_order"), F.struct(*fields).alias("entry"))
        in_order = F.sort_array(F.collect_list(entry))
        return rows.agg(F.transform(in_order, lambda e: e["entry"]).alias("entries"))

    def ranked_list(rows: DataFrame, tie: str, ranked: bool, *fields) -> DataFrame:
        placed = with_position(rows, F.desc("patent_count"), tie)
        rank = F.col("rank").cast("bigint")
        return ordered_list(placed, rank, *([rank.alias("rank")] if ranked else []), *fields)

    patents = F.col("patent_count").alias("patents")
    named = ("name", "country", patents)
    inventors = top_entities(star.patent_inventor, star.inventors, "inventor_id", k, star.resolved)
    companies = top_entities(star.patent_company, star.companies, "company_id", k, star.resolved)
    share = F.col("pct_share").alias("share")
    trend = ordered_list(yearly_trend(star), F.col("year"), "year", patents)
    return count_rows(star.patents, "total_patents").select(
        "total_patents",
        ranked_list(inventors, "inventor_id", True, *named).scalar().alias("top_inventors"),
        ranked_list(companies, "company_id", True, *named).scalar().alias("top_companies"),
        ranked_list(top_countries(star, k), "country", False, "country", patents, share)
        .scalar()
        .alias("top_countries"),
        trend.scalar().alias("yearly_trend"),
    )


def all_reports(star: Star) -> dict[str, DataFrame]:
    """Q1 to Q7 by the names of their plans."""
    return {
        "top_inventors": top_inventors(star),
        "top_companies": top_companies(star),
        "top_countries": top_countries(star),
        "yearly_trend": yearly_trend(star),
        "patent_detail": patent_detail(star),
        "top_companies_per_year": top_companies_per_year(star),
        "inventor_ranking": inventor_ranking(star),
    }


def csv_reports(star: Star) -> dict[str, DataFrame]:
    """The four reports that are exported as CSV, by file name."""
    star = star.for_counts()
    return {
        "top_inventors": top_inventors(star),
        "top_companies": top_companies(star),
        "country_trends": top_countries(star),
        "yearly_trends": yearly_trend(star),
    }

