"""Chart and dashboard datasets: the report plans with other parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantmill.functions.country import UNKNOWN
from grantmill.functions.text import label, matches_keyword, share
from grantmill.operators.counting import count_rows, year_between, year_min_max
from grantmill.operators.ranking import checked_size, few, head_n, top_k
from grantmill.plans.reports import country_counts, top_companies, top_countries, top_entities, top_inventors, year_counts
from grantmill.plans.star import Star

NOT_A_COUNTRY = (UNKNOWN, "", "XX")
LEAST_ROWS, MOST_ROWS = 5, 50
SEARCH_ROWS = 100


def chart_yearly_trend(star: Star, first: int = 1980, last: int = 2024) -> DataFrame:
    """V1."""
    return year_counts(star, first, last, "cnt").orderBy("year")


def chart_top_companies(star: Star, k: int = 15) -> DataFrame:
    """V2: the k largest, smallest first."""
    top = top_entities(star.patent_company, star.companies, "company_id", k, star.resolved, "cnt")
    return top.orderBy("cnt", "company_id").select(F.col("name").alias("company"), "cnt")


def chart_country_share(star: Star, k: int = 12) -> DataFrame:
    """V3: the share of each country among those shown."""
    top = top_k(country_counts(star, NOT_A_COUNTRY, "cnt"), k, "cnt", "country")
    # Only the k shown rows reach this window.
    return top.withColumn("share", share(F.col("cnt"), F.sum("cnt").over(Window.partitionBy()), 1)).orderBy(
        F.desc("cnt"), "country"
    )


def chart_top_inventors(star: Star, k: int = 15) -> DataFrame:
    """V4: the k largest, smallest first, labelled with their country."""
    top = top_entities(star.patent_inventor, star.inventors, "inventor_id", k, star.resolved, "cnt")
    return top.orderBy("cnt", "inventor_id").select(label(F.col("name"), F.col("country")).alias("label"), "cnt")


def dash_kpis(star: Star) -> DataFrame:
    """D1: one row of headline numbers."""
    years = year_min_max(star.patents, "y1", "y2")
    return years.select(
        count_rows(star.patents, "n").scalar().alias("total_patents"),
        count_rows(star.inventors, "n").scalar().alias("unique_inventors"),
        count_rows(star.companies, "n").scalar().alias("companies"),
        "y1",
        "y2",
    )


def dash_trend(star: Star, first: int = 1976, last: int = 2024) -> DataFrame:
    """D2."""
    return year_counts(star, first, last).orderBy("year")


def recent_years(trend: DataFrame, back: int = 10) -> DataFrame:
    """Years from ``back`` before the last one on: one more than ``back`` where none is missing."""
    return trend.where(F.col("year") >= trend.agg(F.max("year")).scalar() - F.lit(back))


def dash_recent_decade(star: Star) -> DataFrame:
    """D3."""
    return recent_years(dash_trend(star)).orderBy("year")


def dash_top_inventors(star: Star, n: int = 15) -> DataFrame:
    """D4."""
    return top_inventors(star, checked_size(n, LEAST_ROWS, MOST_ROWS))


def dash_top_companies(star: Star, n: int = 15) -> DataFrame:
    """D5."""
    return top_companies(star, checked_size(n, LEAST_ROWS, MOST_ROWS))


def dash_countries(star: Star, k: int = 20) -> DataFrame:
    """D6."""
    return top_countries(star, k, NOT_A_COUNTRY, "pct")


def search_patents(
    star: Star, keyword: str, first: int = 2010, last: int = 2024, limit: int = SEARCH_ROWS
) -> DataFrame:
    """D7: the newest patents whose title contains the keyword; an empty keyword finds none.

    On the stored star the hits are found without abstracts, which are then read for the
    years of the hits alone. A long list of hits is joined without a hint.
    """
    wanted = star.patents.where(year_between(first, last))
    found = wanted.where(matches_keyword(F.col("title"), keyword)) if keyword else wanted.where(F.lit(False))
    order = (F.desc("year"), "patent_id")
    if not star.resolved:
        return head_n(found.select("patent_id", "title", "year", "abstract"), limit, *order)
    hits = head_n(found.select("patent_id", "title", "year"), limit, *order)
    texts = star.patents.select("patent_id", "year", "abstract").join(few(hits, limit), ["year", "patent_id"])
    return texts.select("patent_id", "title", "year", "abstract").orderBy(*order)


def search_hit_count(hits: DataFrame) -> DataFrame:
    """The number of rows a search shows."""
    return count_rows(hits, "hits")
