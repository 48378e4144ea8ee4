"""Joins, aggregations, windows, sorts, SQL features and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import Fixtures
from checks.oracle import country
from checks.registry import check
from grantmill import schemas
from grantmill.functions.country import COUNTRY_NAMES, UNKNOWN, country_lookup
from grantmill.functions.text import scaled_bar_length, share
from grantmill.operators import columns, counting, dedupe, integrity, joins, ranking
from grantmill.plans import buckets, clean, datasets, reports
from grantmill.plans.star import build_star
from grantmill.sources.readers import read_table_query

# Joins


@check(
    "join_location_inventors",
    """SELECT patent_id, inventor_id, location_id, country_from_location
       FROM raw_inventor LEFT JOIN clean_locations USING (location_id)""",
)
def _(fx: Fixtures):
    rows = fx.raw_inventor.select("patent_id", "inventor_id", "location_id")
    return joins.lookup_left(rows, fx.clean_locations, "location_id", spread_by="inventor_id")


@check(
    "join_location_companies",
    """SELECT patent_id, assignee_id, location_id, country_from_location
       FROM raw_assignee LEFT JOIN clean_locations USING (location_id)""",
)
def _(fx: Fixtures):
    rows = fx.raw_assignee.select("patent_id", "assignee_id", "location_id")
    return joins.lookup_left(rows, fx.clean_locations, "location_id", spread_by="assignee_id")


@check(
    "country_lookup",
    f"""SELECT patent_id, inventor_id, {country("disambig_country")} AS country
        FROM raw_inventor LEFT JOIN raw_location USING (location_id)""",
)
def _(fx: Fixtures):
    names = fx.spark.createDataFrame(list(COUNTRY_NAMES.items()), "code string, name string")
    located = joins.lookup_left(fx.raw_inventor, fx.raw_location, "location_id", spread_by="inventor_id")
    return country_lookup(located, "disambig_country", names).select("patent_id", "inventor_id", "country")


@check(
    "semi_valid_patents",
    """SELECT patent_id, inventor_id FROM raw_inventor
       WHERE patent_id IN (SELECT patent_id FROM clean_patents)""",
)
def _(fx: Fixtures):
    return joins.keep_valid_patents(fx.raw_inventor.select("patent_id", "inventor_id"), fx.clean_patents)


@check("build_relationships", "SELECT patent_id, inventor_id, company_id FROM clean_relationships")
def _(fx: Fixtures):
    return joins.pair_per_patent(fx.clean_patent_inventor, fx.clean_patent_company)


@check(
    "semi_loaded_patents",
    "SELECT * FROM clean_relationships WHERE patent_id IN (SELECT patent_id FROM patents)",
)
def _(fx: Fixtures):
    return joins.keep_valid_patents(fx.clean_relationships, fx.star.patents)


@check(
    "null_out_orphans",
    """SELECT r.patent_id, i.inventor_id, r.company_id
       FROM clean_relationships r LEFT JOIN inventors i ON r.inventor_id = i.inventor_id""",
)
def _(fx: Fixtures):
    return joins.null_out_orphans(fx.clean_relationships, "inventor_id", fx.star.inventors)


@check(
    "rel_join_inventors",
    """SELECT r.patent_id, inventor_id, r.company_id, i.name, i.country
       FROM relationships r JOIN inventors i USING (inventor_id)""",
)
def _(fx: Fixtures):
    return fx.star.relationships().join(joins.fresh_key(fx.star.inventors, "inventor_id"), "inventor_id")


@check(
    "rel_join_companies",
    """SELECT r.patent_id, r.inventor_id, company_id, c.name, c.country
       FROM relationships r JOIN companies c USING (company_id)""",
)
def _(fx: Fixtures):
    return fx.star.relationships().join(joins.fresh_key(fx.star.companies, "company_id"), "company_id")


@check(
    "patents_rel_companies",
    """SELECT patent_id, year, inventor_id, company_id, company_name AS company
       FROM detail JOIN patents USING (patent_id) WHERE company_id IS NOT NULL""",
)
def _(fx: Fixtures):
    dated = fx.star.patents.select("patent_id", "year")
    named = fx.star.companies.select("company_id", F.col("name").alias("company"))
    dated, named = joins.fresh_key(dated, "patent_id"), joins.fresh_key(named, "company_id")
    return fx.star.relationships().join(dated, "patent_id").join(named, "company_id")


@check(
    "patents_full_detail",
    """SELECT patent_id, title, year, inventor_name, inventor_country, company_name
       FROM patents LEFT JOIN detail USING (patent_id)""",
)
def _(fx: Fixtures):
    return reports.patents_full_detail(fx.star)


@check(
    "detail_in_buckets",
    """SELECT patent_id, title, year, inventor_name, inventor_country, company_name
       FROM patents LEFT JOIN detail USING (patent_id)""",
)
def _(fx: Fixtures):
    stored = build_star(fx.spark, fx, fx.scratch("star"), relationships=False)
    return reports.patents_full_detail(buckets.bucket_star(stored, fx.scratch("buckets")))


@check("scalar_total", "SELECT country, patent_count, (SELECT count(*) FROM patents) AS total FROM country_counts")
def _(fx: Fixtures):
    total = counting.count_rows(fx.star.patents, "n").scalar()
    return reports.country_counts(fx.star, ()).withColumn("total", total)


# Aggregations


@check("count_patents", "SELECT count(*) AS n FROM patents")
def _(fx: Fixtures):
    return counting.count_rows(fx.star.patents, "n")


@check("count_inventors", "SELECT count(*) AS n FROM inventors")
def _(fx: Fixtures):
    return counting.count_rows(fx.star.inventors, "n")


@check("count_companies", "SELECT count(*) AS n FROM companies")
def _(fx: Fixtures):
    return counting.count_rows(fx.star.companies, "n")


@check("year_min_max", "SELECT min(year) AS first_year, max(year) AS last_year FROM patents WHERE year IS NOT NULL")
def _(fx: Fixtures):
    return counting.year_min_max(fx.star.patents)


@check("patents_per_year", "SELECT year, patent_count FROM yearly WHERE year BETWEEN 1976 AND 2025")
def _(fx: Fixtures):
    return counting.patents_per_year(fx.star.patents, 1976, 2025)


@check(
    "distinct_patents_by_inventor",
    """SELECT inventor_id, count(DISTINCT patent_id) AS patent_count FROM relationships
       WHERE inventor_id IS NOT NULL GROUP BY inventor_id""",
)
def _(fx: Fixtures):
    return counting.distinct_patents_by(fx.star.relationships(), "inventor_id")


@check("distinct_patents_by_company", "SELECT company_id, patent_count FROM company_counts")
def _(fx: Fixtures):
    known = fx.star.companies.select("company_id")
    return counting.count_pairs_by(fx.star.patent_company, "company_id").join(known, "company_id", "left_semi")


@check("distinct_patents_by_country", "SELECT country, patent_count FROM country_counts")
def _(fx: Fixtures):
    return reports.country_counts(fx.star, ())


_YEAR_COMPANY = "SELECT * FROM company_years"


@check("distinct_patents_by_year_company_name", _YEAR_COMPANY)
def _(fx: Fixtures):
    return reports.company_counts_by_year(fx.star)


@check(
    "dedupe_by_key",
    """SELECT inventor_id, patent_id, location_id FROM (
         SELECT *, row_number() OVER (PARTITION BY inventor_id ORDER BY patent_id NULLS LAST, location_id NULLS LAST) AS n
         FROM (SELECT DISTINCT inventor_id, patent_id, location_id FROM raw_inventor)) WHERE n = 1""",
)
def _(fx: Fixtures):
    return dedupe.keep_first(fx.raw_inventor.select("inventor_id", "patent_id", "location_id"), "inventor_id")


@check("distinct_pairs", "SELECT DISTINCT patent_id, assignee_id FROM raw_assignee WHERE assignee_id IS NOT NULL")
def _(fx: Fixtures):
    return dedupe.distinct_pairs(fx.raw_assignee, "patent_id", "assignee_id")


@check("partial_then_final_distinct", "SELECT DISTINCT patent_id, inventor_id FROM raw_inventor WHERE inventor_id IS NOT NULL")
def _(fx: Fixtures):
    return dedupe.distinct_pairs(fx.raw_inventor, "patent_id", "inventor_id")


@check(
    "pct_share_of_total",
    """SELECT country, patent_count,
              round(CAST(patent_count AS DOUBLE) * 100 / (SELECT count(*) FROM patents), 2) AS pct_share
       FROM country_counts""",
)
def _(fx: Fixtures):
    total = counting.count_rows(fx.star.patents, "total")
    return counting.with_share(reports.country_counts(fx.star, ()), total, "pct_share")


@check(
    "share_of_displayed",
    """SELECT country, patent_count, round(CAST(patent_count AS DOUBLE) * 100 / sum(patent_count) OVER (), 1) AS share
       FROM (FROM country_counts ORDER BY patent_count DESC, country LIMIT 12)""",
)
def _(fx: Fixtures):
    top = ranking.top_k(reports.country_counts(fx.star, ()), 12, "patent_count", "country")
    shown = top.agg(F.sum("patent_count")).scalar()
    return top.withColumn("share", share(F.col("patent_count"), shown, 1))


@check(
    "rows_dropped",
    """SELECT count(*) AS rows_before, count(d) AS rows_after, count(*) - count(d) AS rows_dropped
       FROM (SELECT TRY_CAST(patent_date AS DATE) AS d FROM raw_patent WHERE patent_id IS NOT NULL)""",
)
def _(fx: Fixtures):
    dated = fx.raw_patent.select("patent_id", clean.parse_date(F.col("patent_date")).alias("filing_date"))
    return counting.rows_dropped(dated, "patent_id", "filing_date")


@check(
    "max_scaled_bar",
    """SELECT year, CAST(trunc(CAST(patent_count AS DOUBLE) / (SELECT max(patent_count) FROM yearly) * 30) AS INTEGER)
              AS bar_len FROM yearly""",
)
def _(fx: Fixtures):
    trend = counting.patents_per_year(fx.star.patents, 1976, 2025)
    largest = trend.agg(F.max("patent_count")).scalar()
    return trend.select("year", scaled_bar_length(F.col("patent_count"), largest).alias("bar_len"))


@check(
    "search_hit_count",
    """SELECT least(count(*), 100) AS hits FROM patents
       WHERE lower(title) LIKE '%the%' AND year BETWEEN 2010 AND 2024""",
)
def _(fx: Fixtures):
    return datasets.search_hit_count(datasets.search_patents(fx.star, "the"))


# Windows


@check(
    "rank_companies_in_year",
    f"""SELECT year, company, patent_count, rank() OVER w AS yearly_rank, dense_rank() OVER w AS yearly_dense_rank
        FROM ({_YEAR_COMPANY}) WINDOW w AS (PARTITION BY year ORDER BY patent_count DESC)""",
)
def _(fx: Fixtures):
    counts = reports.company_counts_by_year(fx.star)
    return ranking.rank_by_counts(
        counts, "patent_count", ["year"], rank="yearly_rank", dense="yearly_dense_rank"
    )


@check(
    "rank_inventors",
    "SELECT inventor_id, patent_count, rank() OVER (ORDER BY patent_count DESC) AS rank FROM inventor_counts",
)
def _(fx: Fixtures):
    return reports.rank_all_inventors(fx.star).select("inventor_id", "patent_count", "rank")


@check(
    "dense_rank_inventors",
    "SELECT inventor_id, dense_rank() OVER (ORDER BY patent_count DESC) AS dense_rank FROM inventor_counts",
)
def _(fx: Fixtures):
    return reports.rank_all_inventors(fx.star).select("inventor_id", "dense_rank")


@check(
    "pct_of_total",
    """SELECT inventor_id, round(CAST(patent_count AS DOUBLE) * 100 / sum(patent_count) OVER (), 4) AS pct_of_total
       FROM inventor_counts""",
)
def _(fx: Fixtures):
    return reports.rank_all_inventors(fx.star).select("inventor_id", "pct_of_total")


@check(
    "positional_rank",
    """SELECT CAST(row_number() OVER (ORDER BY patent_count DESC, company_id) AS INTEGER) AS rank, company_id,
              patent_count FROM (FROM company_counts ORDER BY patent_count DESC, company_id LIMIT 10)""",
)
def _(fx: Fixtures):
    star = fx.star
    top = reports.top_entities(star.patent_company, star.companies, "company_id", 10, star.resolved)
    placed = ranking.with_position(top, F.desc("patent_count"), "company_id")
    return placed.select("rank", "company_id", "patent_count")


# Sorts and limits


def _top_inventor_ids(limit: int) -> str:
    return f"SELECT inventor_id, patent_count FROM inventor_counts ORDER BY patent_count DESC, inventor_id LIMIT {limit}"


@check("top_k", _top_inventor_ids(20))
def _(fx: Fixtures):
    return ranking.top_k(reports.inventor_counts(fx.star), 20, "patent_count", "inventor_id")


@check("top_n_param", _top_inventor_ids(50))
def _(fx: Fixtures):
    n = ranking.checked_size(50, datasets.LEAST_ROWS, datasets.MOST_ROWS)
    return ranking.top_k(reports.inventor_counts(fx.star), n, "patent_count", "inventor_id")


@check("limit_unordered", "SELECT patent_id, title, year FROM patents WHERE year >= 2000 ORDER BY patent_id LIMIT 500")
def _(fx: Fixtures):
    return ranking.head_n(fx.star.patents.where("year >= 2000").select("patent_id", "title", "year"), 500, "patent_id")


@check("order_by_year", "SELECT year, patent_count FROM yearly ORDER BY year")
def _(fx: Fixtures):
    return reports.yearly_trend(fx.star)


@check("order_mixed", f"SELECT year, company, patent_count FROM ({_YEAR_COMPANY}) ORDER BY year DESC, patent_count DESC, company")
def _(fx: Fixtures):
    return reports.company_counts_by_year(fx.star).orderBy(F.desc("year"), F.desc("patent_count"), "company")


@check(
    "top_k_per_group",
    f"""SELECT year, company, patent_count, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, rank() OVER (PARTITION BY year ORDER BY patent_count DESC) AS rank FROM ({_YEAR_COMPANY}))
        WHERE rank <= 5""",
)
def _(fx: Fixtures):
    return ranking.top_k_per_group(reports.company_counts_by_year(fx.star), 5, "year", "patent_count")


@check("head_n", _top_inventor_ids(10))
def _(fx: Fixtures):
    return ranking.head_n(reports.inventor_counts(fx.star), 10, F.desc("patent_count"), "inventor_id")


@check("tail_n", "SELECT year, patent_count FROM yearly ORDER BY year DESC LIMIT 10")
def _(fx: Fixtures):
    return ranking.tail_n(counting.patents_per_year(fx.star.patents, 1976, 2025), 10, "year")


@check("resort_ascending", f"SELECT * FROM ({_top_inventor_ids(15)}) ORDER BY patent_count, inventor_id")
def _(fx: Fixtures):
    top = ranking.top_k(reports.inventor_counts(fx.star), 15, "patent_count", "inventor_id")
    return top.orderBy("patent_count", "inventor_id")


@check("search_order_limit", "SELECT patent_id, year FROM patents ORDER BY year DESC, patent_id LIMIT 100")
def _(fx: Fixtures):
    return ranking.head_n(fx.star.patents.select("patent_id", "year"), 100, F.desc("year"), "patent_id")


# SQL features
#
# A computed key gives a join an exchange of its own, which can be split at a hot key.


def _query(fx: Fixtures, text: str, args=None):
    star = fx.star
    tables = {
        "patents": star.patents,
        "inventors": star.inventors,
        "companies": star.companies,
        "patent_inventor": star.patent_inventor,
        "patent_company": star.patent_company,
    }
    return read_table_query(fx.spark, text, {k: v for k, v in tables.items() if f"{{{k}}}" in text}, args)


@check(
    "sql_cte_chain",
    f"""SELECT year, company, patent_count, CAST(yearly_rank AS INTEGER) AS yearly_rank FROM (
          SELECT *, rank() OVER (PARTITION BY year ORDER BY patent_count DESC) AS yearly_rank FROM ({_YEAR_COMPANY}))
        WHERE yearly_rank <= 5""",
)
def _(fx: Fixtures):
    text = """
        WITH named AS (
            SELECT concat(patent_id, '') AS patent_id, name AS company
            FROM (SELECT patent_id, concat(company_id, '') AS company_id FROM {patent_company})
            JOIN (SELECT concat(company_id, '') AS company_id, name FROM {companies}) USING (company_id)),
        counted AS (
            SELECT year, company, count(DISTINCT patent_id) AS patent_count
            FROM named JOIN (SELECT concat(patent_id, '') AS patent_id, year FROM {patents}) USING (patent_id)
            WHERE year BETWEEN :first AND :last
            GROUP BY ALL),
        placed AS (
            SELECT counted.*, rank() OVER (PARTITION BY year ORDER BY patent_count DESC) AS yearly_rank FROM counted)
        SELECT * FROM placed WHERE yearly_rank <= :k"""
    return _query(fx, text, {"first": 2015, "last": 2024, "k": 5})


@check(
    "sql_derived_table",
    "SELECT patent_count, count(*) AS inventors FROM inventor_counts GROUP BY patent_count",
)
def _(fx: Fixtures):
    # Pairs are counted before inventors are looked up, one row each.
    text = """
        SELECT patent_count, count(*) AS inventors
        FROM (SELECT inventor_id, count(DISTINCT patent_id) AS patent_count
              FROM {patent_inventor} GROUP BY inventor_id) per_inventor
        LEFT SEMI JOIN {inventors} USING (inventor_id)
        GROUP BY patent_count"""
    return _query(fx, text)


@check(
    "sql_scalar_subquery",
    """SELECT country, round(CAST(patent_count AS DOUBLE) * 100 / (SELECT count(*) FROM patents), 2) AS pct_share
       FROM country_counts WHERE country NOT IN ('Unknown', '')""",
)
def _(fx: Fixtures):
    text = """
        SELECT country,
               round(try_divide(count(DISTINCT patent_id) * 100.0D, (SELECT count(*) FROM {patents})), 2) AS pct_share
        FROM {patent_inventor} JOIN (SELECT concat(inventor_id, '') AS inventor_id, country FROM {inventors}) USING (inventor_id)
        WHERE country NOT IN (:unknown, '')
        GROUP BY country"""
    return _query(fx, text, {"unknown": UNKNOWN})


@check("sql_names_after_grouping", "SELECT name AS inventor, country, patent_count FROM inventor_counts")
def _(fx: Fixtures):
    text = """
        WITH counts AS (
            SELECT inventor_id, count(DISTINCT patent_id) AS patent_count FROM {patent_inventor} GROUP BY inventor_id)
        SELECT name AS inventor, country, patent_count FROM counts JOIN {inventors} USING (inventor_id)"""
    return _query(fx, text)


@check(
    "sql_order_by_alias",
    """SELECT country, patent_count FROM country_counts
       WHERE country NOT IN ('Unknown', '', 'XX') ORDER BY patent_count DESC, country LIMIT 20""",
)
def _(fx: Fixtures):
    text = """
        SELECT country, count(DISTINCT patent_id) AS patent_count
        FROM {patent_inventor} JOIN (SELECT concat(inventor_id, '') AS inventor_id, country FROM {inventors}) USING (inventor_id)
        WHERE country NOT IN ('Unknown', '', 'XX')
        GROUP BY country ORDER BY patent_count DESC, country LIMIT 20"""
    return _query(fx, text)


@check(
    "sql_bind_parameters",
    """SELECT patent_id, title, year FROM patents WHERE title LIKE '%the%' AND year BETWEEN 2010 AND 2024""",
)
def _(fx: Fixtures):
    text = "SELECT patent_id, title, year FROM {patents} WHERE title LIKE ? AND year BETWEEN ? AND ?"
    return _query(fx, text, ["%the%", 2010, 2024])


@check(
    "sql_checked_limit",
    """SELECT company_id, patent_count FROM company_counts ORDER BY patent_count DESC, company_id LIMIT 15""",
)
def _(fx: Fixtures):
    text = """
        WITH counts AS (
            SELECT company_id, count(DISTINCT patent_id) AS patent_count FROM {patent_company} GROUP BY company_id)
        SELECT company_id, patent_count FROM counts LEFT SEMI JOIN {companies} USING (company_id)
        ORDER BY patent_count DESC, company_id LIMIT :n"""
    return _query(fx, text, {"n": ranking.checked_size(15, datasets.LEAST_ROWS, datasets.MOST_ROWS)})


# Integrity


@check(
    "check_unique_key",
    "SELECT inventor_id, count(*) AS row_count FROM raw_inventor GROUP BY inventor_id HAVING count(*) > 1",
)
def _(fx: Fixtures):
    return integrity.check_unique_key(fx.raw_inventor, "inventor_id")


@check("check_not_null", "SELECT assignee_id FROM raw_assignee WHERE disambig_assignee_organization IS NULL")
def _(fx: Fixtures):
    return integrity.check_not_null(fx.raw_assignee, "assignee_id", "disambig_assignee_organization")


@check(
    "check_foreign_keys",
    """SELECT 'patent_id' AS foreign_key, patent_id AS missing_id, count(*) AS row_count FROM clean_relationships
       WHERE patent_id NOT IN (SELECT patent_id FROM patents) GROUP BY patent_id
       UNION ALL SELECT 'inventor_id', inventor_id, count(*) FROM clean_relationships
       WHERE inventor_id IS NOT NULL AND inventor_id NOT IN (SELECT inventor_id FROM inventors) GROUP BY inventor_id
       UNION ALL SELECT 'company_id', company_id, count(*) FROM clean_relationships
       WHERE company_id IS NOT NULL AND company_id NOT IN (SELECT company_id FROM companies) GROUP BY company_id""",
)
def _(fx: Fixtures):
    star = fx.star
    dimensions = {"patent_id": star.patents, "inventor_id": star.inventors, "company_id": star.companies}
    return integrity.check_foreign_keys(fx.clean_relationships, dimensions)


@check("repair_foreign_keys", "SELECT patent_id, inventor_id, company_id FROM relationships")
def _(fx: Fixtures):
    star = fx.star
    return integrity.repair_foreign_keys(fx.clean_relationships, star.patents, star.inventors, star.companies)


@check(
    "align_target",
    """SELECT patent_id, title, CAST(NULL AS VARCHAR) AS abstract, filing_date, year, patent_type, wipo_kind
       FROM patents""",
)
def _(fx: Fixtures):
    copied = fx.star.patents.drop("abstract").withColumn("title.1", F.col("title"))
    return columns.align_to_schema(columns.drop_artifact_columns(copied), schemas.PATENTS)


@check(
    "surrogate_id",
    """SELECT row_number() OVER (ORDER BY patent_id, inventor_id, company_id) AS id, patent_id, inventor_id, company_id
       FROM (SELECT DISTINCT r.patent_id, r.inventor_id, a.assignee_id AS company_id
             FROM raw_inventor r JOIN raw_assignee a ON r.patent_id = a.patent_id
             WHERE r.inventor_id IS NOT NULL AND a.assignee_id IS NOT NULL)""",
)
def _(fx: Fixtures):
    inventors = fx.raw_inventor.select("patent_id", "inventor_id")
    companies = fx.raw_assignee.select("patent_id", F.col("assignee_id").alias("company_id"))
    pairs = dedupe.distinct_pairs(inventors.join(companies, "patent_id"), "patent_id", "inventor_id", "company_id")
    return integrity.surrogate_id(pairs, "patent_id", "inventor_id", "company_id")
