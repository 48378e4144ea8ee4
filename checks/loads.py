"""Loads: their reports, rejected rows, replacement and added batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import Fixtures
from checks.oracle import strip
from checks.registry import check
from grantmill.plans import load, reports
from grantmill.plans.star import RawTables

_TYPED = f"""SELECT patent_id, {strip("patent_title")} AS title, coalesce({strip("patent_abstract")}, '') AS abstract,
    TRY_CAST({strip("patent_date")} AS DATE) AS filing_date, lower({strip("coalesce(patent_type, '')")}) AS patent_type, wipo_kind
    FROM raw_messy"""
_ROUTED = f"""SELECT *, CASE WHEN reason IS NULL AND n > 1 THEN 'repeated' ELSE coalesce(reason, 'kept') END AS outcome FROM (
    SELECT *, row_number() OVER (PARTITION BY patent_id, reason IS NULL
                                 ORDER BY filing_date, patent_type, wipo_kind, title, abstract) AS n FROM (
      SELECT *, CASE WHEN patent_id IS NULL THEN 'no_id' WHEN filing_date IS NULL THEN 'no_date'
                     WHEN patent_type NOT IN ('utility', 'reissue', '') THEN 'other_type'
                     WHEN title IS NULL THEN 'untitled' END AS reason FROM ({_TYPED})))"""


def _pairs(table: str, key: str, entities: str) -> str:
    """Outcomes of the pairs of the messy patents."""
    return f"""SELECT outcome, sum(row_count) AS row_count FROM (
        SELECT unnest([CASE WHEN p IS NULL OR e IS NULL THEN 'no_id' WHEN p NOT IN (SELECT patent_id FROM routed WHERE outcome = 'kept')
                                 THEN 'unknown_patent' WHEN e IN (SELECT {entities}_id FROM {"inventors" if entities == "inventor" else "companies"})
                                 THEN 'kept' ELSE 'orphaned' END,
                       CASE WHEN p IN (SELECT patent_id FROM routed WHERE outcome = 'kept') AND e IS NOT NULL THEN 'repeated' END]) AS outcome,
               unnest([CASE WHEN p IN (SELECT patent_id FROM routed WHERE outcome = 'kept') AND e IS NOT NULL THEN 1 ELSE n END, n - 1]) AS row_count
        FROM (SELECT patent_id AS p, {key} AS e, count(*) AS n FROM {table} GROUP BY ALL))
      WHERE outcome IS NOT NULL GROUP BY outcome"""


@check(
    "load_report",
    f""", routed AS ({_ROUTED})
       SELECT 'patents' AS "table", outcome, count(*) AS row_count FROM routed GROUP BY outcome
       UNION ALL SELECT 'patent_inventor', outcome, CAST(row_count AS BIGINT)
         FROM ({_pairs("raw_inventor", "inventor_id", "inventor")}) WHERE row_count > 0
       UNION ALL SELECT 'patent_company', outcome, CAST(row_count AS BIGINT)
         FROM ({_pairs("raw_assignee", "assignee_id", "company")}) WHERE row_count > 0""",
)
def _(fx: Fixtures):
    raw = RawTables(fx.raw("raw_messy"), fx.raw_inventor, fx.raw_assignee, fx.raw_location)
    loaded = load.replace_star(fx.spark, raw, fx.scratch("star"))
    return loaded.load_report.where("row_count > 0 AND table <> 'relationships'")


@check(
    "rejected_patents",
    f"""SELECT patent_id, title, filing_date, patent_type, outcome AS reason FROM ({_ROUTED}) WHERE outcome <> 'kept'""",
)
def _(fx: Fixtures):
    raw = RawTables(fx.raw("raw_messy"), fx.raw_inventor, fx.raw_assignee, fx.raw_location)
    loaded = load.replace_star(fx.spark, raw, fx.scratch("star"))
    return loaded.rejected("patents").select("patent_id", "title", "filing_date", "patent_type", "reason")


@check("replace_star", "SELECT patent_id, inventor_id, company_id FROM relationships")
def _(fx: Fixtures):
    root = fx.scratch("star")
    load.replace_star(fx.spark, fx.batch("% 2 = 0"), root)
    load.replace_star(fx.spark, fx, root)
    load.drop_old_loads(fx.spark, root)
    return load.VersionedStar(fx.spark, root).relationships()


def _in_batches(fx: Fixtures) -> load.VersionedStar:
    """Half of the patents, the other half, and the second half again."""
    root = fx.scratch("star")
    load.replace_star(fx.spark, fx.batch("% 2 = 0"), root)
    load.add_to_star(fx.spark, fx.batch("% 2 = 1"), root)
    return load.add_to_star(fx.spark, fx.batch("% 2 = 1"), root)


@check(
    "merge_batches",
    """SELECT patent_id, inventor_id, company_id, count(*) OVER () AS ids, CAST(1 AS BIGINT) AS first_id,
              count(*) OVER () AS last_id FROM relationships""",
)
def _(fx: Fixtures):
    rows = _in_batches(fx).numbered_relationships
    ids = rows.agg(F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return rows.drop("id").join(F.broadcast(ids), how="cross")


@check("merged_yearly_trend", "SELECT year, patent_count FROM yearly WHERE year BETWEEN 1976 AND 2025")
def _(fx: Fixtures):
    return reports.yearly_trend(_in_batches(fx))


@check("merged_company_years", "SELECT year, company, patent_count FROM company_years")
def _(fx: Fixtures):
    return reports.company_counts_by_year(_in_batches(fx))
