"""The results a user sees: cleaned tables, reports, charts and dashboard datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import Fixtures
from checks.oracle import ascii_like, country, strip
from checks.registry import check
from grantmill.plans import clean, datasets, raw, reports, search, star
from grantmill.sources.readers import scan_raw_table
from grantmill.sources.writers import write_raw

_TOP_INVENTORS = "SELECT * FROM inventor_counts ORDER BY patent_count DESC, inventor_id LIMIT {}"
_TOP_COMPANIES = "SELECT * FROM company_counts ORDER BY patent_count DESC, company_id LIMIT {}"
_SHARE = "round(CAST(patent_count AS DOUBLE) * 100 / (SELECT count(*) FROM patents), 2)"


def _top_countries(limit: int, excluded: str = "'Unknown', ''") -> str:
    return f"""SELECT country, patent_count, {_SHARE} AS pct_share FROM country_counts
               WHERE country NOT IN ({excluded}) ORDER BY patent_count DESC, country LIMIT {limit}"""


@check("clean_patents", "SELECT * FROM clean_patents")
def _(fx: Fixtures):
    return clean.clean_patents(fx.raw_patent)


@check("clean_locations", "SELECT * FROM clean_locations")
def _(fx: Fixtures):
    return clean.clean_locations(fx.raw_location)


@check("clean_inventors", "SELECT * FROM inventors")
def _(fx: Fixtures):
    return clean.clean_inventors(fx.raw_inventor, fx.clean_locations)


@check("clean_companies", "SELECT * FROM companies")
def _(fx: Fixtures):
    return clean.clean_companies(fx.raw_assignee, fx.clean_locations)


# First rows in file order, for ids with many spellings

_PLACE = "place_1, place_2, place_3, place_4"
_FIRST_LOCATION = f"""SELECT location_id, country_from_location FROM (
    SELECT location_id, {country("disambig_country")} AS country_from_location,
           row_number() OVER (PARTITION BY location_id ORDER BY {_PLACE}) AS n FROM raw_spelling) WHERE n = 1"""
_SPELLED_NAME = (
    strip(f"coalesce({strip('disambig_inventor_name_first')}, '') || ' ' || coalesce({strip('disambig_inventor_name_last')}, '')")
)


def _spellings(fx: Fixtures, *columns: str):
    return scan_raw_table(fx.spark, fx.spelling_file(*columns), columns, ordinal="place")


@check("first_row_of_locations", _FIRST_LOCATION)
def _(fx: Fixtures):
    return clean.clean_locations(_spellings(fx, "location_id", "disambig_country"), order=["place"])


@check(
    "first_row_of_inventors",
    f"""SELECT inventor_id, name, CASE WHEN inventor_country IS NOT NULL THEN {country("inventor_country")}
                                  ELSE coalesce(country_from_location, 'Unknown') END AS country
        FROM (SELECT *, row_number() OVER (PARTITION BY inventor_id ORDER BY {_PLACE}) AS n
              FROM (SELECT *, {_SPELLED_NAME} AS name FROM raw_spelling) WHERE length(name) > 1)
        LEFT JOIN ({_FIRST_LOCATION}) USING (location_id) WHERE n = 1""",
)
def _(fx: Fixtures):
    locations = clean.clean_locations(_spellings(fx, "location_id", "disambig_country"), order=["place"])
    rows = _spellings(fx, "patent_id", "inventor_id", "disambig_inventor_name_first", "disambig_inventor_name_last",
                      "inventor_country", "location_id")
    return clean.clean_inventors(rows, locations, order=["place"])


@check(
    "first_row_of_companies",
    f"""SELECT assignee_id AS company_id, {strip("disambig_assignee_organization")} AS name,
               CASE WHEN assignee_country IS NOT NULL THEN {country("assignee_country")} ELSE 'Unknown' END AS country
        FROM (SELECT *, row_number() OVER (PARTITION BY assignee_id ORDER BY {_PLACE}) AS n
              FROM raw_spelling WHERE disambig_assignee_organization IS NOT NULL)
        WHERE n = 1 AND length({strip("disambig_assignee_organization")}) > 1""",
)
def _(fx: Fixtures):
    rows = _spellings(fx, "patent_id", "assignee_id", "disambig_assignee_organization", "assignee_country")
    return clean.clean_companies(rows, None, order=["place"])


@check(
    "open_raw_folder",
    """SELECT name AS inventor, country, patent_count FROM inventor_counts
       ORDER BY patent_count DESC, inventor_id LIMIT 20""",
)
def _(fx: Fixtures):
    folder = fx.scratch("raw")
    for name, rows in {
        raw.PATENT_FILE: fx.raw_patent,
        raw.INVENTOR_FILE: fx.raw_inventor,
        raw.ASSIGNEE_FILE: fx.raw_assignee,
        raw.LOCATION_FILE: fx.raw_location,
    }.items():
        write_raw(rows, f"{folder}/{name}")
    return reports.top_inventors(star.RawStar(raw.open_raw(fx.spark, folder, landed=fx.scratch("landed"))))


@check("clean_patent_inventor", "SELECT * FROM clean_patent_inventor")
def _(fx: Fixtures):
    return clean.clean_patent_inventor(fx.raw_inventor, fx.clean_patents)


@check("clean_patent_company", "SELECT * FROM clean_patent_company")
def _(fx: Fixtures):
    return clean.clean_patent_company(fx.raw_assignee, fx.clean_patents)


@check("clean_relationships", "SELECT * FROM clean_relationships")
def _(fx: Fixtures):
    return clean.clean_relationships(fx.clean_patent_inventor, fx.clean_patent_company)


@check(
    "load_relationships",
    """SELECT row_number() OVER (ORDER BY patent_id, inventor_id NULLS FIRST, company_id NULLS FIRST) AS id,
              patent_id, inventor_id, company_id FROM relationships""",
)
def _(fx: Fixtures):
    s = fx.star
    return star.load_relationships(
        fx.clean_patent_inventor, fx.clean_patent_company, s.inventors, s.companies, s.patents
    )


@check("build_star", "SELECT * FROM patents")
def _(fx: Fixtures):
    stored = star.build_star(fx.spark, fx, fx.scratch("star"))
    return stored.patents


@check(
    "q1_top_inventors",
    f"SELECT name AS inventor, country, patent_count FROM ({_TOP_INVENTORS.format(20)})",
)
def _(fx: Fixtures):
    return reports.top_inventors(fx.star)


@check("q2_top_companies", f"SELECT name AS company, country, patent_count FROM ({_TOP_COMPANIES.format(20)})")
def _(fx: Fixtures):
    return reports.top_companies(fx.star)


@check("q3_top_countries", _top_countries(20))
def _(fx: Fixtures):
    return reports.top_countries(fx.star)


@check("q4_patents_per_year", "SELECT year, patent_count FROM yearly WHERE year BETWEEN 1976 AND 2025 ORDER BY year")
def _(fx: Fixtures):
    return reports.yearly_trend(fx.star)


@check(
    "q5_patent_detail",
    """SELECT patent_id, title, year, inventor_name, inventor_country, company_name
       FROM patents LEFT JOIN detail USING (patent_id) WHERE year >= 2000
       ORDER BY patent_id, inventor_id NULLS FIRST, company_id NULLS FIRST LIMIT 500""",
)
def _(fx: Fixtures):
    return reports.patent_detail(fx.star)


@check(
    "q6_top_companies_per_year",
    """SELECT year, CAST(rank() OVER (PARTITION BY year ORDER BY patent_count DESC) AS INTEGER) AS yearly_rank,
              company, patent_count
       FROM company_years QUALIFY yearly_rank <= 5 ORDER BY year DESC, yearly_rank, company""",
)
def _(fx: Fixtures):
    return reports.top_companies_per_year(fx.star)


@check(
    "q7_inventor_ranking",
    """SELECT CAST(rank() OVER (ORDER BY patent_count DESC) AS INTEGER) AS rank,
              CAST(dense_rank() OVER (ORDER BY patent_count DESC) AS INTEGER) AS dense_rank,
              name AS inventor, country, patent_count,
              round(CAST(patent_count AS DOUBLE) * 100 / sum(patent_count) OVER (), 4) AS pct_of_total
       FROM inventor_counts ORDER BY patent_count DESC, inventor_id LIMIT 50""",
)
def _(fx: Fixtures):
    return reports.inventor_ranking(fx.star)


@check(
    "report_header",
    "SELECT count(*) AS total_patents, min(year) AS first_year, max(year) AS last_year FROM patents",
)
def _(fx: Fixtures):
    return reports.report_header(fx.star)


@check(
    "report_top10",
    f"""SELECT 'inventors' AS section, row_number() OVER (ORDER BY patent_count DESC, inventor_id) AS rank, name, country,
               patent_count AS patents, CAST(NULL AS DOUBLE) AS share FROM ({_TOP_INVENTORS.format(10)})
        UNION ALL
        SELECT 'companies', row_number() OVER (ORDER BY patent_count DESC, company_id), name, country, patent_count, NULL
        FROM ({_TOP_COMPANIES.format(10)})
        UNION ALL
        SELECT 'countries', row_number() OVER (ORDER BY patent_count DESC, country), country, country, patent_count,
               pct_share FROM ({_top_countries(10)})""",
)
def _(fx: Fixtures):
    return reports.report_top10(fx.star)


@check(
    "report_trend_bars",
    """SELECT year, bar_len, repeat('█', bar_len) AS bar, patent_count FROM (
         SELECT year, patent_count,
                CAST(trunc(CAST(patent_count AS DOUBLE) / max(patent_count) OVER () * 30) AS INTEGER) AS bar_len
         FROM (FROM yearly WHERE year BETWEEN 1976 AND 2025 ORDER BY year DESC LIMIT 10)) ORDER BY year""",
)
def _(fx: Fixtures):
    return reports.report_trend_bars(fx.star)


@check(
    "report_json",
    f"""SELECT CAST(to_json({{
          total_patents: (SELECT count(*) FROM patents),
          top_inventors: (SELECT list({{rank: rank, name: name, country: country, patents: patent_count}} ORDER BY rank)
            FROM (SELECT *, row_number() OVER (ORDER BY patent_count DESC, inventor_id) AS rank
                  FROM ({_TOP_INVENTORS.format(10)}))),
          top_companies: (SELECT list({{rank: rank, name: name, country: country, patents: patent_count}} ORDER BY rank)
            FROM (SELECT *, row_number() OVER (ORDER BY patent_count DESC, company_id) AS rank
                  FROM ({_TOP_COMPANIES.format(10)}))),
          top_countries: (SELECT list({{country: country, patents: patent_count, share: pct_share}}
                                      ORDER BY patent_count DESC, country) FROM ({_top_countries(10)})),
          yearly_trend: (SELECT list({{year: year, patents: patent_count}} ORDER BY year) FROM yearly
                         WHERE year BETWEEN 1976 AND 2025)}}) AS VARCHAR) AS report""",
)
def _(fx: Fixtures):
    report = reports.report_json(fx.star)
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


@check("chart_yearly_trend", "SELECT year, patent_count AS cnt FROM yearly WHERE year BETWEEN 1980 AND 2024 ORDER BY year")
def _(fx: Fixtures):
    return datasets.chart_yearly_trend(fx.star)


@check(
    "chart_top_companies",
    f"SELECT name AS company, patent_count AS cnt FROM ({_TOP_COMPANIES.format(15)}) ORDER BY cnt, company_id",
)
def _(fx: Fixtures):
    return datasets.chart_top_companies(fx.star)


@check(
    "chart_country_share",
    f"""SELECT country, patent_count AS cnt,
               round(CAST(patent_count AS DOUBLE) * 100 / sum(patent_count) OVER (), 1) AS share
        FROM ({_top_countries(12, "'Unknown', '', 'XX'")}) ORDER BY cnt DESC, country""",
)
def _(fx: Fixtures):
    return datasets.chart_country_share(fx.star)


@check(
    "chart_top_inventors",
    f"""SELECT name || '  [' || country || ']' AS label, patent_count AS cnt FROM ({_TOP_INVENTORS.format(15)})
        ORDER BY cnt, inventor_id""",
)
def _(fx: Fixtures):
    return datasets.chart_top_inventors(fx.star)


@check(
    "dash_kpis",
    """SELECT (SELECT count(*) FROM patents) AS total_patents, (SELECT count(*) FROM inventors) AS unique_inventors,
              (SELECT count(*) FROM companies) AS companies, min(year) AS y1, max(year) AS y2 FROM patents""",
)
def _(fx: Fixtures):
    return datasets.dash_kpis(fx.star)


@check("dash_trend", "SELECT year, patent_count FROM yearly WHERE year BETWEEN 1976 AND 2024 ORDER BY year")
def _(fx: Fixtures):
    return datasets.dash_trend(fx.star)


@check(
    "dash_recent_decade",
    """SELECT year, patent_count FROM yearly WHERE year <= 2024
         AND year >= (SELECT max(year) FROM yearly WHERE year BETWEEN 1976 AND 2024) - 10 ORDER BY year""",
)
def _(fx: Fixtures):
    return datasets.dash_recent_decade(fx.star)


@check("dash_top_inventors", f"SELECT name AS inventor, country, patent_count FROM ({_TOP_INVENTORS.format(15)})")
def _(fx: Fixtures):
    return datasets.dash_top_inventors(fx.star)


@check("dash_top_companies", f"SELECT name AS company, country, patent_count FROM ({_TOP_COMPANIES.format(15)})")
def _(fx: Fixtures):
    return datasets.dash_top_companies(fx.star)


@check(
    "dash_countries",
    f"""SELECT country, patent_count, pct_share AS pct FROM ({_top_countries(20, "'Unknown', '', 'XX'")})""",
)
def _(fx: Fixtures):
    return datasets.dash_countries(fx.star)


@check(
    "search_patents",
    f"""SELECT patent_id, title, year, abstract FROM patents
        WHERE {ascii_like("title", "%Tion%")} AND year BETWEEN 2010 AND 2024 ORDER BY year DESC, patent_id LIMIT 100""",
)
def _(fx: Fixtures):
    return datasets.search_patents(fx.star, "Tion")


@check(
    "search_patents_indexed",
    f"""SELECT patent_id, title, year, abstract FROM patents
        WHERE {ascii_like("title", "%specified%")} AND year BETWEEN 2010 AND 2024 ORDER BY year DESC, patent_id LIMIT 100""",
)
def _(fx: Fixtures):
    index = search.build_title_index(fx.star, fx.scratch("title_index"))
    return search.search_indexed(fx.star, index, "Specified")
