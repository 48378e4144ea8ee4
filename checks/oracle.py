"""Common table expressions of the SQL oracle: the cleaning rules written a second time."""

from __future__ import annotations

from checks.fixtures import RAW_TABLES

# Fixed values, a second time so that a wrong one shows: characters that are stripped, and
# the names of the codes in the raw tables.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
COUNTRY_NAMES = {
    "AT": "Austria", "AU": "Australia", "BE": "Belgium", "BR": "Brazil", "CA": "Canada", "CH": "Switzerland",
    "CN": "China", "CZ": "Czechia", "DE": "Germany", "DK": "Denmark", "ES": "Spain", "FI": "Finland", "FR": "France",
    "GB": "United Kingdom", "HU": "Hungary", "IE": "Ireland", "IL": "Israel", "IN": "India", "IT": "Italy",
    "JP": "Japan", "KR": "South Korea", "LU": "Luxembourg", "MX": "Mexico", "MY": "Malaysia", "NL": "Netherlands",
    "NO": "Norway", "NZ": "New Zealand", "PL": "Poland", "PT": "Portugal", "RU": "Russia", "SA": "Saudi Arabia",
    "SE": "Sweden", "SG": "Singapore", "TH": "Thailand", "TW": "Taiwan", "UA": "Ukraine", "US": "United States",
    "VN": "Vietnam", "ZA": "South Africa",
}


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def title(x: str) -> str:
    runs = rf"regexp_extract_all(lower({x}), '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+')"
    return f"array_to_string(list_transform({runs}, lambda t: upper(t[1]) || t[2:]), '')"


def country(x: str) -> str:
    code = f"upper({strip(x)})"
    return f"""CASE WHEN {x} IS NULL OR {code} IN ('', 'UNKNOWN') THEN 'Unknown'
            WHEN length({code}) > 2 THEN {title(code)}
            ELSE coalesce((SELECT d.name FROM country_dim d WHERE d.code = {code}), {code}) END"""


def ascii_like(x: str, pattern: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"translate({x}, '{upper}', '{lower}') LIKE '{pattern.lower()}'"


_RAW = ",\n".join(
    f"{name} AS ({text.format(**{t: t for t in tables})})" for name, (text, tables) in RAW_TABLES.items()
)
_DIM = ", ".join(f"('{code}', '{name}')" for code, name in COUNTRY_NAMES.items())

PRELUDE = f"""WITH {_RAW},
country_dim(code, name) AS (VALUES {_DIM}),
clean_patents AS (
  SELECT patent_id, title, abstract, filing_date, CAST(year(filing_date) AS INTEGER) AS year, patent_type, wipo_kind
  FROM (SELECT patent_id, {strip("patent_title")} AS title, coalesce({strip("patent_abstract")}, '') AS abstract,
               TRY_CAST({strip("patent_date")} AS DATE) AS filing_date,
               lower({strip("coalesce(patent_type, '')")}) AS patent_type, wipo_kind FROM raw_patent)
  WHERE patent_id IS NOT NULL AND filing_date IS NOT NULL AND patent_type IN ('utility', 'reissue', '')),
patents AS (SELECT * FROM clean_patents WHERE title IS NOT NULL),
clean_locations AS (
  SELECT location_id, min({country("disambig_country")}) AS country_from_location
  FROM raw_location WHERE location_id IS NOT NULL GROUP BY location_id),
named_inventors AS (
  SELECT inventor_id,
         {strip(f"coalesce({strip('disambig_inventor_name_first')}, '') || ' ' || "
                f"coalesce({strip('disambig_inventor_name_last')}, '')")} AS name,
         CASE WHEN {strip("coalesce(inventor_country, '')")} <> ''
              THEN {country("inventor_country")}
              ELSE coalesce(country_from_location, 'Unknown') END AS country
  FROM raw_inventor LEFT JOIN clean_locations USING (location_id)
  WHERE inventor_id IS NOT NULL),
inventors AS (
  SELECT inventor_id, min(name) AS name, min(country) AS country
  FROM named_inventors WHERE length(name) > 1 GROUP BY inventor_id),
named_companies AS (
  SELECT assignee_id AS company_id, {strip("disambig_assignee_organization")} AS name,
         coalesce(country_from_location, 'Unknown') AS country
  FROM raw_assignee LEFT JOIN clean_locations USING (location_id)
  WHERE assignee_id IS NOT NULL AND disambig_assignee_organization IS NOT NULL),
companies AS (
  SELECT company_id, min(name) AS name, min(country) AS country
  FROM named_companies GROUP BY company_id HAVING length(min(name)) > 1),
clean_patent_inventor AS (
  SELECT DISTINCT patent_id, inventor_id FROM raw_inventor
  WHERE inventor_id IS NOT NULL AND patent_id IN (SELECT patent_id FROM clean_patents)),
clean_patent_company AS (
  SELECT DISTINCT patent_id, assignee_id AS company_id FROM raw_assignee
  WHERE assignee_id IS NOT NULL AND patent_id IN (SELECT patent_id FROM clean_patents)),
clean_relationships AS (
  SELECT patent_id, inventor_id, company_id
  FROM clean_patent_inventor FULL OUTER JOIN clean_patent_company USING (patent_id)),
relationships AS (
  SELECT r.patent_id, i.inventor_id, c.company_id
  FROM clean_relationships r
  LEFT JOIN inventors i ON r.inventor_id = i.inventor_id
  LEFT JOIN companies c ON r.company_id = c.company_id
  WHERE r.patent_id IN (SELECT patent_id FROM patents)),
detail AS (
  SELECT *
  FROM relationships
  LEFT JOIN (SELECT inventor_id, name AS inventor_name, country AS inventor_country FROM inventors) USING (inventor_id)
  LEFT JOIN (SELECT company_id, name AS company_name, country AS company_country FROM companies) USING (company_id)),
inventor_counts AS (
  SELECT inventor_id, inventor_name AS name, inventor_country AS country, count(DISTINCT patent_id) AS patent_count
  FROM detail WHERE inventor_id IS NOT NULL GROUP BY ALL),
company_counts AS (
  SELECT company_id, company_name AS name, company_country AS country, count(DISTINCT patent_id) AS patent_count
  FROM detail WHERE company_id IS NOT NULL GROUP BY ALL),
country_counts AS (
  SELECT inventor_country AS country, count(DISTINCT patent_id) AS patent_count
  FROM detail WHERE inventor_country IS NOT NULL GROUP BY ALL),
company_years AS (
  SELECT year, company_name AS company, count(DISTINCT patent_id) AS patent_count
  FROM detail JOIN patents USING (patent_id)
  WHERE company_name IS NOT NULL AND year BETWEEN 2015 AND 2024 GROUP BY ALL),
yearly AS (SELECT year, count(*) AS patent_count FROM patents WHERE year IS NOT NULL GROUP BY year)
"""


def with_tables(select: str) -> str:
    return PRELUDE + select.strip()
