"""Scans, sinks and set operations."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixtures import Fixtures
from checks.registry import check
from grantmill import schemas
from grantmill.functions.text import CSV_NULL_TOKENS
from grantmill.operators import columns
from grantmill.plans import clean, reports
from grantmill.sources import readers, writers


@check(
    "scan_raw_table",
    """SELECT patent_id, nullif(patent_title, '') AS patent_title, nullif(patent_abstract, '') AS patent_abstract,
              patent_date, patent_type, wipo_kind FROM raw_patent""",
)
def _(fx: Fixtures):
    return readers.scan_raw_table(fx.spark, fx.raw_file("raw_patent"), schemas.PATENT_COLUMNS)


@check(
    "scan_large_table",
    """SELECT inventor_id, disambig_inventor_name_first, disambig_inventor_name_last, inventor_country, location_id
       FROM raw_inventor""",
)
def _(fx: Fixtures):
    path = fx.raw_file("raw_inventor")
    return readers.scan_raw_table(fx.spark, path, schemas.INVENTOR_COLUMNS, multi_line=False)


@check("land_raw_table", "SELECT assignee_id, disambig_assignee_organization, location_id FROM raw_assignee")
def _(fx: Fixtures):
    source, out = fx.raw_file("raw_assignee"), fx.scratch("raw_assignee")
    return readers.land_raw_table(fx.spark, source, schemas.ASSIGNEE_COLUMNS, out)


@check("select_available", "SELECT assignee_id, disambig_assignee_organization, location_id FROM raw_assignee")
def _(fx: Fixtures):
    return readers.select_available(fx.raw_assignee, schemas.ASSIGNEE_COLUMNS)


@check("resolve_source", "SELECT patent_id, inventor_id FROM raw_inventor")
def _(fx: Fixtures):
    dedicated, entities = fx.scratch("g_patent_inventor.tsv"), fx.raw_file("raw_inventor")
    return readers.resolve_source(fx.spark, dedicated, entities, schemas.PATENT_INVENTOR_COLUMNS)


@check("optional_source", "SELECT company_id, name, 'Unknown' AS country FROM companies")
def _(fx: Fixtures):
    missing = readers.optional_source(fx.spark, fx.scratch("g_location.tsv"), schemas.RAW_LOCATION)
    return clean.clean_companies(fx.raw_assignee, clean.clean_locations(missing))


@check(
    "missing_source_error",
    """SELECT 'raw_patent' AS source, 'OK' AS condition, count(*) AS row_count FROM raw_patent
       UNION ALL SELECT 'raw_assignee', 'OK', count(*) FROM raw_assignee
       UNION ALL SELECT 'raw_location', 'OK', count(*) FROM raw_location
       UNION ALL SELECT 'patent_inventor', 'PATH_NOT_FOUND', NULL""",
)
def _(fx: Fixtures):
    present = {name: fx.raw_file(name) for name in ("raw_patent", "raw_assignee", "raw_location")}
    want = {
        "raw_patent": schemas.PATENT_COLUMNS,
        "raw_assignee": schemas.ASSIGNEE_COLUMNS,
        "raw_location": schemas.LOCATION_COLUMNS,
        "patent_inventor": schemas.PATENT_INVENTOR_COLUMNS,
    }
    return readers.source_status(fx.spark, {**present, "patent_inventor": fx.scratch("absent.tsv")}, want)


@check(
    "tolerant_parse",
    """SELECT patent_id, inventor_id,
              CASE WHEN CAST(patent_id AS BIGINT) % 7 = 0 THEN NULL ELSE location_id END AS location_id,
              CAST(patent_id AS BIGINT) % 7 = 0 OR CAST(patent_id AS BIGINT) % 5 = 0 AS is_bad_line
       FROM raw_inventor""",
)
def _(fx: Fixtures):
    patent = F.col("patent_id").cast("bigint")
    two = [F.col("patent_id"), F.coalesce("inventor_id", F.lit(""))]
    three = [*two, F.coalesce("location_id", F.lit(""))]
    line = (
        F.when(patent % 7 == 0, F.concat_ws("\t", *two))
        .when(patent % 5 == 0, F.concat_ws("\t", *three, F.lit("extra")))
        .otherwise(F.concat_ws("\t", *three))
    )
    path = fx.scratch("uneven.tsv")
    lines = fx.raw_inventor.select(line.alias("patent_id\tinventor_id\tlocation_id"))
    plain = lines.write.option("header", True).option("sep", "\x01").option("quote", "\x00")
    plain.option("ignoreTrailingWhiteSpace", False).csv(path)
    kept = readers.tolerant_parse(fx.spark, path)
    return kept.select("patent_id", "inventor_id", "location_id", F.col(readers.CORRUPT).isNotNull().alias("is_bad_line"))


@check(
    "null_tokens",
    """SELECT inventor_id, nullif(disambig_inventor_name_first, 'X') AS disambig_inventor_name_first,
              disambig_inventor_name_last, inventor_country, location_id FROM raw_inventor""",
)
def _(fx: Fixtures):
    path = fx.raw_file("raw_inventor")
    tokens = (*CSV_NULL_TOKENS, "X")
    return readers.scan_raw_table(fx.spark, path, schemas.INVENTOR_COLUMNS, null_tokens=tokens)


@check("sample_rows", "SELECT patent_id, patent_date FROM raw_patent ORDER BY patent_id LIMIT 1000")
def _(fx: Fixtures):
    return readers.sample_rows(fx.raw_patent.select("patent_id", "patent_date"), 1000)


@check("read_clean", "SELECT company_id, name, country FROM companies")
def _(fx: Fixtures):
    path = fx.scratch("companies")
    writers.write_clean(fx.star.companies, path)
    return readers.read_clean(fx.spark, path)


@check(
    "read_table_query",
    """SELECT CAST(year AS INTEGER) AS year, patent_type, count(*) AS patent_count FROM patents
       WHERE year >= 1998 AND patent_type <> 'reissue' GROUP BY ALL""",
)
def _(fx: Fixtures):
    text = """SELECT year, patent_type, count(*) AS patent_count FROM {patents}
              WHERE year >= :since AND patent_type <> :without GROUP BY year, patent_type"""
    args = {"since": 1998, "without": "reissue"}
    return readers.read_table_query(fx.spark, text, {"patents": fx.star.patents}, args)


@check("read_key_column", "SELECT DISTINCT inventor_id FROM raw_inventor WHERE inventor_id IS NOT NULL")
def _(fx: Fixtures):
    return readers.read_key_column(fx.raw_inventor, "inventor_id")


@check(
    "write_clean",
    """SELECT inventor_id, name, country, (SELECT count(*) FROM inventors) AS written_rows FROM inventors""",
)
def _(fx: Fixtures):
    path = fx.scratch("inventors")
    rows = writers.write_clean(fx.star.inventors, path)
    return readers.read_clean(fx.spark, path).withColumn("written_rows", F.lit(rows).cast("bigint"))


@check("write_table", "SELECT patent_id, filing_date, year, patent_type, wipo_kind FROM patents")
def _(fx: Fixtures):
    path = fx.scratch("patents")
    patents = fx.star.patents.select("patent_id", "filing_date", "year", "patent_type", "wipo_kind")
    writers.write_table(patents.where("year < 2000"), path)
    writers.write_table(patents.where("year >= 2000"), path)
    return fx.spark.read.parquet(path)


@check("recreate_tables", "SELECT patent_id, title, abstract, filing_date, year, patent_type, wipo_kind FROM patents")
def _(fx: Fixtures):
    return writers.recreate_tables(fx.spark, fx.scratch("tables"), fx.target_tables)["patents"]


@check(
    "recreate_relationships",
    """SELECT patent_id, inventor_id, company_id, count(*) OVER () AS ids, CAST(1 AS BIGINT) AS first_id,
              count(*) OVER () AS last_id FROM relationships""",
)
def _(fx: Fixtures):
    loaded = writers.recreate_tables(fx.spark, fx.scratch("tables"), fx.target_tables)["relationships"]
    # The ids are dense and unique; which row has which is not fixed.
    ids = loaded.agg(F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return loaded.drop("id").join(F.broadcast(ids), how="cross")


_SHARE = "round(CAST(patent_count AS DOUBLE) * 100 / (SELECT count(*) FROM patents), 2)"


@check(
    "export_reports_csv",
    f"""SELECT * FROM (SELECT 'top_inventors' AS report, name AS label, country, patent_count, CAST(NULL AS DOUBLE) AS pct_share
                      FROM inventor_counts ORDER BY patent_count DESC, inventor_id LIMIT 20)
       UNION ALL SELECT * FROM (SELECT 'top_companies', name, country, patent_count, NULL FROM company_counts
                                ORDER BY patent_count DESC, company_id LIMIT 20)
       UNION ALL SELECT * FROM (SELECT 'country_trends', country, country, patent_count, {_SHARE} FROM country_counts
                                WHERE country NOT IN ('Unknown', '') ORDER BY patent_count DESC, country LIMIT 20)
       UNION ALL SELECT 'yearly_trends', CAST(year AS VARCHAR), NULL, patent_count, NULL FROM yearly
                 WHERE year BETWEEN 1976 AND 2025""",
)
def _(fx: Fixtures):
    paths = writers.export_reports_csv(reports.csv_reports(fx.star), fx.scratch("reports"))

    def stored(report: str, path: str):
        table = columns.add_missing_null(fx.spark.read.option("header", True).csv(path), ["country", "pct_share"])
        return table.select(
            F.lit(report).alias("report"),
            F.col(table.columns[0]).alias("label"),
            "country",
            F.col("patent_count").cast("bigint").alias("patent_count"),
            F.col("pct_share").cast("double").alias("pct_share"),
        )

    return functools.reduce(DataFrame.unionByName, [stored(*item) for item in paths.items()])


@check(
    "export_report_json",
    f"""SELECT total_patents, list, CAST(rank AS BIGINT) AS rank, name, country, patents, share FROM (
          SELECT (SELECT count(*) FROM patents) AS total_patents, * FROM (
            SELECT 'inventors' AS list, row_number() OVER (ORDER BY patent_count DESC, inventor_id) AS rank, name, country,
                   patent_count AS patents, CAST(NULL AS DOUBLE) AS share FROM inventor_counts
            UNION ALL SELECT 'companies', row_number() OVER (ORDER BY patent_count DESC, company_id), name, country,
                   patent_count, NULL FROM company_counts
            UNION ALL SELECT 'countries', row_number() OVER (ORDER BY patent_count DESC, country), NULL, country, patent_count,
                   {_SHARE} FROM country_counts WHERE country NOT IN ('Unknown', ''))
          WHERE rank <= 10)
       UNION ALL SELECT (SELECT count(*) FROM patents), 'years', year, NULL, NULL, patent_count, NULL FROM yearly
       WHERE year BETWEEN 1976 AND 2025""",
)
def _(fx: Fixtures):
    report = reports.report_json(fx.star)
    path = writers.export_report_json(report, fx.scratch("patent_report"))
    stored = fx.spark.read.schema(report.schema).json(path)

    def entries(name: str, field: str):
        rows = stored.select("total_patents", F.posexplode(field).alias("place", "e")).select("total_patents", "place", "e.*")
        rows = columns.add_missing_null(rows, ["name", "country", "share"])
        rank = F.col("year") if name == "years" else F.col("place") + 1
        return rows.select(
            "total_patents", F.lit(name).alias("list"), rank.cast("bigint").alias("rank"), "name", "country", "patents",
            F.col("share").cast("double").alias("share"),
        )

    lists = {"inventors": "top_inventors", "companies": "top_companies", "countries": "top_countries", "years": "yearly_trend"}
    return functools.reduce(DataFrame.unionByName, [entries(*item) for item in lists.items()])


@check(
    "table_row_counts",
    """SELECT 'patents' AS "table", count(*) AS row_count FROM patents
       UNION ALL SELECT 'inventors', count(*) FROM inventors
       UNION ALL SELECT 'companies', count(*) FROM companies
       UNION ALL SELECT 'relationships', count(*) FROM relationships""",
)
def _(fx: Fixtures):
    return writers.table_row_counts(fx.target_tables)


@check(
    "union_all_chunks",
    """SELECT patent_id, inventor_id AS entity_id FROM raw_inventor
       UNION ALL SELECT patent_id, assignee_id FROM raw_assignee""",
)
def _(fx: Fixtures):
    inventors = fx.raw_inventor.select("patent_id", F.col("inventor_id").alias("entity_id"))
    return inventors.unionByName(fx.raw_assignee.select(F.col("assignee_id").alias("entity_id"), "patent_id"))


@check(
    "schema_difference",
    """SELECT assignee_id, disambig_assignee_organization, location_id, CAST(NULL AS VARCHAR) AS disambig_assignee_id,
              CAST(NULL AS VARCHAR) AS assignee_country FROM raw_assignee""",
)
def _(fx: Fixtures):
    missing, extra = columns.schema_difference(fx.raw_assignee, schemas.ASSIGNEE_COLUMNS)
    return columns.add_missing_null(fx.raw_assignee.drop(*extra), missing)
