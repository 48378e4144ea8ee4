"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.fixtures import Fixtures
from checks.oracle import ascii_like, country, strip, title
from checks.registry import check
from grantmill import schemas
from grantmill.functions import country as countries
from grantmill.functions import text
from grantmill.operators import columns, counting, joins
from grantmill.plans import clean, datasets, reports

# Projections


@check(
    "rename_columns",
    """SELECT patent_id, patent_title AS title, patent_abstract AS abstract, patent_date AS filing_date, patent_type,
              wipo_kind FROM raw_patent""",
)
def _(fx: Fixtures):
    names = {"patent_title": "title", "patent_abstract": "abstract", "patent_date": "filing_date"}
    return columns.rename_columns(fx.raw_patent, names)


@check("add_missing_default", "SELECT location_id, disambig_country, '' AS patent_type, '' AS wipo_kind FROM raw_location")
def _(fx: Fixtures):
    return columns.add_missing_default(fx.raw_location, ["location_id", "patent_type", "wipo_kind"])


@check("add_missing_null", "SELECT *, CAST(NULL AS VARCHAR) AS assignee_country FROM raw_assignee")
def _(fx: Fixtures):
    return columns.add_missing_null(fx.raw_assignee, ["assignee_country", "location_id"])


@check("pick_id_column", "SELECT 'd-' || inventor_id AS id, patent_id FROM raw_inventor")
def _(fx: Fixtures):
    both = fx.raw_inventor.withColumn("disambig_inventor_id", F.concat(F.lit("d-"), "inventor_id"))
    return both.select(F.col(columns.pick_column(both, clean.INVENTOR_ID)).alias("id"), "patent_id")


@check("pick_bridge_id", "SELECT patent_id, assignee_id AS company_id FROM raw_assignee")
def _(fx: Fixtures):
    raw = fx.raw_assignee
    return raw.select("patent_id", F.col(columns.pick_column(raw, clean.COMPANY_ID)).alias("company_id"))


@check("project_reorder", "SELECT country, name, inventor_id FROM inventors")
def _(fx: Fixtures):
    return fx.star.inventors.select("country", "name", "inventor_id")


@check("drop_artifact_columns", "SELECT patent_id, assignee_id, location_id FROM raw_assignee")
def _(fx: Fixtures):
    raw = fx.raw_assignee.select("patent_id", "assignee_id", "location_id")
    return columns.drop_artifact_columns(raw.withColumn("assignee_id.1", F.col("assignee_id")))


@check("align_to_schema", "SELECT inventor_id, CAST(NULL AS VARCHAR) AS name, location_id AS country FROM raw_inventor")
def _(fx: Fixtures):
    return columns.align_to_schema(fx.raw_inventor.withColumnRenamed("location_id", "country"), schemas.INVENTORS)


@check("label_concat", "SELECT inventor_id, name || '  [' || country || ']' AS label FROM inventors")
def _(fx: Fixtures):
    return fx.star.inventors.select("inventor_id", text.label(F.col("name"), F.col("country")).alias("label"))


@check("column_aliases", "SELECT name AS inventor, country, patent_count AS cnt FROM inventor_counts")
def _(fx: Fixtures):
    counts = reports.inventor_counts(fx.star).join(fx.star.inventors, "inventor_id")
    return counts.select(F.col("name").alias("inventor"), "country", F.col("patent_count").alias("cnt"))


# Predicates


@check(
    "drop_null_keys",
    "SELECT patent_id, patent_date FROM raw_patent WHERE patent_id IS NOT NULL AND patent_date IS NOT NULL",
)
def _(fx: Fixtures):
    return fx.raw_patent.select("patent_id", "patent_date").na.drop(subset=["patent_id", "patent_date"])


@check(
    "drop_any_null",
    """SELECT patent_id, assignee_id, disambig_assignee_organization FROM raw_assignee
       WHERE disambig_assignee_organization IS NOT NULL AND assignee_id IS NOT NULL""",
)
def _(fx: Fixtures):
    return fx.raw_assignee.select("patent_id", "assignee_id", "disambig_assignee_organization").na.drop("any")


@check(
    "filter_patent_type",
    f"""SELECT patent_id, lower({strip("coalesce(patent_type, '')")}) AS patent_type FROM raw_patent
        WHERE lower({strip("coalesce(patent_type, '')")}) IN ('utility', 'reissue', '')""",
)
def _(fx: Fixtures):
    kind = F.lower(text.strip_or_empty(F.col("patent_type")))
    typed = fx.raw_patent.select("patent_id", kind.alias("patent_type"))
    return typed.where(F.col("patent_type").isin(*clean.KEPT_TYPES))


@check("filter_name_length", "SELECT DISTINCT inventor_id, name FROM named_inventors WHERE length(name) > 1")
def _(fx: Fixtures):
    name = text.full_name(F.col("disambig_inventor_name_first"), F.col("disambig_inventor_name_last"))
    named = fx.raw_inventor.select("inventor_id", name.alias("name")).na.drop(subset=["inventor_id"])
    return named.where(F.length("name") > 1).distinct()


@check("year_between", "SELECT patent_id, year FROM clean_patents WHERE year BETWEEN 1980 AND 2018")
def _(fx: Fixtures):
    return fx.clean_patents.where(counting.year_between(1980, 2018)).select("patent_id", "year")


@check("year_at_least", "SELECT patent_id, year FROM clean_patents WHERE year >= 2000")
def _(fx: Fixtures):
    return fx.clean_patents.where(F.col("year") >= 2000).select("patent_id", "year")


@check("not_null", "SELECT patent_id, patent_abstract FROM raw_patent WHERE patent_abstract IS NOT NULL")
def _(fx: Fixtures):
    return fx.raw_patent.where(F.col("patent_abstract").isNotNull()).select("patent_id", "patent_abstract")


@check("exclude_unknown_country", "SELECT inventor_id, country FROM inventors WHERE country NOT IN ('Unknown', '')")
def _(fx: Fixtures):
    kept = fx.star.inventors.where(~F.col("country").isin(countries.UNKNOWN, ""))
    return kept.select("inventor_id", "country")


@check("exclude_unknown_xx", "SELECT inventor_id, country FROM inventors WHERE country NOT IN ('Unknown', '', 'XX')")
def _(fx: Fixtures):
    return fx.star.inventors.where(~F.col("country").isin(*datasets.NOT_A_COUNTRY)).select("inventor_id", "country")


@check("title_like", f"SELECT patent_id, patent_title FROM raw_patent WHERE {ascii_like('patent_title', '%TION%')}")
def _(fx: Fixtures):
    found = fx.raw_patent.where(text.matches_keyword(F.col("patent_title"), "TION"))
    return found.select("patent_id", "patent_title")


@check(
    "rank_at_most",
    """SELECT patent_type, CAST(year AS INTEGER) AS year, patent_count, CAST(rank AS INTEGER) AS rank FROM (
         SELECT *, rank() OVER (PARTITION BY patent_type ORDER BY patent_count DESC) AS rank
         FROM (SELECT patent_type, year, count(*) AS patent_count FROM clean_patents GROUP BY ALL)) WHERE rank <= 3""",
)
def _(fx: Fixtures):
    counts = fx.clean_patents.groupBy("patent_type", "year").agg(F.count("*").alias("patent_count"))
    falling = Window.partitionBy("patent_type").orderBy(F.desc("patent_count"))
    return counts.withColumn("rank", F.rank().over(falling)).where("rank <= 3")


@check(
    "recent_years",
    "SELECT year, patent_count FROM yearly WHERE year >= (SELECT max(year) FROM yearly) - 10",
)
def _(fx: Fixtures):
    return datasets.recent_years(counting.patents_per_year(fx.star.patents, 1976, 2025))


@check(
    "non_blank_test",
    f"SELECT patent_id, inventor_id, inventor_country FROM raw_inventor WHERE {strip('inventor_country')} <> ''",
)
def _(fx: Fixtures):
    kept = fx.raw_inventor.where(text.blank_to_null(F.col("inventor_country")).isNotNull())
    return kept.select("patent_id", "inventor_id", "inventor_country")


# Scalar functions


@check(
    "parse_date_or_null",
    f"SELECT patent_id, TRY_CAST({strip('patent_date')} AS DATE) AS filing_date FROM raw_patent",
)
def _(fx: Fixtures):
    return fx.raw_patent.select("patent_id", text.parse_date(F.col("patent_date")).alias("filing_date"))


@check("extract_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def _(fx: Fixtures):
    return fx.given("orders").select("o_orderkey", F.year("o_orderdate").alias("year"))


@check("format_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(fx: Fixtures):
    return fx.given("orders").select("o_orderkey", text.format_date(F.col("o_orderdate")).alias("day"))


@check("trim", f"SELECT doc_id, {strip('text')} AS text FROM documents")
def _(fx: Fixtures):
    return fx.given("documents").select("doc_id", text.strip(F.col("text")).alias("text"))


@check("lower", "SELECT patent_id, lower(patent_type) AS patent_type FROM raw_patent")
def _(fx: Fixtures):
    return fx.raw_patent.select("patent_id", F.lower("patent_type").alias("patent_type"))


@check("upper", "SELECT inventor_id, upper(name) AS name FROM inventors")
def _(fx: Fixtures):
    return fx.star.inventors.select("inventor_id", F.upper("name").alias("name"))


@check("title_case", f"SELECT p_partkey, {title('p_name')} AS name, {title('p_type')} AS type FROM part")
def _(fx: Fixtures):
    return fx.given("part").select(
        "p_partkey", text.title_case(F.col("p_name")).alias("name"), text.title_case(F.col("p_type")).alias("type")
    )


@check(
    "fill_null",
    """SELECT patent_id, coalesce(patent_abstract, '') AS patent_abstract, coalesce(patent_type, 'Unknown') AS patent_type
       FROM raw_patent""",
)
def _(fx: Fixtures):
    return fx.raw_patent.select(
        "patent_id",
        F.coalesce("patent_abstract", F.lit("")).alias("patent_abstract"),
        F.coalesce("patent_type", F.lit(countries.UNKNOWN)).alias("patent_type"),
    )


@check(
    "coalesce_blank",
    f"""SELECT patent_id, inventor_id,
               CASE WHEN {strip("coalesce(inventor_country, '')")} <> '' THEN inventor_country
                    ELSE location_id END AS place FROM raw_inventor""",
)
def _(fx: Fixtures):
    place = F.coalesce(text.blank_to_null(F.col("inventor_country")), "location_id")
    return fx.raw_inventor.select("patent_id", "inventor_id", place.alias("place"))


@check(
    "normalize_country",
    f"""SELECT inventor_id, patent_id, {country("disambig_country")} AS country
        FROM raw_inventor LEFT JOIN raw_location USING (location_id)""",
)
def _(fx: Fixtures):
    located = joins.lookup_left(fx.raw_inventor, fx.raw_location, "location_id", spread_by="inventor_id")
    return located.select(
        "inventor_id", "patent_id", countries.normalize_country(F.col("disambig_country")).alias("country")
    )


@check("full_name", "SELECT DISTINCT inventor_id, name FROM named_inventors")
def _(fx: Fixtures):
    name = text.full_name(F.col("disambig_inventor_name_first"), F.col("disambig_inventor_name_last"))
    return fx.raw_inventor.select("inventor_id", name.alias("name")).na.drop(subset=["inventor_id"]).distinct()


@check("string_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents")
def _(fx: Fixtures):
    return fx.given("documents").select("doc_id", F.length("text").alias("n"))


@check(
    "is_two_letters",
    r"""SELECT patent_id, inventor_id, regexp_full_match(inventor_country, '\p{L}{2}') AS is_code FROM raw_inventor""",
)
def _(fx: Fixtures):
    return fx.raw_inventor.select(
        "patent_id", "inventor_id", text.is_two_letters(F.col("inventor_country")).alias("is_code")
    )


@check("cast_string", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem")
def _(fx: Fixtures):
    return fx.given("lineitem").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_linenumber").cast("string").alias("line")
    )


@check(
    "round_n",
    """SELECT inventor_id, round(CAST(patent_count AS DOUBLE) * 100 / 7, 2) AS two,
              round(CAST(patent_count AS DOUBLE) * 100 / 7, 4) AS four FROM inventor_counts""",
)
def _(fx: Fixtures):
    value = F.col("patent_count") * F.lit(100.0) / F.lit(7)
    return reports.inventor_counts(fx.star).select(
        "inventor_id", F.round(value, 2).alias("two"), F.round(value, 4).alias("four")
    )


@check(
    "real_division",
    """SELECT inventor_id, CAST(patent_count AS DOUBLE) * 100 / (SELECT count(*) FROM patents) AS pct
       FROM inventor_counts""",
)
def _(fx: Fixtures):
    total = counting.count_rows(fx.star.patents, "total").scalar()
    return reports.inventor_counts(fx.star).select(
        "inventor_id", F.try_divide(F.col("patent_count") * F.lit(100.0), total).alias("pct")
    )


@check(
    "conditional_null",
    "SELECT patent_id, CASE WHEN wipo_kind <> '5' THEN wipo_kind END AS wipo_kind FROM raw_patent",
)
def _(fx: Fixtures):
    return fx.raw_patent.select("patent_id", F.when(F.col("wipo_kind") != "5", F.col("wipo_kind")).alias("wipo_kind"))


@check("like_pattern", f"SELECT patent_id FROM raw_patent WHERE {ascii_like('patent_title', '%d_t%e%')}")
def _(fx: Fixtures):
    found = fx.raw_patent.where(text.fold_ascii(F.col("patent_title")).like(text.like_pattern("d_t%e")))
    return found.select("patent_id")


@check("int_truncate", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS INTEGER) AS whole FROM lineitem")
def _(fx: Fixtures):
    return fx.given("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("int").alias("whole")
    )


@check(
    "thousands_format",
    "SELECT o_orderkey, format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)) AS price FROM orders",
)
def _(fx: Fixtures):
    return fx.given("orders").select("o_orderkey", text.thousands(F.col("o_totalprice").cast("bigint")).alias("price"))


@check(
    "percent_format",
    """SELECT country, format('{:.2f}%', round(CAST(patent_count AS DOUBLE) * 100 / (SELECT count(*) FROM patents), 2))
              AS shown, format('{:<10}', country) AS padded, lpad(format('{:,}', patent_count), 7, ' ') AS patents
       FROM country_counts""",
)
def _(fx: Fixtures):
    counts = counting.with_share(
        reports.country_counts(fx.star, ()), counting.count_rows(fx.star.patents, "total"), "pct_share"
    )
    return counts.select(
        "country",
        text.percent(F.col("pct_share")).alias("shown"),
        text.pad_right(F.col("country"), 10).alias("padded"),
        text.pad_left(text.thousands(F.col("patent_count")), 7).alias("patents"),
    )


@check("bar_string", "SELECT l_orderkey, l_linenumber, repeat('█', l_linenumber) AS bar FROM lineitem")
def _(fx: Fixtures):
    return fx.given("lineitem").select("l_orderkey", "l_linenumber", text.bar(F.col("l_linenumber")).alias("bar"))


@check(
    "json_build",
    """SELECT inventor_id, CAST(to_json({name: name, country: country, patents: patent_count}) AS VARCHAR) AS entry
       FROM inventor_counts""",
)
def _(fx: Fixtures):
    counts = reports.inventor_counts(fx.star).join(fx.star.inventors, "inventor_id")
    entry = F.struct("name", "country", F.col("patent_count").alias("patents"))
    return counts.select("inventor_id", F.to_json(entry).alias("entry"))
