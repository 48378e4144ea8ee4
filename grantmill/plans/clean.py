"""Raw tables to cleaned tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantmill.functions.country import UNKNOWN, country_lookup, iso_country_names, normalize_country
from grantmill.functions.text import blank_to_null, full_name, parse_date, strip, strip_or_empty
from grantmill.operators.columns import add_missing_default, add_missing_null, pick_column, rename_columns
from grantmill.operators.dedupe import distinct_pairs, keep_first
from grantmill.operators.joins import keep_valid_patents, lookup_left, pair_per_patent
from grantmill.sources.readers import sample_rows

# Patent types that are kept; an empty type counts as kept.
KEPT_TYPES = ("utility", "reissue", "")

INVENTOR_ID = ("disambig_inventor_id", "inventor_id")
COMPANY_ID = ("disambig_assignee_id", "assignee_id")

# Country names by code: a mapping, a table (code, name) of any size, or None for those of ISO 3166.
Names = Mapping[str, str] | DataFrame | None


def typed_patents(raw: DataFrame, rows: int | None = None) -> DataFrame:
    """All patents with typed, trimmed columns; ``rows`` caps the input by patent id."""
    df = add_missing_default(sample_rows(raw, rows), ["patent_abstract", "patent_type", "wipo_kind"])
    df = rename_columns(df, {"patent_title": "title", "patent_abstract": "abstract", "patent_date": "filing_date"})
    df = df.withColumns(
        {
            "filing_date": parse_date(F.col("filing_date")),
            "patent_type": F.lower(strip_or_empty(F.col("patent_type"))),
            "title": strip(F.col("title")),
            "abstract": strip_or_empty(F.col("abstract")),
        }
    )
    return df.select(
        "patent_id", "title", "abstract", "filing_date", F.year("filing_date").alias("year"), "patent_type", "wipo_kind"
    )


def clean_patents(raw: DataFrame, rows: int | None = None) -> DataFrame:
    """Patents with an id, a valid date and a kept type; ``rows`` caps the input by patent id."""
    typed = typed_patents(raw, rows)
    return typed.na.drop(subset=["patent_id", "filing_date"]).where(F.col("patent_type").isin(*KEPT_TYPES))


def _with_spelling(df: DataFrame, column: str, names: Names, out: str) -> DataFrame:
    if isinstance(names, DataFrame):
        return country_lookup(df, column, names, out)
    return df.withColumn(out, normalize_country(F.col(column), iso_country_names(df.sparkSession) if names is None else names))


def clean_locations(raw: DataFrame, names: Names = None, order: Sequence[str] = ()) -> DataFrame:
    """One country per location: of the first row by ``order``, else of the least country."""
    located = _with_spelling(
        raw.select("location_id", *order, "disambig_country"), "disambig_country", names, "country_from_location"
    ).select("location_id", *order, "country_from_location")
    first = keep_first(located.na.drop(subset=["location_id"]), "location_id", order)
    return first.select("location_id", "country_from_location")


def _with_country(
    entities: DataFrame, locations: DataFrame | None, names: Names, key: str
) -> DataFrame:
    """Country from the entity itself where it has one, else from its location."""
    if locations is None:
        found = add_missing_null(entities, ["country_from_location"])
    else:
        found = lookup_left(entities, locations, "location_id", spread_by=key)
    found = _with_spelling(found, "direct_country", names, "_direct")
    direct = F.when(F.col("direct_country").isNotNull(), F.col("_direct"))
    country = F.coalesce(direct, F.col("country_from_location"), F.lit(UNKNOWN))
    return found.select(key, "name", country.alias("country"))


def _distinct_entities(
    raw: DataFrame, candidates: Sequence[str], columns: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Id and attributes of each entity, once per spelling rather than once per patent.

    Repeats go before the shuffle and before any text is cleaned. With an order, each
    spelling keeps its least place.
    """
    rows = raw.select(F.col(pick_column(raw, candidates)).alias("_id"), *order, *columns)
    rows = rows.na.drop(subset=["_id"])
    if not order:
        return rows.distinct()
    place = F.struct(*[F.struct(F.col(c).isNull(), F.col(c).alias(c)).alias(c) for c in order])
    least = rows.groupBy("_id", *columns).agg(F.min(place).alias("_place"))
    return least.select("_id", *[F.col("_place")[c][c].alias(c) for c in order], *columns)


def clean_inventors(
    raw: DataFrame,
    locations: DataFrame | None,
    names: Names = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """One named row per inventor: short names go first, then the first row of each id stays.

    Rows are reduced to one per id before the location lookup, which then
    joins inventors and not their patents.
    """
    attributes = ["disambig_inventor_name_first", "disambig_inventor_name_last", "inventor_country", "location_id"]
    df = add_missing_null(raw, ["inventor_country", "location_id"])
    named = _distinct_entities(df, INVENTOR_ID, attributes, order).select(
        F.col("_id").alias("inventor_id"),
        *order,
        full_name(F.col("disambig_inventor_name_first"), F.col("disambig_inventor_name_last")).alias("name"),
        blank_to_null(F.col("inventor_country")).alias("direct_country"),
        "location_id",
    )
    first = keep_first(named, "inventor_id", order, where=F.length("name") > 1)
    return _with_country(first, locations, names, "inventor_id")


def clean_companies(
    raw: DataFrame,
    locations: DataFrame | None,
    names: Names = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """One named row per company: the first row of each id stays, then short names go."""
    attributes = ["disambig_assignee_organization", "assignee_country", "location_id"]
    df = add_missing_null(raw, ["assignee_country", "location_id"])
    df = df.na.drop(subset=["disambig_assignee_organization"])
    named = _distinct_entities(df, COMPANY_ID, attributes, order).select(
        F.col("_id").alias("company_id"),
        *order,
        strip(F.col("disambig_assignee_organization")).alias("name"),
        blank_to_null(F.col("assignee_country")).alias("direct_country"),
        "location_id",
    )
    first = keep_first(named, "company_id", order).where(F.length("name") > 1)
    return _with_country(first, locations, names, "company_id")


def _clean_pairs(raw: DataFrame, patents: DataFrame, candidates: Sequence[str], key: str) -> DataFrame:
    pairs = raw.select("patent_id", F.col(pick_column(raw, candidates)).alias(key)).na.drop("any")
    # The semi join shuffles by patent, which already groups equal pairs.
    return distinct_pairs(keep_valid_patents(pairs, patents), "patent_id", key)


def clean_patent_inventor(raw: DataFrame, patents: DataFrame) -> DataFrame:
    """Distinct inventor pairs of valid patents."""
    return _clean_pairs(raw, patents, INVENTOR_ID, "inventor_id")


def clean_patent_company(raw: DataFrame, patents: DataFrame) -> DataFrame:
    """Distinct company pairs of valid patents."""
    return _clean_pairs(raw, patents, COMPANY_ID, "company_id")


def clean_relationships(patent_inventor: DataFrame, patent_company: DataFrame) -> DataFrame:
    """Inventors by companies of each patent."""
    return pair_per_patent(patent_inventor, patent_company)
