"""Raw columns the cleaning steps ask for and the typed target tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the raw files and of the target tables.
PATENT_COLUMNS = ["patent_id", "patent_title", "patent_abstract", "patent_date", "patent_type", "wipo_kind"]
INVENTOR_COLUMNS = [
    "disambig_inventor_id",
    "inventor_id",
    "disambig_inventor_name_first",
    "disambig_inventor_name_last",
    "inventor_country",
    "location_id",
]
ASSIGNEE_COLUMNS = [
    "disambig_assignee_id",
    "assignee_id",
    "disambig_assignee_organization",
    "assignee_country",
    "location_id",
]
LOCATION_COLUMNS = ["location_id", "disambig_country"]
PATENT_INVENTOR_COLUMNS = ["patent_id", "inventor_id", "disambig_inventor_id"]
PATENT_ASSIGNEE_COLUMNS = ["patent_id", "assignee_id", "disambig_assignee_id"]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


RAW_LOCATION = T.StructType(_strings(*LOCATION_COLUMNS))

PATENTS = T.StructType(
    _strings("patent_id", "title", "abstract")
    + [T.StructField("filing_date", T.DateType()), T.StructField("year", T.IntegerType())]
    + _strings("patent_type", "wipo_kind")
)
INVENTORS = T.StructType(_strings("inventor_id", "name", "country"))
COMPANIES = T.StructType(_strings("company_id", "name", "country"))
PATENT_INVENTOR = T.StructType(_strings("patent_id", "inventor_id"))
PATENT_COMPANY = T.StructType(_strings("patent_id", "company_id"))
RELATIONSHIPS = T.StructType(
    [T.StructField("id", T.LongType())] + _strings("patent_id", "inventor_id", "company_id")
)

# The four target tables in the order their references require.
TARGETS = {
    "patents": PATENTS,
    "inventors": INVENTORS,
    "companies": COMPANIES,
    "relationships": RELATIONSHIPS,
}
PRIMARY_KEYS = {"patents": "patent_id", "inventors": "inventor_id", "companies": "company_id"}
NOT_NULL = {"patents": "title", "inventors": "name", "companies": "name"}
