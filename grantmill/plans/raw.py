"""From a folder of raw files to the tables the plans take."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from grantmill import schemas
from grantmill.plans.star import RawTables
from grantmill.session import run_together
from grantmill.sources.readers import if_present, land_raw_table, scan_raw_table

# Names of the raw files.
PATENT_FILE = "g_patent.tsv"
INVENTOR_FILE = "g_inventor_disambiguated.tsv"
ASSIGNEE_FILE = "g_assignee_disambiguated.tsv"
LOCATION_FILE = "g_location_disambiguated.tsv"
PATENT_INVENTOR_FILE = "g_patent_inventor.tsv"
PATENT_ASSIGNEE_FILE = "g_patent_assignee.tsv"

ORDINAL = "_file_order"


def open_raw(spark: SparkSession, folder: str, landed: str | None = None, **options) -> RawTables:
    """The raw tables of a folder, with each row's place in its file.

    The patent, inventor and assignee files must be there. Without the location file
    countries come from the entities, without a pair file pairs come from the entity file.
    With ``landed``, every table is copied there as Parquet first, so that the text is
    parsed once and later scans read the columns they need. ``options`` go to the reader.
    """

    def table(name: str, want: Sequence[str], ordinal: str | None = None) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        if landed is None:
            return scan_raw_table(spark, path, want, ordinal=ordinal, **options)
        return land_raw_table(spark, path, want, f"{landed.rstrip('/')}/{name.removesuffix('.tsv')}", ordinal=ordinal, **options)

    reads = {
        "raw_patent": lambda: table(PATENT_FILE, schemas.PATENT_COLUMNS),
        "raw_inventor": lambda: table(INVENTOR_FILE, ["patent_id", *schemas.INVENTOR_COLUMNS], ORDINAL),
        "raw_assignee": lambda: table(ASSIGNEE_FILE, ["patent_id", *schemas.ASSIGNEE_COLUMNS], ORDINAL),
        "raw_location": lambda: if_present(lambda: table(LOCATION_FILE, schemas.LOCATION_COLUMNS, ORDINAL)),
        "raw_patent_inventor": lambda: if_present(lambda: table(PATENT_INVENTOR_FILE, schemas.PATENT_INVENTOR_COLUMNS)),
        "raw_patent_assignee": lambda: if_present(lambda: table(PATENT_ASSIGNEE_FILE, schemas.PATENT_ASSIGNEE_COLUMNS)),
    }
    tables: dict[str, DataFrame | None] = {}

    def store(name: str) -> None:
        tables[name] = reads[name]()

    # Files are read at the same time: the last tasks of one do not hold up the next.
    run_together(spark, *[functools.partial(store, name) for name in reads])
    return RawTables(**tables, ordinal=ORDINAL)
