"""The loaded star: patents, inventors, companies and the pairs between them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grantmill import schemas
from grantmill.operators.columns import align_to_schema
from grantmill.operators.dedupe import keep_first
from grantmill.operators.integrity import check_unique_key, surrogate_id
from grantmill.operators.joins import fresh_key, keep_valid_patents, null_out_orphans, pair_per_patent, with_patent
from grantmill.plans.clean import (
    Names,
    clean_companies,
    clean_inventors,
    clean_locations,
    clean_patent_company,
    clean_patent_inventor,
    clean_patents,
)
from grantmill.session import materialize, materialize_together, run_together, scratch_area

_PATENT_ORDER = ("filing_date", "patent_type", "wipo_kind", "title", "abstract")
RELATIONSHIP_ORDER = ("patent_id", "inventor_id", "company_id")


@dataclass(frozen=True)
class RawTables:
    """Raw tables. Any object with these attributes will do.

    Without a location table, countries come from the entities alone. Without
    dedicated pair tables, pairs come from the entity tables. ``ordinal`` names a column of
    the entity and location tables that orders their rows as they stood in their files; the
    first row of an id is then the first of the file.
    """

    raw_patent: DataFrame
    raw_inventor: DataFrame
    raw_assignee: DataFrame
    raw_location: DataFrame | None = None
    raw_patent_inventor: DataFrame | None = None
    raw_patent_assignee: DataFrame | None = None
    ordinal: str | None = None


class Star(ABC):
    """Tables the reports run on.

    The two pair tables hold distinct pairs of loaded patents. All counts are
    taken from them: a patent's inventors times its companies, as in the
    relationships table, would only add repeats that a distinct count removes.
    ``resolved`` states that every id in them is null or has its dimension row.
    """

    patents: DataFrame
    inventors: DataFrame
    companies: DataFrame
    patent_inventor: DataFrame
    patent_company: DataFrame
    resolved: bool

    @abstractmethod
    def relationships(self) -> DataFrame:
        """Inventor by company of every patent, orphaned ids null."""

    def detail_ids(self) -> DataFrame:
        """Every patent, with title and year, with each of its inventors and companies: ids, null where it has none."""
        return detail_of(self.patents, self.patent_inventor, self.patent_company)

    def kept_counts(self, name: str) -> DataFrame | None:
        """Counts that were kept at load time, in parts that add up; ``None`` where none are."""
        return None

    def for_counts(self) -> Star:
        """The same star for several reports of counts."""
        return self


def detail_of(patents: DataFrame, patent_inventor: DataFrame, patent_company: DataFrame) -> DataFrame:
    """``(patent_id, title, year, inventor_id, company_id)``: pairs and patents joined so that a hot patent can be split."""
    pairs = pair_per_patent(patent_inventor, patent_company)
    paired = patent_inventor.select("patent_id").union(patent_company.select("patent_id"))
    detail = with_patent(pairs, patents.select("patent_id", "title", "year"), paired)
    return detail.select("patent_id", "title", "year", "inventor_id", "company_id")


class RawStar(Star):
    """The star as lazy plans over raw tables; only what is read is planned.

    The pairings read both pair tables several times: before them, patents and pairs are written to scratch once.
    """

    resolved = False

    def __init__(self, raw: RawTables, names: Names = None, rows: int | None = None):
        self._raw, self._names, self._rows = raw, names, rows
        ordinal = getattr(raw, "ordinal", None)
        self._order = (ordinal,) if ordinal else ()

    @cached_property
    def locations(self) -> DataFrame | None:
        location = self._raw.raw_location
        return None if location is None else clean_locations(location, self._names, self._order)

    @cached_property
    def cleaned_patents(self) -> DataFrame:
        return clean_patents(self._raw.raw_patent, self._rows)

    @cached_property
    def patents(self) -> DataFrame:
        return load_patents(self.cleaned_patents)

    @cached_property
    def inventors(self) -> DataFrame:
        return clean_inventors(self._raw.raw_inventor, self.locations, self._names, self._order)

    @cached_property
    def companies(self) -> DataFrame:
        return clean_companies(self._raw.raw_assignee, self.locations, self._names, self._order)

    def inventor_pairs(self, patents: DataFrame) -> DataFrame:
        dedicated = self._raw.raw_patent_inventor
        return clean_patent_inventor(self._raw.raw_inventor if dedicated is None else dedicated, patents)

    def company_pairs(self, patents: DataFrame) -> DataFrame:
        dedicated = self._raw.raw_patent_assignee
        return clean_patent_company(self._raw.raw_assignee if dedicated is None else dedicated, patents)

    @cached_property
    def patent_inventor(self) -> DataFrame:
        return self.inventor_pairs(self.patents)

    @cached_property
    def patent_company(self) -> DataFrame:
        return self.company_pairs(self.patents)

    def relationships(self) -> DataFrame:
        patents = materialize(self.patents.select("patent_id"), "patent_ids")
        return load_relationships(
            self.inventor_pairs(patents), self.company_pairs(patents), self.inventors, self.companies, with_id=False
        )

    def detail_ids(self) -> DataFrame:
        patents = materialize(self.patents.select("patent_id", "title", "year"), "patents")
        return detail_of(
            patents,
            *materialize_together(
                (self.inventor_pairs(patents), "patent_inventor"), (self.company_pairs(patents), "patent_company")
            ),
        )

    def for_counts(self) -> Star:
        """Patents, inventors and their pairs written once, as several reports read them; without patent texts."""
        return _CountedStar(self)


class _CountedStar(RawStar):
    def __init__(self, star: RawStar):
        super().__init__(star._raw, star._names, star._rows)
        self.patents = materialize(star.patents.select("patent_id", "year"), "patents")
        self.companies = star.companies

        def write_inventors() -> None:
            self.inventors = materialize(star.inventors, "inventors")

        def write_pairs() -> None:
            self.patent_inventor = materialize(star.inventor_pairs(self.patents), "patent_inventor")

        run_together(self.patents.sparkSession, write_inventors, write_pairs)


class StoredStar(Star):
    """The star written by ``build_star``."""

    resolved = True

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root

    def _table(self, name: str, schema: StructType) -> DataFrame:
        return self._spark.read.schema(schema).parquet(f"{self._root}/{name}").select(*schema.names)

    @cached_property
    def patents(self) -> DataFrame:
        return self._table("patents", schemas.PATENTS)

    @cached_property
    def inventors(self) -> DataFrame:
        return self._table("inventors", schemas.INVENTORS)

    @cached_property
    def companies(self) -> DataFrame:
        return self._table("companies", schemas.COMPANIES)

    @cached_property
    def patent_inventor(self) -> DataFrame:
        return self._table("patent_inventor", schemas.PATENT_INVENTOR)

    @cached_property
    def patent_company(self) -> DataFrame:
        return self._table("patent_company", schemas.PATENT_COMPANY)

    @cached_property
    def numbered_relationships(self) -> DataFrame:
        return self._table("relationships", schemas.RELATIONSHIPS)

    def relationships(self) -> DataFrame:
        return self.numbered_relationships.drop("id")


def load_patents(patents: DataFrame) -> DataFrame:
    """Titled patents, one row per id."""
    titled = patents.where(F.col("title").isNotNull()).drop("year")
    first = keep_first(titled, "patent_id", _PATENT_ORDER, by_column=True)
    return first.withColumn("year", F.year("filing_date")).select(*schemas.PATENTS.names)


def load_relationships(
    patent_inventor: DataFrame,
    patent_company: DataFrame,
    inventors: DataFrame,
    companies: DataFrame,
    patents: DataFrame | None = None,
    with_id: bool = True,
) -> DataFrame:
    """The relationships table with its foreign keys repaired.

    Keys are repaired in the pairs, before a patent's inventors are multiplied
    by its companies; the rows are the same as when repaired after. ``patents``
    is needed where the pairs may hold patents that were not loaded. The repaired pairs are
    written to scratch, as the pairing reads each table three times.
    """
    if patents is not None:
        patents = materialize(patents.select("patent_id"), "patent_ids")
        # The pairs may stand grouped by patent; only a fresh exchange can be split at a hot one.
        patent_inventor = keep_valid_patents(fresh_key(patent_inventor, "patent_id"), patents)
        patent_company = keep_valid_patents(fresh_key(patent_company, "patent_id"), patents)
    pi = null_out_orphans(patent_inventor, "inventor_id", inventors)
    pc = null_out_orphans(patent_company, "company_id", companies)
    pairs = pair_per_patent(*materialize_together((pi, "patent_inventor"), (pc, "patent_company")))
    return surrogate_id(pairs, *RELATIONSHIP_ORDER) if with_id else pairs


def _unique_patents(cleaned: DataFrame) -> DataFrame:
    """``load_patents`` for a load step: only patents whose id repeats are shuffled with their text.

    The repeated ids are written first. Spark then knows the size of that table
    and decides by it whether the other patents need a shuffle at all.
    """
    titled = cleaned.where(F.col("title").isNotNull())
    repeated = materialize(check_unique_key(titled, "patent_id").select("patent_id"), "repeated_ids")
    if repeated.isEmpty():
        return titled
    once = titled.join(repeated, "patent_id", "left_anti")
    return once.unionByName(load_patents(titled.join(repeated, "patent_id", "left_semi")))


def _store(df: DataFrame, root: str, name: str, schema: StructType) -> None:
    align_to_schema(df, schema).write.mode("overwrite").parquet(f"{root}/{name}")


def build_star(
    spark: SparkSession,
    raw: RawTables,
    root: str,
    names: Names = None,
    rows: int | None = None,
    relationships: bool = True,
) -> StoredStar:
    """Write every table of the star once, in dependency order, and return the star that reads them.

    Each step reads the tables written before it, so nothing is computed twice
    and a lost executor repeats one step only. Patents are laid out by year; the
    rebalance hint spreads a year that holds a large part of the rows over
    several files.
    """
    source, star = RawStar(raw, names, rows), StoredStar(spark, root)

    def write_patents() -> None:
        patents = align_to_schema(_unique_patents(source.cleaned_patents), schemas.PATENTS)
        patents.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(f"{root}/patents")

    def write_inventor_pairs() -> None:
        pairs = null_out_orphans(source.inventor_pairs(star.patents), "inventor_id", star.inventors)
        _store(pairs, root, "patent_inventor", schemas.PATENT_INVENTOR)

    def write_company_pairs() -> None:
        pairs = null_out_orphans(source.company_pairs(star.patents), "company_id", star.companies)
        _store(pairs, root, "patent_company", schemas.PATENT_COMPANY)

    with scratch_area(spark):
        run_together(
            spark,
            write_patents,
            lambda: _store(source.inventors, root, "inventors", schemas.INVENTORS),
            lambda: _store(source.companies, root, "companies", schemas.COMPANIES),
        )
        run_together(spark, write_inventor_pairs, write_company_pairs)
        if relationships:
            pairs = pair_per_patent(star.patent_inventor, star.patent_company)
            # The ids need to be dense and unique only: numbered as they come, the product is written twice and not sorted.
            _store(surrogate_id(pairs), root, "relationships", schemas.RELATIONSHIPS)
    return star
