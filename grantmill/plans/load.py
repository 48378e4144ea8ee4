"""Loads of a star that replace it, or add to it, all or nothing, and report every row.

A store is a folder per table with a folder per load, and a log of manifests. A load writes
into folders of its own; the manifest that names the loads of the star is written last, so
readers see the star before a load or after it, never half of it. A failed load leaves
folders that no manifest names.

A replacing load starts a star anew. An added load holds only what the star did not have:
patents that are not known yet, with all their pairs, and new inventors and companies.
So a patent belongs to one load, counts of loads add up exactly, and adding the same batch
again changes nothing.

Every raw row has an outcome: kept, or rejected with a reason. Outcomes are counted by
the very write that stores the rows, and rejected rows stay readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill import schemas
from grantmill.operators.columns import align_to_schema, pick_column
from grantmill.operators.integrity import check_unique_key, surrogate_id
from grantmill.operators.joins import fresh_key, lookup_left, pair_per_patent
from grantmill.plans.clean import COMPANY_ID, INVENTOR_ID, KEPT_TYPES, Names, typed_patents
from grantmill.plans.reports import company_counts_by_year
from grantmill.plans.star import RawStar, RawTables, StoredStar
from grantmill.session import delete_path, list_folder, make_folder, materialize, run_together, scratch_area, shuffles_dropped

KEPT, REJECTED = "kept", "rejected"
# Reasons in the order they are asked; a row has the first that holds.
PATENT_REASONS = ("no_id", "no_date", "other_type", "untitled", "known", "repeated")
PAIR_REASONS = ("no_id", "unknown_patent", "repeated")
# Kept pairs whose entity is not there: their id is set to null.
ORPHANED = "orphaned"

ROUTED = ("patents", "patent_inventor", "patent_company")
COUNTS = {
    "year_counts": "year int, patent_count long",
    "company_year_counts": "year int, company string, patent_count long",
}
_MANIFEST = "version long, loads array<string>, relationships long, report array<struct<table: string, outcome: string, row_count: long>>"
# Versions and rejected rows stay on disk, so they are stored smaller than by Spark's default.
_STORED = {"compression": "zstd"}
_PATENT_ORDER = ("filing_date", "patent_type", "wipo_kind", "title", "abstract")


@dataclass(frozen=True)
class Manifest:
    """What the newest version of a star consists of."""

    version: int = 0
    loads: tuple[str, ...] = ()
    relationships: int = 0
    report: tuple[tuple[str, str, int], ...] = ()


def newest_manifest(spark: SparkSession, root: str) -> Manifest:
    """The manifest written last; an empty one for a star that was never loaded."""
    path = f"{root}/manifests"
    if not list_folder(spark, path):
        return Manifest()
    rows = spark.read.schema(_MANIFEST).json(path).orderBy(F.desc("version")).limit(1).collect()
    if not rows:
        return Manifest()
    row = rows[0]
    return Manifest(row.version, tuple(row.loads), row.relationships, tuple(tuple(r) for r in row.report))


class VersionedStar(StoredStar):
    """One version of a loaded star: its tables are those of its loads together."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest | None = None):
        super().__init__(spark, root)
        self.manifest = newest_manifest(spark, root) if manifest is None else manifest

    def _stored(self, name: str, schema: T.StructType, outcome: str | None = None) -> DataFrame:
        if not self.manifest.loads:
            return self._spark.createDataFrame([], schema)
        table, below = f"{self._root}/{name}", f"/outcome={outcome}" if outcome else ""
        paths = [f"{table}/load={load}{below}" for load in self.manifest.loads]
        return self._spark.read.option("basePath", table).schema(schema).parquet(*paths).select(*schema.names)

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        return self._stored(name, schema, KEPT if name in ROUTED else None)

    def kept_counts(self, name: str) -> DataFrame | None:
        return self._table(name, T.StructType.fromDDL(COUNTS[name]))

    def rejected(self, name: str) -> DataFrame:
        """The rejected rows of a table's loads with their reason; pairs also with their number."""
        added = [T.StructField("reason", T.StringType())]
        if name != "patents":
            added.append(T.StructField("row_count", T.LongType()))
        given = {"patents": schemas.PATENTS, "patent_inventor": schemas.PATENT_INVENTOR, "patent_company": schemas.PATENT_COMPANY}[name]
        schema = T.StructType([*given.fields, *added])
        return self._stored(name, schema, REJECTED)

    @cached_property
    def load_report(self) -> DataFrame:
        """``(table, outcome, row_count)`` of the last load."""
        return self._spark.createDataFrame(list(self.manifest.report), "table string, outcome string, row_count long")


def _first_reason(cases: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(case, F.lit(reason)) for reason, case in cases.items()])


def route_patents(raw: DataFrame, known: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Every raw patent, typed, with the reason for its rejection; null for the one row of each id that is kept.

    Patents of the table ``known`` were loaded before. Only patents whose id repeats are shuffled with their text, and their first row is
    found by a combined minimum over numbered rows, so that a very frequent id is no one
    task's work.
    """
    typed = typed_patents(raw, rows)
    reason = _first_reason(
        {
            "no_id": F.col("patent_id").isNull(),
            "no_date": F.col("filing_date").isNull(),
            "other_type": ~F.col("patent_type").isin(*KEPT_TYPES),
            "untitled": F.col("title").isNull(),
        }
    )
    typed = typed.withColumn("reason", reason)
    fit = typed.where(F.col("reason").isNull())
    flags = check_unique_key(fit, "patent_id").select("patent_id", F.lit(True).alias("_repeats"), F.lit(None).cast("boolean").alias("_known"))
    if known is not None:
        flags = flags.unionByName(_known_ids(fit, known))
    flags = flags.groupBy("patent_id").agg(F.max("_repeats").alias("_repeats"), F.max("_known").alias("_known"))
    # Written, so that Spark knows its size and decides by it whether the texts need a shuffle.
    flags = materialize(flags, "flagged_ids")
    flagged = lookup_left(typed, flags, "patent_id", spread_by="title")
    is_fit, is_known, repeats = F.col("reason").isNull(), F.col("_known").isNotNull(), F.col("_repeats").isNotNull()
    again = is_fit & ~is_known & repeats
    told = F.when(is_fit & is_known, F.lit("known")).otherwise(F.col("reason"))
    once = flagged.where(~again).withColumn("reason", told).select(*typed.columns)
    if flags.where("_known IS NULL AND _repeats").isEmpty():
        return once
    several = materialize(flagged.where(again).withColumn("_row", F.monotonically_increasing_id()), "repeated_patents")
    order = [x for c in _PATENT_ORDER for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    first = several.groupBy("patent_id").agg(F.min(F.struct(*order, "_row"))["_row"].alias("_row")).select("_row", F.lit(True).alias("_first"))
    placed = several.join(first, "_row", "left").withColumn("reason", F.when(F.col("_first").isNull(), F.lit("repeated")))
    return once.unionByName(placed.select(*typed.columns))


def _known_ids(fit: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of the batch that were loaded before: (patent_id, _repeats, _known).

    The ids of a batch lie close together; row groups of the star beyond them are not read.
    """
    low, high = fit.agg(F.min("patent_id"), F.max("patent_id")).first()
    near = known.select("patent_id").where(F.col("patent_id").between(low, high) if low is not None else F.lit(False))
    stored = fit.select("patent_id").distinct().join(fresh_key(near, "patent_id"), "patent_id", "left_semi")
    return stored.select("patent_id", F.lit(None).cast("boolean").alias("_repeats"), F.lit(True).alias("_known"))


def route_pairs(raw: DataFrame, candidates: Sequence[str], key: str, patents: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct pairs of the load's patents, kept or rejected: (patent_id, key, reason, row_count).

    Kept rows have no reason, but ``orphaned`` where the entity is not there and their id is
    now null. Further rows of a kept pair are one rejected row with their number.
    """
    pairs = raw.select("patent_id", F.col(pick_column(raw, candidates)).alias(key))
    loaded = patents.select("patent_id").withColumn("_loaded", F.lit(True))
    there = entities.select(key).withColumn("_there", F.lit(True))
    found = lookup_left(pairs, loaded, "patent_id", spread_by=key, keep_as="_patent")
    # Equal pairs stand together after the lookup, so they are counted without another exchange.
    grouped = found.groupBy("_patent", "patent_id", key).agg(F.count("*").alias("rows"), F.max("_loaded").alias("_loaded"))
    found = lookup_left(fresh_key(grouped.drop("_patent"), key), there, key, spread_by="patent_id")
    reason = _first_reason({"no_id": F.col("patent_id").isNull() | F.col(key).isNull(), "unknown_patent": F.col("_loaded").isNull()})

    def row(entity: Column, why: Column, rows: Column) -> Column:
        return F.struct(entity.alias(key), why.cast("string").alias("reason"), rows.cast("long").alias("row_count"))

    orphaned = F.when(F.col("_there").isNull(), F.lit(ORPHANED))
    kept = row(F.when(F.col("_there"), F.col(key)), orphaned, F.lit(1))
    more = F.when(F.col("rows") > 1, row(F.col(key), F.lit("repeated"), F.col("rows") - 1))
    told = F.when(F.col("_why").isNull(), F.array_compact(F.array(kept, more))).otherwise(F.array(row(F.col(key), F.col("_why"), F.col("rows"))))
    return found.withColumn("_why", reason).select("patent_id", F.inline(told))


def _write_routed(df: DataFrame, path: str, table: str, reasons: Sequence[str], rows: Column, by: Sequence[str] = ()) -> list[tuple[str, str, int]]:
    """Store rows by outcome and return how many rows had which, counted by the write.

    Rows laid out by further columns are shuffled once more for it; others are written as they come.
    """
    outcome = F.when(F.col("reason").isNull() | (F.col("reason") == ORPHANED), F.lit(KEPT)).otherwise(F.lit(REJECTED))
    seen = Observation()
    named = F.coalesce("reason", F.lit(KEPT))
    counts = [F.coalesce(F.sum(F.when(named == r, rows)), F.lit(0)).cast("long").alias(r) for r in (KEPT, *reasons)]
    placed = df.withColumn("outcome", outcome).observe(seen, *counts)
    (placed.hint("rebalance", "outcome", *by) if by else placed).write.options(**_STORED).partitionBy("outcome", *by).parquet(path)
    # Both outcomes can be read, also where no row has one of them.
    for folder in (KEPT, REJECTED):
        make_folder(df.sparkSession, f"{path}/outcome={folder}")
    found = _observed(seen)
    return [(table, r, found.get(r, 0)) for r in (KEPT, *reasons)]


def _observed(seen: Observation) -> dict[str, int]:
    """What a write has observed. Spark leaves the observation out of a plan that it finds to be empty."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def _load(spark: SparkSession, raw: RawTables, root: str, names: Names, rows: int | None, base: Manifest, add: bool) -> VersionedStar:
    load = uuid.uuid4().hex
    source = RawStar(raw, names, rows)
    before = VersionedStar(spark, root, base if add else Manifest())
    alone = VersionedStar(spark, root, Manifest(loads=(load,)))
    after = VersionedStar(spark, root, Manifest(base.version + 1, (*before.manifest.loads, load)))
    report: list[tuple[str, str, int]] = []

    def path(table: str) -> str:
        return f"{root}/{table}/load={load}"

    def write_patents() -> None:
        routed = route_patents(raw.raw_patent, before.patents if before.manifest.loads else None, rows)
        report.extend(_write_routed(routed, path("patents"), "patents", PATENT_REASONS, F.lit(1), by=["year"]))

    def write_new(entities: DataFrame, stored: DataFrame, table: str, key: str) -> None:
        new = entities.join(fresh_key(stored.select(key), key), key, "left_anti") if add else entities
        align_to_schema(new, schemas.TARGETS[table]).write.options(**_STORED).parquet(path(table))

    def write_pairs(table: str, given: DataFrame | None, other: DataFrame, candidates: Sequence[str], key: str, entities: DataFrame) -> None:
        routed = route_pairs(other if given is None else given, candidates, key, alone.patents, entities)
        reasons = (*PAIR_REASONS, ORPHANED)
        report.extend(_write_routed(routed, path(table), table, reasons, F.col("row_count")))

    with scratch_area(spark), shuffles_dropped(spark):
        run_together(
            spark,
            write_patents,
            lambda: write_new(source.inventors, before.inventors, "inventors", "inventor_id"),
            lambda: write_new(source.companies, before.companies, "companies", "company_id"),
        )
        # These are a load's largest shuffles; one after the other, only one table's are on disk at a time.
        write_pairs("patent_inventor", raw.raw_patent_inventor, raw.raw_inventor, INVENTOR_ID, "inventor_id", after.inventors)
        write_pairs("patent_company", raw.raw_patent_assignee, raw.raw_assignee, COMPANY_ID, "company_id", after.companies)
        numbered = surrogate_id(pair_per_patent(alone.patent_inventor, alone.patent_company))
        seen = Observation()
        moved = numbered.withColumn("id", F.col("id") + before.manifest.relationships).observe(seen, F.count("*").alias("rows"))
        align_to_schema(moved, schemas.RELATIONSHIPS).write.options(**_STORED).parquet(path("relationships"))
        yearly = alone.patents.where(F.col("year").isNotNull()).groupBy("year").agg(F.count("*").alias("patent_count"))
        yearly.write.options(**_STORED).parquet(path("year_counts"))
        _company_years(alone, after).write.options(**_STORED).parquet(path("company_year_counts"))
    made = _observed(seen).get("rows", 0)
    report.append(("relationships", KEPT, made))
    done = Manifest(base.version + 1, after.manifest.loads, before.manifest.relationships + made, tuple(sorted(report)))
    _publish(spark, root, done)
    return VersionedStar(spark, root, done)


class _LoadOnly(StoredStar):
    """The patents and pairs of one load with the companies of the whole star."""

    def __init__(self, load: VersionedStar, star: VersionedStar):
        self.patents, self.patent_company, self.companies = load.patents, load.patent_company, star.companies


def _company_years(load: VersionedStar, star: VersionedStar) -> DataFrame:
    return company_counts_by_year(_LoadOnly(load, star), 0, 9999)


def _publish(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Name the loads of the new version. This one small file is the moment at which readers see it."""
    row = (manifest.version, list(manifest.loads), manifest.relationships, list(manifest.report))
    if newest_manifest(spark, root).version >= manifest.version:
        raise RuntimeError(f"another load of {root} was published meanwhile")
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifests")


def replace_star(spark: SparkSession, raw: RawTables, root: str, names: Names = None, rows: int | None = None) -> VersionedStar:
    """Load a star anew. Readers have the old one until the last table is written."""
    return _load(spark, raw, root, names, rows, newest_manifest(spark, root), add=False)


def add_to_star(spark: SparkSession, raw: RawTables, root: str, names: Names = None) -> VersionedStar:
    """Add the patents of a batch that the star does not have, with their pairs, and new inventors and companies.

    A batch holds all pairs of its patents. Rows of patents that were loaded before are
    rejected as ``known``, so that adding a batch again changes no report. Entities keep
    the name and country they were first loaded with.
    """
    return _load(spark, raw, root, names, None, newest_manifest(spark, root), add=True)


def drop_old_loads(spark: SparkSession, root: str) -> None:
    """Delete the folders of loads that the newest version does not name: replaced and failed ones.

    For a time when no reader of an older version and no load is at work.
    """
    used = {f"load={load}" for load in newest_manifest(spark, root).loads}
    for table in (*schemas.TARGETS, "patent_inventor", "patent_company", *COUNTS):
        for folder in list_folder(spark, f"{root}/{table}"):
            if folder.rpartition("/")[2] not in used:
                delete_path(spark, folder)
