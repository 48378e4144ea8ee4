"""A star whose patents and pairs stand in buckets by patent, joined bucket by bucket.

The tables are written once by the same buckets and sorted by patent, so that joins by
patent read them side by side without an exchange. A bucket is one task's work, which a
patent with very many pairs would make unbounded. Patents with a share of at least one
in `HOT_SHARE` of a pair table, at most twice that many, stand in tables of their own, without
buckets; their joins are those that can be split.
"""

from __future__ import annotations

import hashlib
import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantmill import schemas
from grantmill.operators.ranking import checked_size
from grantmill.plans.star import Star, StoredStar, detail_of
from grantmill.session import materialize, scratch_area

HOT_SHARE = 1024
PAIRS_OF_A_BUCKET = 1 << 22
TABLES = {"patents": schemas.PATENTS, "patent_inventor": schemas.PATENT_INVENTOR, "patent_company": schemas.PATENT_COMPANY}


class BucketedStar(StoredStar):
    """The star written by ``bucket_star``; inventors and companies are those of the star it came from."""

    def __init__(self, spark: SparkSession, root: str, base: Star):
        super().__init__(spark, root)
        self._base = base
        self.buckets = spark.read.json(f"{root}/layout").first()["buckets"]

    def in_buckets(self, name: str) -> DataFrame:
        """The rows of a table that stand in buckets.

        Spark takes the layout from its catalog. The files are not the catalog's: any
        session names them anew.
        """
        table = _table_name(self._root, name)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[name].fields)
        self._spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (patent_id) "
            f"SORTED BY (patent_id) INTO {int(self.buckets)} BUCKETS LOCATION '{self._root}/{name}'"
        )
        return self._spark.table(table)

    def hot(self, name: str) -> DataFrame:
        return self._spark.read.schema(TABLES[name]).parquet(f"{self._root}/hot/{name}")

    def _whole(self, name: str) -> DataFrame:
        return self.in_buckets(name).unionByName(self.hot(name))

    @cached_property
    def patents(self) -> DataFrame:
        return self._whole("patents")

    @cached_property
    def patent_inventor(self) -> DataFrame:
        return self._whole("patent_inventor")

    @cached_property
    def patent_company(self) -> DataFrame:
        return self._whole("patent_company")

    @cached_property
    def inventors(self) -> DataFrame:
        return self._base.inventors

    @cached_property
    def companies(self) -> DataFrame:
        return self._base.companies

    def relationships(self) -> DataFrame:
        return self._base.relationships()

    def kept_counts(self, name: str) -> DataFrame | None:
        return self._base.kept_counts(name)

    def detail_ids(self) -> DataFrame:
        patents = self.in_buckets("patents").select("patent_id", "title", "year")
        found = patents.join(self.in_buckets("patent_inventor"), "patent_id", "left")
        found = found.join(self.in_buckets("patent_company"), "patent_id", "left")
        return found.unionByName(detail_of(*(self.hot(name) for name in TABLES)))


def _table_name(root: str, name: str) -> str:
    return f"grantmill_{name}_{hashlib.sha256(root.encode()).hexdigest()[:16]}"


def bucket_star(star: Star, root: str, buckets: int | None = None) -> BucketedStar:
    """Write a star's patents and pairs in buckets by patent; ``root`` is a folder that holds nothing yet.

    Without a number, there are so many buckets that one has some million pairs.
    """
    if not star.resolved:
        raise ValueError("a star in buckets is written from a stored one")
    spark = star.patents.sparkSession
    given = {"patents": star.patents, "patent_inventor": star.patent_inventor, "patent_company": star.patent_company}
    with scratch_area(spark):
        pairs = [given[name].groupBy("patent_id").agg(F.count("*").alias("n")) for name in ("patent_inventor", "patent_company")]
        counted = [materialize(p, "pairs_of_patents") for p in pairs]
        totals = [c.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for c in counted]
        n = checked_size(max(1, math.ceil(sum(totals) / PAIRS_OF_A_BUCKET)) if buckets is None else buckets, 1)
        often = [c.where(F.col("n") * HOT_SHARE >= max(total, HOT_SHARE)) for c, total in zip(counted, totals, strict=True)]
        # At most HOT_SHARE patents of each table have so large a share of it.
        hot = F.broadcast(materialize(often[0].select("patent_id").union(often[1].select("patent_id")).distinct(), "hot_patents"))
        for name, schema in TABLES.items():
            rows = given[name].select(*schema.names)
            placed = rows.join(hot, "patent_id", "left_anti").select(*schema.names).repartition(n, "patent_id").sortWithinPartitions("patent_id")
            writer = placed.write.format("parquet").mode("overwrite").bucketBy(n, "patent_id").sortBy("patent_id")
            writer.option("path", f"{root}/{name}").saveAsTable(_table_name(root, name))
            rows.join(hot, "patent_id", "left_semi").select(*schema.names).write.parquet(f"{root}/hot/{name}")
        spark.range(1).select(F.lit(n).alias("buckets")).coalesce(1).write.json(f"{root}/layout")
    return BucketedStar(spark, root, star)
