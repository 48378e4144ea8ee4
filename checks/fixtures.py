"""Raw patent tables derived from the given tables.

Each text runs unchanged in Spark and in the SQL oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from grantmill.operators.joins import pair_per_patent
from grantmill.plans import clean, star
from grantmill.session import scratch_path, tune
from grantmill.sources.writers import write_raw

RAW_LOCATION = """
SELECT concat('loc-', CAST(n_nationkey AS STRING)) AS location_id,
       CASE n_nationkey WHEN 0 THEN 'US' WHEN 1 THEN 'JP' WHEN 2 THEN 'DE' WHEN 3 THEN 'CN'
            WHEN 4 THEN 'KR' WHEN 5 THEN 'FR' WHEN 6 THEN 'CA' WHEN 7 THEN 'GB' WHEN 8 THEN 'TW'
            WHEN 9 THEN 'IN' WHEN 10 THEN ' us ' WHEN 11 THEN 'Brazil' WHEN 12 THEN 'XX'
            WHEN 13 THEN NULL WHEN 14 THEN '' WHEN 15 THEN 'NEW ZEALAND' WHEN 16 THEN 'unknown'
            ELSE n_name END AS disambig_country
FROM {nation}
"""

RAW_PATENT = """
SELECT CAST(coalesce(o_orderkey, doc_id) AS STRING) AS patent_id,
       coalesce(split_part(d.text, chr(10), 1), o_orderpriority) AS patent_title,
       d.text AS patent_abstract,
       CASE WHEN o_orderkey IS NULL THEN CAST(DATE '2001-01-01' + CAST(doc_id % 7000 AS INTEGER) AS STRING)
            WHEN o_orderkey % 97 = 0 THEN 'not-a-date'
            WHEN o_orderkey % 101 = 0 THEN NULL
            WHEN o_orderkey % 10 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
            ELSE CAST(CAST(o_orderdate + INTERVAL '20' YEAR AS DATE) AS STRING) END AS patent_date,
       CASE WHEN o_orderstatus = 'P' THEN 'design' WHEN o_orderstatus = 'F' THEN 'utility'
            WHEN o_orderkey % 2 = 0 THEN ' Reissue ' ELSE NULL END AS patent_type,
       substr(o_orderpriority, 1, 1) AS wipo_kind
FROM {orders} FULL JOIN {documents} d ON d.doc_id = o_orderkey
"""

RAW_INVENTOR = """
SELECT CAST(l_orderkey AS STRING) AS patent_id,
       CASE WHEN l_orderkey % 23 <> 0 THEN concat('inv-', CAST(l_partkey AS STRING)) END AS inventor_id,
       CASE WHEN l_partkey % 50 = 0 THEN 'X' ELSE concat(' ', p_name) END AS disambig_inventor_name_first,
       CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE p_type END AS disambig_inventor_name_last,
       CASE WHEN l_partkey % 11 = 0 THEN 'se' WHEN l_partkey % 13 = 0 THEN '  ' ELSE NULL END AS inventor_country,
       CASE WHEN l_partkey % 29 = 0 THEN NULL
            ELSE concat('loc-', CAST(l_partkey % 27 AS STRING)) END AS location_id
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
"""

RAW_ASSIGNEE = """
SELECT CAST(l_orderkey AS STRING) AS patent_id,
       CASE WHEN l_linenumber <= 2 THEN concat('org-', CAST(l_suppkey AS STRING)) END AS assignee_id,
       CASE WHEN l_suppkey % 33 = 0 THEN NULL
            ELSE concat(' Group ', CAST(l_suppkey % 40 AS STRING)) END AS disambig_assignee_organization,
       concat('loc-', CAST(s_nationkey AS STRING)) AS location_id
FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey
"""

# Entities with another name, country and place in every row; the files hold the rows in the order of the places.
_CODES = "AT,AU,BE,BR,CA,CH,CN,CZ,DE,DK,ES,FI,FR,GB,HU,IE,IL,IN,IT,JP,KR,LU,MX,MY,NL,NO,NZ,PL,PT,RU,SA,SE,SG,TH,TW,UA,US,VN,ZA,QQ"
RAW_SPELLING = f"""
SELECT l_orderkey AS place_1, l_linenumber AS place_2, l_partkey AS place_3, l_suppkey AS place_4, CAST(l_orderkey AS STRING) AS patent_id,
       concat('inv-', CAST(l_partkey AS STRING)) AS inventor_id,
       CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 'Q' ELSE concat('First', chr(10), CAST(l_orderkey AS STRING)) END
         AS disambig_inventor_name_first,
       CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN NULL ELSE concat('"Last" ', CAST(l_linenumber AS STRING)) END
         AS disambig_inventor_name_last,
       CASE WHEN l_orderkey % 2 = 0 THEN split_part('{_CODES}', ',', CAST(l_linenumber * 7 % 40 AS INTEGER) + 1) WHEN l_orderkey % 3 = 0 THEN 'kr' END
         AS inventor_country,
       concat('org-', CAST(l_suppkey AS STRING)) AS assignee_id,
       CASE WHEN l_orderkey % 5 = 0 THEN 'Z' WHEN l_orderkey % 7 = 0 THEN NULL ELSE concat('Group ', CAST(l_orderkey AS STRING)) END
         AS disambig_assignee_organization,
       CASE WHEN l_orderkey % 3 = 0 THEN lower(split_part('{_CODES}', ',', CAST(l_partkey % 40 AS INTEGER) + 1)) WHEN l_orderkey % 3 = 1 THEN 'Brazil' END
         AS assignee_country,
       concat('loc-', CAST(l_suppkey % 97 AS STRING)) AS location_id,
       CASE l_orderkey % 6 WHEN 1 THEN NULL WHEN 2 THEN concat('Land ', CAST(l_orderkey AS STRING))
         ELSE split_part('{_CODES}', ',', CAST(l_suppkey % 40 AS INTEGER) + 1) END
         AS disambig_country
FROM {{lineitem}}
"""

# Patents without ids or titles, and with ids that repeat.
RAW_MESSY = """
SELECT CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS patent_id,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE concat(copy, ' ', o_orderpriority) END AS patent_title,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS patent_abstract,
       CASE WHEN o_orderkey % 29 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS patent_date,
       CASE WHEN o_orderstatus = 'P' THEN 'design' ELSE 'Utility' END AS patent_type, substr(o_orderpriority, 1, 1) AS wipo_kind
FROM (SELECT *, 'b' AS copy FROM {orders} UNION ALL SELECT *, 'a' FROM {orders} WHERE o_orderkey % 3 = 0
      UNION ALL SELECT *, 'c' FROM {orders} WHERE o_orderkey % 9 = 0)
"""

RAW_TABLES = {
    "raw_location": (RAW_LOCATION, ("nation",)),
    "raw_patent": (RAW_PATENT, ("orders", "documents")),
    "raw_inventor": (RAW_INVENTOR, ("lineitem", "part")),
    "raw_assignee": (RAW_ASSIGNEE, ("lineitem", "supplier")),
    "raw_spelling": (RAW_SPELLING, ("lineitem",)),
    "raw_messy": (RAW_MESSY, ("orders",)),
}


class Fixtures:
    """Raw, cleaned and loaded tables over one data folder, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir
        self._given: dict[str, DataFrame] = {}

    def given(self, name: str) -> DataFrame:
        if name not in self._given:
            self._given[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._given[name]

    def raw(self, name: str) -> DataFrame:
        text, tables = RAW_TABLES[name]
        return self.spark.sql(text, **{t: self.given(t) for t in tables})

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    def raw_file(self, name: str) -> str:
        """The raw table as tab-separated files."""
        return write_raw(self.raw(name), self.scratch(f"{name}.tsv"))

    def spelling_file(self, *columns: str) -> str:
        """Columns of the table of spellings as files that hold its rows in order."""
        place = [f"place_{i}" for i in (1, 2, 3, 4)]
        placed = self.raw("raw_spelling").repartitionByRange(*place).sortWithinPartitions(*place)
        return write_raw(placed.select(*columns), self.scratch("spellings.tsv"))

    @cached_property
    def raw_location(self) -> DataFrame:
        return self.raw("raw_location")

    @cached_property
    def raw_patent(self) -> DataFrame:
        return self.raw("raw_patent")

    @cached_property
    def raw_inventor(self) -> DataFrame:
        return self.raw("raw_inventor")

    @cached_property
    def raw_assignee(self) -> DataFrame:
        return self.raw("raw_assignee")

    @cached_property
    def clean_patents(self) -> DataFrame:
        return clean.clean_patents(self.raw_patent)

    @cached_property
    def clean_locations(self) -> DataFrame:
        return clean.clean_locations(self.raw_location)

    @cached_property
    def clean_patent_inventor(self) -> DataFrame:
        return clean.clean_patent_inventor(self.raw_inventor, self.clean_patents)

    @cached_property
    def clean_patent_company(self) -> DataFrame:
        return clean.clean_patent_company(self.raw_assignee, self.clean_patents)

    @cached_property
    def clean_relationships(self) -> DataFrame:
        return pair_per_patent(self.clean_patent_inventor, self.clean_patent_company)

    def batch(self, which: str) -> star.RawTables:
        """The raw tables of the patents for which the condition holds."""
        patent = f"CAST(patent_id AS BIGINT) {which}"
        tables = (self.raw_patent, self.raw_inventor, self.raw_assignee)
        return star.RawTables(*[t.where(patent) for t in tables], self.raw_location)

    raw_patent_inventor = None
    raw_patent_assignee = None

    @cached_property
    def star(self) -> star.Star:
        return star.RawStar(self)

    @cached_property
    def target_tables(self) -> dict[str, DataFrame]:
        s = self.star
        return {
            "patents": s.patents,
            "inventors": s.inventors,
            "companies": s.companies,
            "relationships": s.relationships(),
        }
