"""A corpus pipeline: quality, toxicity, near-duplicates, and packing of what is left.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`, which has the
columns of documents. The filters keep every column and order nothing. Null and empty
texts pass the filters unless the models say otherwise, link as texts without words, and
are packed as one token. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grantmill.llm import quality, simhash, toxicity
from grantmill.llm.common import table
from grantmill.llm.queries import packed_pieces
from grantmill.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer, trained on their own weak labels, accepts."""
    return quality.keep_good(docs, quality.fit(docs), threshold=0.5)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression distance does not speak for toxic text."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, threshold=0.3)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packed_pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("toxicity", not_toxic),
    ("simhash_near_duplicates", one_of_each_group),
    ("best_fit_packing", packed),
]

# No SQL: the stages learn models and hash text in ways DuckDB has no functions for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
