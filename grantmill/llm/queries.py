"""One query per operator over its whole table, with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantmill.llm import bpe, copies, licenses, lm, packing, phrases, quality, simhash, spelling, toxicity, vectors
from grantmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD_VOCABULARY = "word_bpe_49k.json"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op2_bpe_roundtrip")
def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded, as digests of the ids and of the decoded text."""
    vocab = bpe.load(spark, public_tokenizers.path(WORD_VOCABULARY))
    return bpe.roundtrip(table(spark, sf_dir, "documents"), vocab)


@query("op7_token_counts")
def token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than `limit` tokens."""
    vocab = bpe.load(spark, public_tokenizers.path(WORD_VOCABULARY))
    counted = bpe.count_tokens(table(spark, sf_dir, "documents"), vocab)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op9_simhash_near_duplicates")
def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest document it is linked to."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Every document's pieces of at most 4096 tokens and their places in sequences."""
    vocab = bpe.load(docs.sparkSession, public_tokenizers.path(WORD_VOCABULARY))
    pieces = packing.cut(docs, vocab, limit=4096, end_id=1)
    digested = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digested, limit=4096)


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def _remainder(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


@query("op10_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a quarter of the labels is never learned from."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=_remainder() != 2)
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op6_quality_classifier")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the scorer that the documents' own weak labels train."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs)).withColumn("kept", F.col("score") >= 0.5)


@query("op3_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and lines of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    places = F.flatten(F.transform("hits", lambda h: h["places"]))
    based = F.filter("hits", lambda h: F.size(h["places"]) > 0)

    def joined(hits: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(based).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["containment"])), F.lit(0.0)).alias("score"),
    )


@query("op4_embedding_near_duplicates")
def embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more among all vectors, and one kept of each group."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


TOP_K_SQL = """
WITH valid AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.place AS query_place, q.vec_id AS query_id, c.vec_id AS vec_id, c.place AS place,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.place <> c.place AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_place ORDER BY score DESC, vec_id, place) AS rank FROM scored
) WHERE rank <= 10
"""


@query("op8_exact_top_k", TOP_K_SQL)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others."""
    return vectors.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


@query("op1_lm_cross_entropy")
def lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's losses under a model of the documents labelled good and one of all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return lm.score_background(table(spark, sf_dir, "documents"), good)


COPIES_SQL = r"""
WITH normal AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM normal WINDOW same AS (PARTITION BY text_sha256)
"""


@query("op12_exact_dedup", COPIES_SQL)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its exact copies."""
    return copies.group_copies(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, each with its near words' number, its form and its root."""
    counted = spelling.count_words(table(spark, sf_dir, "documents"), letters="A-Za-z\u00C0-\u00FF", least=7)
    return spelling.variants(counted, least=7, ratio=10)


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, piece, unnest(list_filter(string_split_regex(part, '[\x20\x09]+'), lambda w: w <> '')) AS word,
         generate_subscripts(list_filter(string_split_regex(part, '[\x20\x09]+'), lambda w: w <> ''), 1) AS place
  FROM (SELECT lang, part, row_number() OVER () AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
    FROM documents))
), totals AS (SELECT lang, count(*) AS n FROM pieces GROUP BY lang),
windows AS (
  SELECT lang, array_agg(word) OVER (PARTITION BY piece ORDER BY place
                                     ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS words
  FROM pieces
), f AS (
  SELECT lang, words, count(*) AS f FROM (
    SELECT lang, words[1:k] AS words FROM windows, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(words) >= k)
  GROUP BY lang, words HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.words, c.f AS a, k, l.f AS l, r.f AS r, n,
         (1000 * CAST(c.f AS HUGEINT) * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM f c JOIN totals t ON t.lang = c.lang, (SELECT unnest([1, 2, 3, 4]) AS k)
  JOIN f l ON l.lang = c.lang AND l.words = c.words[1:k]
  JOIN f r ON r.lang = c.lang AND r.words = c.words[k + 1:]
  WHERE len(c.words) > k
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f w, (SELECT unnest([1, 2, 3, 4]) AS s)
    WHERE w.lang = b.lang AND len(w.words) > len(b.words) AND s + len(b.words) - 1 <= len(w.words)
      AND w.words[s:s + len(b.words) - 1] = b.words AND 100 * w.f >= 100 * b.a)
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
  FROM (SELECT *, array_to_string(words, ' ') AS phrase FROM kept)
) WHERE rank <= 2000
"""


@query("op13_phrase_collocations", PHRASES_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to five words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000, covered=100)
