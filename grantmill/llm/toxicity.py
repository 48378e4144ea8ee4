"""Toxicity by compression distance: one zstandard dictionary of ordinary and one of toxic text.

A text is cut into windows of words. Every word stands as fixed-width codes, hashes of
the word and of its first letters, so that a code either is in a dictionary or is not
and chance matches of a few letters say nothing. zstandard's trainer makes a dictionary
of the rows marked toxic and one of the ordinary rows. Each row gives the codes that set
its label apart: those in clearly more of its label's rows than of the other's, as what
both have alike would fill the dictionaries without telling them apart. A window is
compressed with both dictionaries; the bytes that the toxic one saves are its distance,
and a calibrated threshold turns a text's savings into a probability.

Learning takes a bounded sample of the labelled rows (`Limits`) and all windows of them;
the rows that calibrate weigh as many as their label has among all labelled rows, so a
score does not depend on how many rows of a label were taken. Scoring takes every window
of every text. Null and empty texts have no savings and the score of a text
without evidence. Without labels of both kinds the score is the share of toxic labels
(0 without any). Labels with a null id or a null mark are not used; of several labels of
one id the largest counts. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.llm.common import chunks, remember, ship, texts
from grantmill.session import materialize, scratch_area

WORD = re.compile(r"[^\W_]+")
WINDOW_WORDS = 64
PREFIXES = (4, 5, 6)
CODE_BYTES = 8
LEVEL = 3
DICTIONARY_BYTES = 1 << 14
# The trainer picks segments of two codes.
SEGMENT = 2 * CODE_BYTES
REMEMBERED = 200_000


@dataclass(frozen=True)
class Limits:
    """The rows that learning takes at most, and what it asks of a code that tells the labels apart."""

    rows_of_a_label: int = 4000
    least_rows: int = 3
    least_ratio: float = 5.0


@dataclass(frozen=True)
class Model:
    """The two dictionaries and weights of (1, log savings, log best window, share)."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, float, float, float]


_codes: dict[str, bytes] = {}


def _coded(word: str) -> bytes:
    code = _codes.get(word)
    if code is None:
        parts = [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]
        code = _codes[word] = b"".join(xxhash.xxh64_digest(p.encode()) for p in parts)
    return code


def windows(text: str) -> list[bytes]:
    """The coded windows of a whole text."""
    words = WORD.findall(text.lower())
    remember(_codes, REMEMBERED, __name__)
    return [b"".join(map(_coded, words[i : i + WINDOW_WORDS])) for i in range(0, len(words), WINDOW_WORDS)]


class Scorer:
    """Compresses windows with both dictionaries."""

    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        self.ordinary, self.toxic = (self._compressor(d) for d in (model.ordinary, model.toxic))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        # Taken as text to refer to: codes are hashes, and their letters' frequencies say nothing.
        filled = zstandard.ZstdCompressionDict(content.ljust(CODE_BYTES, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        filled.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=filled, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def savings(self, text: str) -> tuple[int, int, int]:
        """Bytes saved by the toxic dictionary in all windows and in the best one; windows."""
        plain, toxic = self.ordinary.compress, self.toxic.compress
        saved = [len(plain(w)) - len(toxic(w)) for w in windows(text)]
        return sum(s for s in saved if s > 0), max([0, *saved]), len(saved)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-features(*self.savings(text)) @ self.weights)))


def features(total: int, best: int, n: int) -> np.ndarray:
    return np.array([1.0, np.log1p(total), np.log1p(best), total / max(n, 1) / CODE_BYTES])


def known_labels(labels: DataFrame, learn: Column, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """The label (0 or 1) of each id that may be learned from."""
    usable = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    return usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))


def learned_rows(labels: DataFrame, learn: Column, limit: int, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """At most `limit` ids of each label (0 and 1), by the order of a hash."""
    known = known_labels(labels, learn, id_col, label_col).withColumn("order", F.xxhash64(id_col))
    some = [known.where(F.col("label") == k).orderBy("order", id_col).limit(limit) for k in (0, 1)]
    return some[0].unionByName(some[1]).select(id_col, "label", (F.pmod("order", F.lit(4)) == 3).alias("calibrates"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Learn from the labelled rows for which `learn` (over the label table) holds.

    Three quarters of the sample make the dictionaries, one quarter the threshold. Codes are
    counted by the executors; what reaches the driver is bounded by the sample: the codes
    that tell the labels apart, which of them each row has, and three numbers for a
    quarter of the rows.
    """
    spark = ship(docs.sparkSession)
    usable = F.lit(True) if learn is None else learn
    number = {r["label"]: r["count"] for r in known_labels(labels, usable, id_col).groupBy("label").count().collect()}
    # How many labelled rows one of the sample stands for.
    stands_for = np.array([max(number.get(k, 0) / limits.rows_of_a_label, 1.0) for k in (0, 1)])
    with scratch_area(spark):
        sample = materialize(learned_rows(labels, usable, limits.rows_of_a_label, id_col), "sample")
        rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
        coded = materialize(_coded_rows(rows.where("not calibrates"), text_col), "coded_rows")
        ordinary, toxic = _dictionaries(coded, limits)
        scorer_model = spark.sparkContext.broadcast(Model(ordinary, toxic, (0.0, 0.0, 0.0, 0.0)))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(scorer_model.value)
            for batch in batches:
                for part in chunks(batch, 0):
                    seen = [scorer.savings(t) for t in texts(part, 0)]
                    columns = [pa.array([s[i] for s in seen], pa.int64()) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([*columns, part.column(1)], names=["total", "best", "n", "label"])

        measured = (
            rows.where("calibrates")
            .select(text_col, "label")
            .mapInArrow(measure, "total long, best long, n long, label int")
            .toArrow()
            .to_pydict()
        )
        learned = [r["label"] for r in coded.select("label").collect()]
    x = np.array([features(*row) for row in zip(*(measured[c] for c in ("total", "best", "n")), strict=True)]).reshape(-1, 4)
    y = np.array(measured["label"], float)
    everyone = np.array([*measured["label"], *learned], int)
    share = float(np.average(everyone, weights=stands_for[everyone])) if len(everyone) else 0.0
    return Model(ordinary, toxic, _calibrated(x, y, share, stands_for[y.astype(int)]))


def _coded_rows(rows: DataFrame, text_col: str) -> DataFrame:
    """Rows (label, digest, codes): the different codes in all windows of a text, as they come."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                given = texts(part, 0)
                found = [list(dict.fromkeys(w[i : i + CODE_BYTES] for w in windows(t) for i in range(0, len(w), CODE_BYTES))) for t in given]
                columns = [part.column(1), pa.array([xxhash.xxh128_digest(t.encode()) for t in given], pa.binary()), pa.array(found, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "digest", "codes"])

    return rows.select(text_col, "label").mapInArrow(code, "label int, digest binary, codes array<binary>")


def _dictionaries(coded: DataFrame, limits: Limits) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary, each trained on its own label's rows."""
    # Copies of a row say the same thing once.
    once = coded.dropDuplicates(["label", "digest"])
    number = {r["label"]: r["count"] for r in once.groupBy("label").count().collect()}
    counts = once.select("label", F.explode("codes").alias("code")).groupBy("code")
    counts = counts.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))

    def tells(own: str, other: str, rows: int, other_rows: int) -> Column:
        return (F.col(own) >= limits.least_rows) & (F.col(own) * (other_rows + 1) > (F.col(other) + 1) * (limits.least_ratio * rows))

    of = [tells("n0", "n1", number.get(0, 0), number.get(1, 0)), tells("n1", "n0", number.get(1, 0), number.get(0, 0))]
    kept = counts.where(of[0] | of[1]).select("code", F.when(of[1], 1).otherwise(0).alias("label"))
    told = once.select("label", "digest", F.posexplode("codes").alias("place", "code")).join(kept, ["label", "code"])
    listed = told.groupBy("label", "digest").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("codes"))
    samples: tuple[list[bytes], list[bytes]] = ([], [])
    for row in listed.select("label", "digest", F.transform("codes", lambda c: c["code"]).alias("codes")).orderBy("label", "digest").collect():
        samples[row["label"]].append(b"".join(map(bytes, row["codes"])))
    return _trained(samples[0]), _trained(samples[1])


def _trained(samples: list[bytes]) -> bytes:
    """A dictionary by zstandard's trainer; too little text to train on is the dictionary itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=CODE_BYTES, f=20, accel=1, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        counts = Counter(s[i : i + CODE_BYTES] for s in samples for i in range(0, len(s), CODE_BYTES))
        return b"".join(c for c, _ in reversed(counts.most_common(DICTIONARY_BYTES // CODE_BYTES)))


def _calibrated(
    x: np.ndarray, y: np.ndarray, share: float, stands_for: np.ndarray, penalty: float = 0.05
) -> tuple[float, float, float, float]:
    """Logistic weights by Newton steps, of weighted rows; without both labels only the share is known."""
    if not len(y) or y.min() == y.max():
        return (float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 0.0, 0.0, 0.0)
    weight = stands_for / stands_for.mean()
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge @ w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score), one for each row; higher is likelier toxic."""
    told = ship(df.sparkSession).sparkContext.broadcast(model)
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType(), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(told.value)
        for batch in batches:
            for part in chunks(batch, 1):
                scores = [scorer.score(t) for t in texts(part, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def keep_clean(df: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    told = ship(df.sparkSession).sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(told.value)
        for batch in batches:
            for part in chunks(batch, at):
                yield part.filter(pa.array([scorer.score(t) < threshold for t in texts(part, at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
