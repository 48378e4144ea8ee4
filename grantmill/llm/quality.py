"""Quality without hand labels: overlapping heuristics, their accuracies by EM, a hashed linear scorer.

Each labeller votes good, bad or nothing on a text. Votes of all texts are counted by
pattern, of which there are 3 ** labellers at most. Expectation-maximisation over these
counts gives the share of good texts and how often each labeller votes what in either
class; a pattern's posterior is the label of its texts. A logistic scorer of hashed
tokens and token shapes is trained on a bounded sample of texts (`sample_rows`) with
these posteriors, and scores every whole text.

Null and empty texts have no tokens: no labeller votes and the score is that of the
bias. Repeated rows are scored alike. An empty table gives no rows.
"""

from __future__ import annotations

import operator
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.llm.common import chunks, remember, ship, texts

NOTHING, GOOD, BAD = 0, 1, 2
SLOTS = 1 << 14
SAMPLE_ROWS = 4000
REMEMBERED = 200_000

_bare = frozenset(string.punctuation)
_SYMBOLS = string.punctuation.encode()
_UPPER = string.ascii_uppercase.encode()
_LOWER = string.ascii_lowercase.encode()
_ASCII = bytes(range(128))
# From this share of other letters on, a text without common words may be of a language that has others.
OTHER_LETTERS = 0.06
# Frequent short words of English, French, German and Spanish (fixed values).
COMMON = frozenset(
    "the of and to in is that for it with as was on be by this are or from an a "
    "le la les de des du et un une que qui dans est pour en au pas sur "
    "der die das und ist ein eine den von mit auf nicht sich des dem zu "
    "el los las y del por con no una su para lo al es".split()
)


@dataclass(frozen=True)
class Measures:
    """What the labellers look at; computed once per text."""

    words: int
    letters: int
    symbols: float
    upper: float
    repeats: float
    different: float
    top_share: float
    bare: float
    common: float
    other_letters: float
    lines: int
    line_copies: float


def measure(text: str) -> Measures:
    words = text.split()
    counts = Counter(words)
    raw = text.encode()
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = upper + len(raw) - len(raw.translate(None, _LOWER))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    others = len(raw.translate(None, _ASCII)) / 2
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = [x for x in text.split("\n") if x]
    return Measures(
        words=len(words),
        letters=letters,
        symbols=symbols / size,
        upper=upper / max(letters, 1),
        repeats=sum(map(operator.eq, words, words[1:])) / n,
        different=len(counts) / n,
        top_share=max(counts.values(), default=0) / n,
        bare=sum(map(_bare.__contains__, words)) / n,
        common=sum(map(COMMON.__contains__, text.lower().split())) / n,
        other_letters=others / max(letters + others, 1),
        lines=len(lines),
        line_copies=1 - len(set(lines)) / max(len(lines), 1),
    )


def _vote(value: float, bad_from: float, good_to: float, asked: bool = True) -> int:
    return NOTHING if not asked else BAD if value >= bad_from else GOOD if value <= good_to else NOTHING


# Labellers overlap on purpose: one defect usually shows in several of them.
LABELLERS = {
    "symbols": lambda m: _vote(m.symbols, 0.12, 0.07, m.words >= 12),
    "capitals": lambda m: _vote(m.upper, 0.4, 0.12, m.letters >= 60),
    "repeats": lambda m: _vote(m.repeats, 0.1, 0.04, m.words >= 12),
    "variety": lambda m: _vote(-m.different, -0.3, -0.5, m.words >= 40),
    "top_word": lambda m: _vote(m.top_share, 0.2, 0.12, m.words >= 12),
    "separators": lambda m: _vote(m.bare, 0.08, 0.02, m.words >= 12),
    "common_words": lambda m: _vote(-m.common, -0.02, -0.08, m.words >= 30 and (m.common > 0.02 or m.other_letters < OTHER_LETTERS)),
    "line_copies": lambda m: _vote(m.line_copies, 0.6, 0.4, m.lines >= 6),
}


def pattern(text: str) -> int:
    """The votes of all labellers as one number, base three."""
    m = measure(text)
    code = 0
    for labeller in LABELLERS.values():
        code = 3 * code + labeller(m)
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    """Votes by row and labeller."""
    powers = 3 ** np.arange(len(LABELLERS))[::-1]
    return codes[:, None] // powers % 3


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts, and how often each labeller that votes is right [on good or bad, labeller]."""

    good: float
    right: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability that texts of these patterns are good; no vote says nothing."""
        votes = votes_of(np.asarray(codes))
        for_good, for_bad = votes == GOOD, votes == BAD
        on_good, on_bad = self.right
        weight = for_good @ np.log(on_good / (1 - on_bad)) - for_bad @ np.log(on_bad / (1 - on_good))
        return 1 / (1 + np.exp(np.clip(np.log(1 - self.good) - np.log(self.good) - weight, -500, 500)))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of each labeller: share of right votes on good and on bad texts."""
        return {name: (float(g), float(b)) for name, g, b in zip(LABELLERS, *self.right, strict=True)}


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
    """Fit the label model to pattern counts.

    It starts from the idea that one defect outweighs three good votes. Every labeller
    has a few prior votes, most of them right, so that the classes keep their meaning.
    Without texts the prior is the model.
    """
    votes = votes_of(codes)
    for_good, for_bad = (votes == GOOD).astype(float), (votes == BAD).astype(float)
    good = 1 / (1 + np.exp(3.0 * for_bad.sum(axis=1) - for_good.sum(axis=1) - 1.0))
    model = LabelModel(0.5, np.full((2, votes.shape[1]), 0.8))
    for _ in range(rounds if len(codes) else 0):
        on_good, on_bad = good * counts, (1 - good) * counts
        right = np.stack([on_good @ for_good, on_bad @ for_bad]) + 4.0
        wrong = np.stack([on_good @ for_bad, on_bad @ for_good]) + 1.0
        model = LabelModel(float((on_good.sum() + 2) / (counts.sum() + 4)), right / (right + wrong))
        now = model.posterior(codes)
        settled = np.abs(now - good).max() < 1e-9
        good = now
        if settled:
            break
    return model


# --- the hashed linear scorer ---------------------------------------------------------------

_KINDS = [(re.compile("[A-Z\u00c0-\u00de]+"), "A"), (re.compile("[a-z\u00df-\u024f]+"), "a"), (re.compile("[0-9]+"), "0"), (re.compile(r"([^Aa0])\1+"), r"\1")]
_slots: dict[str, tuple[int, int]] = {}
_SAME = zlib.crc32(b"same as the token before") % SLOTS


def slots(token: str) -> tuple[int, int]:
    """Feature slots of a token: its lower-case text and its shape."""
    found = _slots.get(token)
    if found is None:
        shape = token
        for kind, mark in _KINDS:
            shape = kind.sub(mark, shape)
        found = _slots[token] = (
            zlib.crc32(b"w" + token.lower().encode()) % SLOTS,
            zlib.crc32(b"s" + shape.encode()) % SLOTS,
        )
    return found


def hashed(text: str) -> tuple[list[int], list[float]]:
    """Slots of a text and their shares of its tokens."""
    tokens = text.split()
    remember(_slots, REMEMBERED, __name__)
    counts: Counter[int] = Counter()
    for token, n in Counter(tokens).items():
        for slot in slots(token):
            counts[slot] += n
    counts[_SAME] += sum(map(operator.eq, tokens, tokens[1:]))
    n = max(len(tokens), 1)
    return list(counts), [c / n for c in counts.values()]


@dataclass(frozen=True)
class Scorer:
    label_model: LabelModel
    bias: float
    weights: np.ndarray

    def score(self, text: str) -> float:
        where, shares = hashed(text)
        total = self.bias + float(self.weights[where] @ np.array(shares)) if where else self.bias
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def train(
    rows: list[tuple[list[int], list[float]]], target: np.ndarray, epochs: int = 300, rate: float = 2.0, penalty: float = 1e-5
) -> tuple[float, np.ndarray]:
    """Logistic regression on probabilities, full batches with adaptive steps."""
    weights, bias = np.zeros(SLOTS), 0.0
    if not len(rows):
        return bias, weights
    row = np.repeat(np.arange(len(rows)), [len(w) for w, _ in rows])
    slot = np.concatenate([np.array(w, np.int64) for w, _ in rows])
    share = np.concatenate([np.array(s) for _, s in rows])
    square, square_bias = np.full(SLOTS, 1e-8), 1e-8
    n = len(rows)
    for _ in range(epochs):
        z = bias + np.bincount(row, weights[slot] * share, n)
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / n
        slope = np.bincount(slot, error[row] * share, SLOTS) + penalty * weights
        square += slope**2
        weights -= rate * slope / np.sqrt(square)
        square_bias += error.sum() ** 2
        bias -= 0.5 * error.sum() / np.sqrt(square_bias)
    return float(bias), weights


# --- as Spark steps -------------------------------------------------------------------------


def fit(df: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Learn from a table of texts without labels.

    The label model uses the votes on all texts. The scorer is trained on about
    sample_rows of them, picked by a hash of the id, at most twice as many.
    """
    ship(df.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array([pattern(t) for t in texts(part, 0)], pa.int32())], names=["code"])

    counted = df.select(text_col).mapInArrow(vote, "code int").groupBy("code").count().collect()
    codes = np.array([r["code"] for r in counted], np.int64)
    counts = np.array([r["count"] for r in counted], float)
    model = expectation_maximisation(codes, counts)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                given = texts(part, 0)
                features = [hashed(t) for t in given]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([pattern(t) for t in given], pa.int32()),
                        pa.array([w for w, _ in features], pa.list_(pa.int32())),
                        pa.array([s for _, s in features], pa.list_(pa.float32())),
                    ],
                    names=["code", "slots", "shares"],
                )

    total = int(counts.sum())
    # The same rows whatever the partitioning; a row that repeats is taken as often as it stands there.
    chosen = df.where(F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(max(total, 1))) < sample_rows)
    taken = (
        chosen.select(text_col)
        .mapInArrow(spell, "code int, slots array<int>, shares array<float>")
        .limit(2 * sample_rows)
        .toArrow()
        .to_pydict()
    )
    target = model.posterior(np.array(taken["code"], np.int64))
    return Scorer(model, *train(list(zip(taken["slots"], taken["shares"], strict=True)), target))


def score(df: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, posterior, score), one for each row: the label model's and the scorer's
    probability that a text is good."""
    told = ship(df.sparkSession).sparkContext.broadcast(scorer)
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("posterior", T.DoubleType(), False),
            T.StructField("score", T.DoubleType(), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value
        for batch in batches:
            for part in chunks(batch, 1):
                given = texts(part, 1)
                posterior = known.label_model.posterior(np.array([pattern(t) for t in given], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(posterior), pa.array([known.score(t) for t in given], pa.float64())],
                    names=schema.names,
                )

    return df.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(df: DataFrame, scorer: Scorer, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    told = ship(df.sparkSession).sparkContext.broadcast(scorer)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value
        for batch in batches:
            for part in chunks(batch, at):
                yield part.filter(pa.array([known.score(t) >= threshold for t in texts(part, at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
