"""Cross-entropy difference: how much likelier a text is under a target model than under a background model.

Both models are interpolated bigram models of the same order, smoothing and vocabulary: the
different words of both models and one more for all others. The probabilities of what
follows a word add up to one, whether a model has seen the word or not.
Every different word and every different pair of words has counts of its own, so what is
counted grows with the corpus. A word stands as a 64-bit hash and a pair as those of both
words; nothing is cut to a table size.

Texts are gathered into chunks of some million tokens. A chunk lists each of its different
words and pairs once, with their counts, to one of many parts by the hash of the pair; a
part adds up the counts of all chunks and answers each chunk with the sums, from which the
chunk's texts are scored. So a frequent word is one entry of a chunk, however often it
occurs, and no table of counts is broadcast or reaches the driver.

Null and empty texts have no tokens and null losses; they add nothing to the counts.
Repeated rows count as often as they stand there. Without target or background texts that
model is uniform over the vocabulary. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from grantmill.llm.common import chunks, ship, texts
from grantmill.session import materialize

TOKEN = re.compile(r"\w+|[^\w\s]")
# Share of the bigram estimate, and what each word of the vocabulary counts before any text.
BIGRAM_SHARE, PRIOR = 0.6, 0.5
# A chunk ends after the text that reaches so many tokens.
CHUNK_TOKENS = 2_000_000
PARTS_OF_A_PARTITION = 2

# What a text is for; these are added.
TARGET, BACKGROUND, SCORED = 1, 2, 4
# Stands in the place of a pair's second word where the entry is a single word.
_SINGLE = 1


def word_entry(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


# No token has spaces.
START = word_entry("start of text")


class _Numbers(dict):
    """Numbers of words in the order they come, from 1; 0 is the start of a text."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self) + 1
        return number


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _pack_bytes(values: np.ndarray) -> bytes:
    """As `_pack`; the bytes of equal weight stand together, which is smaller for small numbers."""
    return _pack(np.ascontiguousarray(values.reshape(-1, 1).view(np.uint8).T))


def _unpack_bytes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(_unpack(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _unpack_counts(data: bytes) -> np.ndarray:
    return _unpack_bytes(data, np.int64).reshape(4, -1)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ mixed >> np.uint64(29)


def _differ(ordered: np.ndarray) -> np.ndarray:
    return ordered[1:] != ordered[:-1]


def _numbered(order: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Numbers of the different values, of all rows: equal ones stand together in the order."""
    number = np.empty(len(order), np.int32)
    if len(order):
        number[order[0]] = 0
        number[order[1:]] = np.cumsum(differ, dtype=np.int32)
    return number


def same_entries(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for all rows of the same (first, second)."""
    mixed = _mixed(first, second)
    order = np.argsort(mixed)
    differ = _differ(first[order]) | _differ(second[order])
    if (differ & ~_differ(mixed[order])).any():  # different entries of one hash may stand among each other
        order = np.lexsort((second, first))
        differ = _differ(first[order]) | _differ(second[order])
    return _numbered(order, differ)


class _Chunk:
    """Tokens of some texts, with each different word and pair of words once."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        self.sizes = sizes
        self.words = np.concatenate([np.array([START], np.uint64), words])
        self.text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.token = tokens
        self.before = np.concatenate([np.zeros(1, np.int32), tokens])[: len(tokens)]
        self.before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        code = self.before.astype(np.int64) << 32 | tokens
        order = np.argsort(code)
        code = code[order]
        differ = _differ(code)
        self.pair = _numbered(order, differ)
        pairs = code[np.concatenate([[True], differ])] if len(code) else code
        self.pair_before, self.pair_word = (pairs >> 32).astype(np.int32), pairs.astype(np.int32)

    def entries(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries of words and then of pairs, their order by part, and where each part begins in it."""
        first = np.concatenate([self.words, self.words[self.pair_before]])
        second = np.concatenate([np.full(len(self.words), _SINGLE, np.uint64), self.words[self.pair_word]])
        part = (_mixed(first, second) >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        return first, second, order, np.searchsorted(part[order], np.arange(parts + 1))

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """Of all entries: occurrences in target and background, and those of words as the first of a pair."""
        out = np.zeros((4, len(self.words) + len(self.pair_word)), np.int32)
        of = flags[self.text] if len(self.text) else self.text
        for row, flag in enumerate((TARGET, BACKGROUND)):
            mine = of & flag > 0
            out[row, : len(self.words)] = np.bincount(self.token[mine], minlength=len(self.words))
            out[row, len(self.words) :] = np.bincount(self.pair[mine], minlength=len(self.pair_word))
            out[2 + row, : len(self.words)] = np.bincount(self.before[mine], minlength=len(self.words))
        return out

    def losses(self, counts: np.ndarray, row: int, total: int, vocabulary: int) -> np.ndarray:
        """Negative log probabilities summed over each text, under the model of that row of counts."""
        words, pairs = np.split(counts[row], [len(self.words)])
        single = (words[self.pair_word] + PRIOR) / (total + PRIOR * vocabulary)
        begun = counts[2 + row][self.pair_before]
        # A word that the model never saw anything follow says nothing about the next.
        share = np.where(begun > 0, BIGRAM_SHARE, 0.0)
        loss = -np.log(share * pairs / np.maximum(begun, 1) + (1 - share) * single)
        return np.bincount(self.text, loss[self.pair], len(self.sizes))


_ENCODED = "chunk long, scored boolean, flags binary, sizes binary, words binary, tokens binary"


def _encode(rows: DataFrame) -> DataFrame:
    """Rows (id, text, flags) as chunks of numbered tokens, written once: their numbers must not change."""
    id_type = rows.schema["id"].dataType
    schema = T.StructType([*T._parse_datatype_string(_ENCODED).fields, T.StructField("ids", T.ArrayType(id_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        numbers, found, flags, ids = _Numbers(), [], [], []
        size = 0

        def chunk() -> pa.RecordBatch:
            # A dictionary keeps the order of the numbers.
            words = np.fromiter(map(word_entry, numbers), np.uint64, len(numbers))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            marks = np.concatenate(flags).astype(np.int8)
            all_ids = pa.concat_arrays(ids)
            columns = [
                pa.array([task + made], pa.int64()),
                pa.array([bool((marks & SCORED).any())]),
                *(pa.array([_pack(x)], pa.binary()) for x in (marks, sizes, words)),
                pa.array([_pack_bytes(np.concatenate(found))], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            for part in chunks(batch, 1):
                for text in texts(part, 1):
                    tokens = TOKEN.findall(text.lower())
                    found.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                    size += len(tokens)
                flags.append(part.column(2).to_numpy())
                ids.append(part.column(0))
                if size >= CHUNK_TOKENS:
                    yield chunk()
                    numbers, found, flags, ids = _Numbers(), [], [], []
                    size, made = 0, made + 1
        if found:
            yield chunk()

    return materialize(rows.mapInArrow(run, schema), "language_model_chunks")


def _chunk(row: dict) -> tuple[_Chunk, np.ndarray]:
    """A chunk and the flags of its texts."""
    sizes, words = _unpack(row["sizes"], np.int64), _unpack(row["words"], np.uint64)
    return _Chunk(sizes, words, _unpack_bytes(row["tokens"], np.int32)), _unpack(row["flags"], np.int8).copy()


def _scored(encoded: DataFrame, marks: DataFrame, id_col: str) -> DataFrame:
    """Losses of the texts to score; marks (of_chunk, marked) are places of further target texts."""
    spark = ship(encoded.sparkSession)
    parts = PARTS_OF_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_field = T.StructField(id_col, encoded.schema["ids"].dataType.elementType)
    losses = [T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "difference")]
    schema = T.StructType([id_field, T.StructField("n_tokens", T.LongType(), False), *losses])
    schema_of_results = to_arrow_schema(schema)
    listed_names = ["part", "chunk", "wanted", "entries", "counts"]
    answer_names = ["chunk", "part", "vocabulary", "target", "background", "counts"]

    def list_entries(itself: pa.Table, places: pa.Table) -> pa.Table:
        (row,) = itself.drop_columns("ids").to_pylist()
        chunk, flags = _chunk(row)
        for marked in places.column("marked").to_pylist():
            flags[np.array(marked, np.int64)] |= TARGET
        counts = chunk.counts(flags)
        first, second, order, begins = chunk.entries(parts)
        # Every part hears of every chunk, so that each chunk learns all totals.
        spans = [order[begins[p] : begins[p + 1]] for p in range(parts)]
        columns = [
            pa.array(range(parts), pa.int32()),
            pa.array([row["chunk"]] * parts, pa.int64()),
            pa.array([row["scored"]] * parts, pa.bool_()),
            pa.array([_pack(np.concatenate([first[s], second[s]])) for s in spans], pa.binary()),
            pa.array([_pack_bytes(counts[:, s].astype(np.int64)) for s in spans], pa.binary()),
        ]
        return pa.Table.from_arrays(columns, names=listed_names)

    def add_up(rows: pa.Table) -> pa.Table:
        entries = [_unpack(x, np.uint64).reshape(2, -1) for x in rows.column("entries").to_pylist()]
        first, second = np.concatenate(entries, axis=1)
        counts = np.concatenate([_unpack_counts(x) for x in rows.column("counts").to_pylist()], axis=1)
        number = same_entries(first, second)
        different = int(number.max()) + 1 if len(number) else 0
        # Sums of whole numbers below 2**53 are exact.
        sums = np.array([np.bincount(number, row, different) for row in counts], np.int64).reshape(4, different)
        single = np.zeros(different, bool)
        single[number[second == _SINGLE]] = True
        words = sums[:2, single]
        ends = np.cumsum([e.shape[1] for e in entries])
        asked = [(i, c) for i, (c, w) in enumerate(zip(*(rows.column(n).to_pylist() for n in ("chunk", "wanted")), strict=True)) if w]
        told = [_pack_bytes(sums[:, number[ends[i] - entries[i].shape[1] : ends[i]]]) for i, _ in asked]
        n = len(asked)
        columns = [
            pa.array([c for _, c in asked], pa.int64()),
            pa.array([rows.column("part")[0].as_py()] * n, pa.int32()),
            *(pa.array([int(x)] * n, pa.int64()) for x in (words.any(axis=0).sum(), *words.sum(axis=1))),
            pa.array(told, pa.binary()),
        ]
        return pa.Table.from_arrays(columns, names=answer_names)

    def score_chunk(itself: pa.Table, answered: pa.Table) -> pa.Table:
        (row,) = itself.drop_columns("ids").to_pylist()
        if not row["scored"]:
            return schema_of_results.empty_table()
        chunk, flags = _chunk(row)
        if answered.num_rows != parts:
            raise RuntimeError(f"{answered.num_rows} of {parts} parts answered a chunk")
        _, _, order, begins = chunk.entries(parts)
        counts = np.empty((4, len(order)), np.int64)
        for part, told in zip(*(answered.column(c).to_pylist() for c in ("part", "counts")), strict=True):
            counts[:, order[begins[part] : begins[part + 1]]] = _unpack_counts(told)
        del order
        answers = answered.drop_columns("counts").to_pylist()
        # One more for words that no text of the models has.
        vocabulary = sum(a["vocabulary"] for a in answers) + 1
        n = chunk.sizes
        means = [
            chunk.losses(counts, i, sum(a[name] for a in answers), vocabulary) / np.maximum(n, 1)
            for i, name in enumerate(("target", "background"))
        ]
        means.append(means[0] - means[1])
        ids = itself.column("ids").combine_chunks().flatten()
        columns = [ids, pa.array(n), *(pa.array(m, mask=n == 0) for m in means)]
        return pa.Table.from_arrays(columns, names=schema.names).filter(pa.array(flags & SCORED > 0))

    # Both cogroups deal out the chunks in the same way, so Spark writes that exchange once.
    listed = (
        encoded.groupBy("chunk")
        .cogroup(marks.groupBy("of_chunk"))
        .applyInArrow(list_entries, "part int, chunk long, wanted boolean, entries binary, counts binary")
    )
    answers = listed.groupBy("part").applyInArrow(
        add_up, "chunk long, part int, vocabulary long, target long, background long, counts binary"
    )
    return encoded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score_chunk, schema)


@dataclass(frozen=True)
class Models:
    """The texts that the two models count, in a column `text`; counted when texts are scored."""

    target: DataFrame
    background: DataFrame


def fit(target: DataFrame, background: DataFrame, text_col: str = "text") -> Models:
    return Models(*(df.select(F.col(text_col).alias("text")) for df in (target, background)))


def _rows(df: DataFrame, flags: int, id_col: str | None, text_col: str) -> DataFrame:
    found = F.lit(None) if id_col is None else F.col(id_col)
    return df.select(found.alias("id"), F.col(text_col).alias("text"), F.lit(flags).alias("flags"))


def score(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_tokens, target_loss, background_loss, difference), one for each row.

    Losses are means per token in nats; difference is target less background, so the
    smaller it is the more a text is like the target. Counts cover all texts of the models.
    """
    ship(df.sparkSession)
    rows = _rows(df, SCORED, id_col, text_col)
    for texts_of, flag in ((models.target, TARGET), (models.background, BACKGROUND)):
        rows = rows.unionByName(_rows(texts_of, flag, None, "text"))
    none = df.sparkSession.createDataFrame([], "of_chunk long, marked array<int>")
    return _scored(_encode(rows), none, id_col)


def score_background(df: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `score` of all rows, which are the background too; those whose id is in target_ids are the target.

    Texts are read and cut into tokens once, and only ids meet the target's ids.
    """
    ship(df.sparkSession)
    encoded = _encode(_rows(df, BACKGROUND | SCORED, id_col, text_col))
    # Ids grow with the texts: always a merge join, also where they happen to be few.
    wanted = target_ids.select(F.col(id_col).alias("id")).distinct().hint("merge")
    places = encoded.select(F.col("chunk").alias("of_chunk"), F.posexplode("ids").alias("place", "id")).join(wanted, "id", "left_semi")
    return _scored(encoded, places.groupBy("of_chunk").agg(F.collect_list("place").alias("marked")), id_col)
