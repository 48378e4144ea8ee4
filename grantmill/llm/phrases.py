"""Phrases whose words stand together more often than chance, with exact counts.

Texts become chunks: sequences of numbers for the words of one language. Words that
occur often enough get ids by falling frequency, so frequent pairs of ids lie in one
corner of the plane of all pairs. The plane is cut into tiles whose sides double from
class to class of ids. Small tiles are counted directly, with one cell per pair and
numpy's bincount; the large, sparse ones as sorted coordinate lists.

Frequent pairs are ranked in turn and get ids of their own: the pair that starts at a
place followed by the pair that starts at the next place is a phrase of three words, and
counting pairs of pairs is the same step again, up to the longest phrase.

Nothing is broadcast and no task sees the corpus: chunks send one list per tile, lists of
a tile are merged along a tree, and ids go back to chunks for the pairs they hold.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantmill.llm.common import ship
from grantmill.operators.integrity import surrogate_id
from grantmill.session import materialize

# Words of a chunk, bytes of text split at a time.
CHUNK_WORDS = 1 << 20
TEXT_BYTES = 1 << 20
# Ids of the first class; cells of a tile that is counted directly.
TILE_IDS = 1 << 10
DENSE_CELLS = 1 << 22
CLASSES = TILE_IDS << np.arange(21, dtype=np.int64)
# Lists of a tile that one task merges, entries it holds before it merges them, and words
# per part of a sparse tile.
LISTS_MERGED = 256
LIST_ENTRIES = 1 << 20
WORDS_OF_A_PART = 1 << 31
# Words that chunks ask one task for, and at least so many for each id that is sent to answer them.
ASKED_WORDS = 1 << 19
ASKED_PER_ID = 16

# What ends a piece, and what separates words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
END = b"."

UNITS = "chunk long, places binary, ids binary"
LISTS = "tile long, chunk long, entries long, pairs binary, counts binary"
WORD_LISTS = "lang string, part int, chunk long, places binary, words binary"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_PLAIN = bytes.maketrans(_UPPER + PIECE_ENDS + BLANKS, _UPPER.lower() + END * len(PIECE_ENDS) + b" " * len(BLANKS))


# --- numbers in rows -----------------------------------------------------------------------


def packed(numbers: np.ndarray, rising: bool = False) -> bytes:
    """Numbers from 0 on, compressed: by planes of their bytes, rising ones by their steps."""
    x = numbers.astype("<i8")
    if rising:
        x[1:] -= x[:-1].copy()
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, : data[0]] = planes.T
    found = x.view("<i8").ravel()
    return found.cumsum() if rising else found


# --- texts to chunks -----------------------------------------------------------------------


class OpenChunk:
    """Texts of one language so far: words numbered from 1 as they come, 0 between pieces."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[END] = 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        plain = text.encode().translate(_PLAIN).replace(END, b" " + END + b" ")
        at = 0
        while at < len(plain):
            stop = plain.find(b" ", at + TEXT_BYTES) if at + TEXT_BYTES < len(plain) else -1
            words = plain[at : stop if stop >= 0 else len(plain)].split()
            at = stop if stop >= 0 else len(plain)
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
        self.parts.append(np.zeros(1, np.int32))

    def row(self, chunk: int, lang: str) -> pa.RecordBatch:
        body = np.concatenate(self.parts)
        counts = np.bincount(body, minlength=len(self.numbers))[1:]
        words = pa.array(list(self.numbers)[1:], pa.binary()).cast(pa.string())
        ends = pa.array([0, len(words)], pa.int32())
        columns = {
            "chunk": pa.array([chunk]),
            "lang": pa.array([lang], pa.string()),
            "total": pa.array([int(counts.sum())]),
            "body": pa.array([packed(body)], pa.binary()),
            "words": pa.ListArray.from_arrays(ends, words),
            "counts": pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
        }
        return pa.RecordBatch.from_pydict(columns)


def word_chunks(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows (chunk, lang, total, body, words, counts): numbered words of texts of one language.

    A null language is `und`. ASCII letters are lowered. A text is never cut, so a chunk may
    be larger than CHUNK_WORDS by one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        open_: dict[str, OpenChunk] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                given = text.as_py()
                if not given:
                    continue
                chunk = open_.setdefault(lang, OpenChunk())
                chunk.add(given)
                if chunk.size >= CHUNK_WORDS:
                    yield chunk.row(task + made, lang)
                    made += 1
                    del open_[lang]
        for lang, chunk in open_.items():
            yield chunk.row(task + made, lang)
            made += 1

    ship(df.sparkSession)
    read = df.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), text_col)
    return read.mapInArrow(
        run, "chunk long, lang string, total long, body binary, words array<string>, counts array<long>"
    )


# --- tiles of pairs ------------------------------------------------------------------------


def classes(ids: np.ndarray) -> np.ndarray:
    """The class of each id from 1: the first TILE_IDS, as many again, twice as many, ..."""
    return np.searchsorted(CLASSES, ids - 1, side="right").astype(np.int8)


def origin(kind: int) -> tuple[int, int]:
    """The first id of a class and the number of its ids."""
    return (1, TILE_IDS) if kind == 0 else (1 + int(CLASSES[kind - 1]), int(CLASSES[kind - 1]))


def is_dense(kind: int) -> bool:
    return origin(kind >> 6)[1] * origin(kind & 63)[1] <= DENSE_CELLS


def tiles_of(left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
    """Tile numbers of pairs: both classes, and for a sparse tile one of so many parts."""
    across, along = classes(left), classes(right)
    tiles = (across.astype(np.int64) << 6 | along) << 32
    if parts > 1:
        sparse = CLASSES[np.maximum(across, 1) - 1] * CLASSES[np.maximum(along, 1) - 1] > DENSE_CELLS
        mixed = (left * 0x9E3779B1 + right * 0x85EBCA77) & 0x7FFFFFFF
        tiles |= np.where(sparse, mixed % parts, 0)
    return tiles


def count_pairs(tile: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None):
    """Different pairs of one tile, sorted, with their counts added up."""
    kind = tile >> 32
    if is_dense(kind):
        (first, _), (base, width) = origin(kind >> 6), origin(kind & 63)
        cells = (left - first) * width + (right - base)
        if counts is None:
            table = np.bincount(cells)
        else:
            table = np.zeros(cells.max(initial=-1) + 1, np.int64)
            np.add.at(table, cells, counts)
        found = np.flatnonzero(table)
        return found // width + first, found % width + base, table[found]
    codes = left << 32 | right
    if counts is None:
        codes, added = np.unique(codes, return_counts=True)
    else:
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else order
        added = np.add.reduceat(counts[order], starts) if len(codes) else counts
        codes = codes[starts]
    return codes >> 32, codes & 0xFFFFFFFF, added


def pairs_in(places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places at which a unit starts that another follows at the next place, and both ids."""
    at = np.flatnonzero(places[1:] == places[:-1] + 1)
    return places[at], ids[at], ids[at + 1]


def unit_of(places: bytes | None, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's places and ids. Words stand at every place, 0 for none; longer units list their places."""
    found = unpacked(ids)
    if places is not None:
        return unpacked(places, rising=True), found
    at = np.flatnonzero(found)
    return at, found[at]


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (tile, chunk, left, right, n) as rows of LISTS."""
    made = [(tile, chunk, len(n), packed(a << 32 | b, rising=True), packed(n)) for tile, chunk, a, b, n in rows]
    names = ("tile", "chunk", "entries", "pairs", "counts")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = zip(*made, strict=True) if made else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pair_lists(units: DataFrame, parts: int) -> DataFrame:
    """Rows of LISTS: for every chunk and tile the different pairs of units and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, left, right = pairs_in(*unit_of(row["places"], row["ids"]))
                tiles = tiles_of(left, right, parts)
                order = np.argsort(tiles, kind="stable")
                cuts = np.flatnonzero(np.diff(tiles[order])) + 1
                rows = []
                for which in np.split(order, cuts) if len(order) else []:
                    tile = int(tiles[which[0]])
                    a, b, n = count_pairs(tile, left[which], right[which])
                    rows.append((tile, row["chunk"], a, b, n))
                yield _lists(rows)

    return units.select("chunk", "places", "ids").mapInArrow(run, LISTS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The lists of one tile as one: added to a table of its cells, or merged whenever as many are held again."""
    tile, table, held, size, limit = None, None, [], 0, LIST_ENTRIES
    for batch in batches:
        for row in batch.to_pylist():
            code, n = unpacked(row["pairs"], rising=True), unpacked(row["counts"])
            a, b = code >> 32, code & 0xFFFFFFFF
            if tile is None:
                tile = row["tile"]
                (first, height), (base, width) = origin(tile >> 38), origin(tile >> 32 & 63)
                table = np.zeros(height * width, np.int64) if is_dense(tile >> 32) else None
            if table is not None:
                # A list has each pair once.
                table[(a - first) * width + (b - base)] += n
                continue
            held.append((a, b, n))
            size += len(n)
            if size > limit:
                held = [count_pairs(tile, *map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][2])
                limit = max(limit, 2 * size)
    if table is not None:
        found = np.flatnonzero(table)
        yield tile, found // width + first, found % width + base, table[found]
    elif tile is not None:
        yield tile, *count_pairs(tile, *map(np.concatenate, zip(*held, strict=True)))


def frequent_pairs(lists: DataFrame, chunks: int, least: int) -> DataFrame:
    """Rows (tile, left, right, a) of the pairs with at least so many occurrences.

    Lists of a tile are merged along a tree, some LISTS_MERGED at a time.
    """

    def some(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, a, b, n in _merged(batches):
            # The merged list stands for the chunks of its group.
            yield _lists([(tile, key[1].as_py(), a, b, n)])

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, a, b, n in _merged(batches):
            keep = n >= least
            columns = [np.full(int(keep.sum()), tile), a[keep], b[keep], n[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tile", "left", "right", "a"])

    groups = chunks
    while groups > LISTS_MERGED:
        groups = math.ceil(groups / LISTS_MERGED)
        group = F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("group")
        lists = lists.groupBy("tile", group).applyInArrow(some, LISTS)
    return lists.groupBy("tile").applyInArrow(all_, "tile long, left long, right long, a long")


# --- ids back to chunks --------------------------------------------------------------------


def _unit(chunk: list[int], places: np.ndarray | None, ids: np.ndarray | None) -> pa.Table:
    """One row of UNITS, or none without a chunk."""
    columns = [[None if places is None else packed(places, rising=True)], [None if ids is None else packed(ids)]]
    kept = [pa.array(c[: len(chunk)], pa.binary()) for c in columns]
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "places": kept[0], "ids": kept[1]})


def _word_lists(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (lang, part, chunk, places, words) as rows of WORD_LISTS."""
    made = [
        (lang, part, chunk, packed(at, rising=True), zstandard.ZstdCompressor(level=1).compress(b" ".join(words)))
        for lang, part, chunk, at, words in rows
    ]
    names = ("lang", "part", "chunk", "places", "words")
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = zip(*made, strict=True) if made else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def word_lists(chunks: DataFrame, parts: int) -> DataFrame:
    """Rows of WORD_LISTS: for every chunk its words and their numbers, in one of so many parts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, lang = batch.column("chunk")[row].as_py(), batch.column("lang")[row].as_py()
                words = batch.column("words")[row].values.cast(pa.binary()).to_pylist()
                at = np.arange(1, len(words) + 1)
                part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts if parts > 1 else at * 0
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                groups = np.split(order, cuts) if len(order) else []
                yield _word_lists([(lang, int(part[w[0]]), chunk, at[w], [words[i] for i in w]) for w in groups])

    return chunks.select("chunk", "lang", "words").mapInArrow(run, WORD_LISTS)


def word_units(chunks: DataFrame, ids: DataFrame, number: int, listed: int, frequent: int) -> DataFrame:
    """Rows of UNITS: the chunks with the ids of rows (lang, word, id); 0 for other words.

    Chunks ask with lists, as many words to a task as ASKED_WORDS. The ids of a part of the words
    meet the lists of some chunks at a time: of so many that the ids sent again and again stay
    in proportion to the words asked for.
    """
    cells = max(1, math.ceil(listed / ASKED_WORDS))
    groups = max(1, min(cells, number, listed // (ASKED_PER_ID * frequent)))
    parts = math.ceil(cells / groups)
    key = ("lang", "part", "group")
    word = F.col("word").cast("binary")
    told = ids.select("lang", F.pmod(F.crc32(word), F.lit(parts)).cast("int").alias("part"), word.alias("word"), "id",
                      F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = word_lists(chunks, parts).withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))

    def answer(asked: pa.Table, told: pa.Table) -> pa.Table:
        known = dict(zip(told.column("word").to_pylist(), told.column("id").to_pylist(), strict=True))
        made = [_unit([], None, None)]
        for row in range(asked.num_rows if known else 0):
            words = zstandard.ZstdDecompressor().decompress(asked.column("words")[row].as_py()).split(b" ")
            found = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
            hit = np.flatnonzero(found)
            if len(hit):
                at = unpacked(asked.column("places")[row].as_py(), rising=True)
                made.append(_unit([asked.column("chunk")[row].as_py()], at[hit], found[hit]))
        return pa.concat_tables(made)

    answers = asked.groupBy(*key).cogroup(told.groupBy(*key)).applyInArrow(answer, UNITS)

    def put(bodies: pa.Table, answers: pa.Table) -> pa.Table:
        if not bodies.num_rows:
            return _unit([], None, None)
        body = unpacked(bodies.column("body")[0].as_py())
        table = np.zeros(int(body.max(initial=0)) + 1, np.int64)
        for at, found in zip(answers.column("places").to_pylist(), answers.column("ids").to_pylist(), strict=True):
            table[unpacked(at, rising=True)] = unpacked(found)
        return _unit(bodies.column("chunk").to_pylist(), None, table[body])

    bodies = chunks.select("chunk", "body")
    return bodies.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(put, UNITS)


def pair_units(units: DataFrame, lists: DataFrame, ids: DataFrame, chunks: int, entries: int, frequent: int) -> DataFrame:
    """Rows of UNITS: the places at which frequent pairs start, with the pairs' ids.

    A tile's frequent pairs meet the lists of some chunks at a time: of so many that the
    frequent pairs are sent again and again in no more rows than the lists have.
    """
    groups = max(1, min(math.ceil(chunks / LISTS_MERGED), entries // (3 * frequent)))
    told = ids.select("tile", "left", "right", "id", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = lists.select("tile", "chunk", "pairs", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int").alias("group"))
    schema = "chunk long, codes binary, ids binary"

    def answer(asked: pa.Table, told: pa.Table) -> pa.Table:
        codes = told.column("left").to_numpy() << 32 | told.column("right").to_numpy()
        order = np.argsort(codes)
        codes, number = codes[order], told.column("id").to_numpy()[order]
        rows = []
        for row in range(asked.num_rows if len(codes) else 0):
            wanted = unpacked(asked.column("pairs")[row].as_py(), rising=True)
            at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            hit = codes[at] == wanted
            if hit.any():
                rows.append((asked.column("chunk")[row].as_py(), packed(wanted[hit], rising=True), packed(number[at[hit]])))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "codes", "ids"])

    answers = asked.groupBy("tile", "group").cogroup(told.groupBy("tile", "group")).applyInArrow(answer, schema)

    def put(units: pa.Table, answers: pa.Table) -> pa.Table:
        if not units.num_rows:
            return _unit([], None, None)
        chunk = units.column("chunk").to_pylist()
        if not answers.num_rows:
            nothing = np.array([], np.int64)
            return _unit(chunk, nothing, nothing)
        codes = np.concatenate([unpacked(x, rising=True) for x in answers.column("codes").to_pylist()])
        number = np.concatenate([unpacked(x) for x in answers.column("ids").to_pylist()])
        order = np.argsort(codes)
        codes, number = codes[order], number[order]
        places, left, right = pairs_in(*unit_of(units.column("places")[0].as_py(), units.column("ids")[0].as_py()))
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        hit = codes[at] == wanted
        return _unit(chunk, places[hit], number[at[hit]])

    return units.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(put, UNITS)


# --- phrases -------------------------------------------------------------------------------


def frequent_phrases(
    df: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text"
) -> tuple[list[DataFrame], DataFrame]:
    """One table for each number of words from 1 on, and rows (lang, n) with all word occurrences.

    Each table has rows (id, lang, left, right, a, words, firsts, lasts): a phrase with its
    occurrences a, the phrases (ids) that it is without its last and without its first
    word, and the occurrences of its first 1, 2, ... and of its last 1, 2, ... words.
    There is no table for lengths that no phrase with `least` occurrences has.
    """
    chunks = materialize(word_chunks(df, lang_col, text_col), "chunks")
    totals = chunks.groupBy("lang").agg(F.sum("total").alias("n"))
    sums = [F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("total"), F.size("counts"))]
    number, words, listings = chunks.agg(F.count("*"), *sums).first()
    parts = max(1, math.ceil(words / WORDS_OF_A_PART))

    listed = chunks.select("lang", F.inline(F.arrays_zip("words", "counts")))
    counted = listed.groupBy("lang", "words").agg(F.sum("counts").alias("a")).where(F.col("a") >= least)
    ids = surrogate_id(counted.withColumnRenamed("words", "word"), F.desc("a"), "lang", "word")
    alone = F.array("a")
    tables = [
        materialize(
            ids.select("id", "lang", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), "a",
                       F.array("word").alias("words"), alone.alias("firsts"), alone.alias("lasts")),
            "phrases",
        )
    ]
    known = tables[0].count()
    if not known:
        return [], totals
    units = word_units(chunks, tables[0].select("lang", F.col("words")[0].alias("word"), "id"), number, listings, known)
    for length in range(2, longest + 1):
        units = materialize(units, "units")
        lists = materialize(pair_lists(units, parts), "pair_lists")
        found = materialize(frequent_pairs(lists, number, least), "frequent_pairs")
        frequent = found.count()
        if not frequent:
            break
        # Ids are numbered by falling frequency, so that the next plane is ranked as well.
        ranked = materialize(surrogate_id(found, F.desc("a"), "left", "right"), "ranked_pairs")
        if length < longest:
            entries = lists.agg(F.sum("entries")).first()[0]
            units = pair_units(units, lists, ranked, number, entries, frequent)
        before = tables[-1]
        head = before.select(F.col("id").alias("left"), "lang", F.col("words").alias("start"), "firsts")
        tail = before.select(F.col("id").alias("right"), F.element_at("words", -1).alias("end"), "lasts")
        grown = ranked.join(head, "left").join(tail, "right")
        tables.append(
            materialize(
                grown.select("id", "lang", "left", "right", "a",
                             F.concat("start", F.array("end")).alias("words"),
                             F.concat("firsts", F.array("a")).alias("firsts"),
                             F.concat("lasts", F.array("a")).alias("lasts")),
                "phrases",
            )
        )
    return tables, totals


# Counts below 10^17 keep all products exact: 1000 * a * n has at most 38 digits.
CUTS = """
array_min(transform(sequence(1, size(words) - 1), m -> struct(
    (1000 * cast(a AS decimal(17, 0)) * cast(n AS decimal(17, 0)))
        div (cast(element_at(firsts, m) AS decimal(17, 0)) * cast(element_at(lasts, size(words) - m) AS decimal(17, 0)))
        AS score,
    m AS cut, element_at(firsts, m) AS l, element_at(lasts, size(words) - m) AS r)))
"""


def collocations(
    df: DataFrame,
    least: int = 100,
    longest: int = 5,
    top: int = 2000,
    covered: int = 100,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the `top` best-scored phrases of every language.

    A phrase has 2 to `longest` words and at least `least` occurrences a. Its score is the
    least floor(1000 * a * n / (l * r)) of all cuts in two, whose parts occur l and r times;
    of equal ones the first cut's parts are shown. A phrase inside a longer one with at
    least `covered` percent of its occurrences is left out; it is enough to look one word
    further, as phrases in between occur at least as often as the longer one.

    Null languages count as `und`, null and empty texts have no words, repeated rows count
    each, ties are ordered by occurrences and then by the phrase, an empty table gives no
    rows. Other columns are not read.
    """
    tables, totals = frequent_phrases(df, least, longest, lang_col, text_col)
    shown = None
    for at in range(1, len(tables)):
        phrases = tables[at].drop("left", "right")
        if at + 1 < len(tables):
            longer = tables[at + 1].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("most"))
            phrases = phrases.join(longer.groupBy("id").agg(F.max("most").alias("most")), "id", "left")
            phrases = phrases.where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most")
        shown = phrases if shown is None else shown.unionByName(phrases)
    if shown is None:
        return df.sparkSession.createDataFrame(
            [], "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        )
    scored = shown.join(totals, "lang").withColumn("best", F.expr(CUTS)).withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    placed = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return placed.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score"
    )
