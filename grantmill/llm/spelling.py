"""Spelling variants: words one edit apart, grouped under their most frequent form.

Two words one insertion, deletion or replacement apart share their first half or all after
it: with h = half the shorter length, the first h code points are the same, or else the
rest of the shorter word ends both. So each word joins four groups, by its first half and
by its rest, as the shorter and as the longer word of a pair; a pair counts in the group
of the first half if that is the same, and in the other one if not, so it counts once.

Groups are cut into blocks of hashed words, and blocks meet in pairs. A pair of blocks is
compared densely: padded matrices of code points give the common prefix and, reversed,
the common suffix of all their words at once. Words are one edit apart exactly if prefix
plus suffix reach the longer length less one. Only each word's number of near words and
its best one leave a block, no pairs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantmill.llm.common import chunks, ship, texts
from grantmill.session import materialize

# Rows of a group that are compared with each other in one block, rows that one task step
# holds, and cells of all block pairs compared at a time.
BLOCK_ROWS = 512
UNIT_ROWS = 1 << 16
CELLS_AT_ONCE = 1 << 18
COUNTED_AT_ONCE = 1 << 19
NO_RANK = np.iinfo(np.int32).max


def words_of(number: str, text: str, pattern: re.Pattern, least: int, every: int) -> list[str]:
    """Lower-cased runs of at least so many code points, one in `every` with a code point less.

    Only A to Z are lowered. The hash of "number:run" decides which run loses one, and which.
    """
    start = zlib.crc32(f"{number}:".encode())
    found = []
    for run in pattern.findall(text.encode().lower().decode()):
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        found.append(run)
    return found


def count_words(
    df: DataFrame,
    letters: str,
    least: int,
    occurrences: int = 2,
    every: int = 31,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (word, n) of the words with at least so many code points and occurrences.

    `letters` is the inside of a pattern's brackets. Null texts are empty, a null id is an
    empty text before the colon.
    """
    pattern = re.compile(f"[{letters}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in chunks(batch, 1):
                for number, text in zip(part.column(0).to_pylist(), texts(part, 1), strict=True):
                    seen.update(words_of(number or "", text, pattern, least, every))
                if len(seen) > COUNTED_AT_ONCE:
                    yield told()
                    seen = Counter()
        yield told()

    ship(df.sparkSession)
    counted = df.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words, one word a row, padded with zeros; the same reversed; lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.uint8 if codes.max(initial=0) < 256 else np.uint32
    place = np.arange(sizes.max(initial=0))
    ahead = np.zeros((len(words), len(place)), kind)
    back = ahead.copy()
    ahead[place < sizes[:, None]] = codes
    # Each word's code points from its last one on.
    starts = sizes.cumsum() - sizes
    inside = place < sizes[:, None]
    back[inside] = codes[(starts[:, None] + sizes[:, None] - 1 - place)[inside]]
    return ahead, back, sizes


def common_length(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The common prefix of every two of the rows (g, m) of a matrix of codes, as (m, m, g).

    A row with itself counts as nothing, so that the search ends where all others differ.
    Groups are the innermost axis where there are more of them than rows in one.
    """
    g, m = rows.shape
    width = codes.shape[1]
    inner = g > m
    columns = np.ascontiguousarray(codes.T[:, rows.T if inner else rows])
    found = np.zeros((m, m, g) if inner else (g, m, m), np.uint8 if width < 64 else np.uint16)
    alive = np.ones(found.shape, bool)
    own = np.arange(m)
    if inner:
        alive[own, own] = False
    else:
        alive[:, own, own] = False
    same = np.empty_like(alive)
    for column in columns:
        if inner:
            np.equal(column[:, None, :], column[None, :, :], out=same)
        else:
            np.equal(column[:, :, None], column[:, None, :], out=same)
        alive &= same
        if not alive.any():
            break
        found += alive
    return found if inner else found.transpose(1, 2, 0)


def compare_unit(unit: pa.Table) -> pa.Table:
    """Each word of a unit's block pairs with its near words in them: (word, n_near, best, best_n)."""
    words, n = unit.column("word").to_pylist(), unit.column("n").to_numpy()
    half = unit.column("half").to_numpy()
    ends, shorter, block = (unit.column(c).to_numpy() for c in ("ends", "shorter", "block"))
    ahead, back, sizes = padded(words)
    # The most frequent word first, ties by code points.
    by_rank = sorted(range(len(words)), key=lambda r: (-n[r], words[r]))
    rank = np.empty(len(words), np.int32)
    rank[by_rank] = np.arange(len(words), dtype=np.int32)
    keys = [unit.column(c).to_numpy() for c in ("right", "left", "key")]
    order = np.lexsort(keys)
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(change)
    counts = np.diff(np.append(starts, len(order)))
    crossed = keys[0] != keys[1]
    widths = np.maximum.reduceat(sizes[order], starts) if len(starts) else starts
    # Groups of like size and width are compared together, filled up with a row that is
    # longer than any word and so near none.
    filler = len(words)
    ahead, back = (np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)]) for x in (ahead, back))
    shape_m = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64))
    shape_w = (widths + 7) // 8 * 8
    near = np.zeros(len(words), np.int64)
    best = np.full(len(words), NO_RANK, np.int32)
    for m, width in sorted({*zip(shape_m.tolist(), shape_w.tolist(), strict=True)}):
        which = np.flatnonzero((shape_m == m) & (shape_w == width) & (counts > 1))
        kind = np.uint8 if width < 64 else np.uint16
        size_of = np.append(sizes, 4 * width).astype(kind) if width < 64 else np.append(sizes, 1 << 15).astype(kind)
        step = max(1, CELLS_AT_ONCE // (m * m))
        for at in range(0, len(which), step):
            some = which[at : at + step]
            place = np.arange(m)
            real = place < counts[some, None]
            rows = np.where(real, order[np.where(real, starts[some, None] + place, 0)], filler)
            size = size_of[rows.T]
            prefix = common_length(ahead[:, :width], rows)
            reach = common_length(back[:, :width], rows)
            reach += prefix
            reach += 1
            i, j, group = np.nonzero(reach >= np.maximum(size[:, None, :], size[None, :, :]))
            shared = prefix[i, j, group]
            i, j = rows[group, i], rows[group, j]
            low = np.minimum(sizes[i], sizes[j])
            ok = (i != j) & (np.maximum(sizes[i], sizes[j]) - low <= 1) & (low == shorter[i])
            # Different groups whose keys have the same hash are told apart here.
            ok &= (ends[i] == ends[j]) & (shorter[i] == shorter[j])
            ok &= (shared >= half[i]) != ends[i]
            ok &= ~crossed[i] | (block[i] != block[j])
            i, j = i[ok], j[ok]
            near += np.bincount(i, minlength=len(near))
            np.minimum.at(best, i, rank[j])
    have = np.flatnonzero(near)
    of = [by_rank[r] for r in best[have].tolist()]
    return pa.table(
        {
            "word": pa.array([words[r] for r in have.tolist()], pa.string()),
            "n_near": pa.array(near[have]),
            "best": pa.array([words[r] for r in of], pa.string()),
            "best_n": pa.array(n[of], pa.int64()),
        }
    )


def near_words(words: DataFrame, least: int) -> DataFrame:
    """Rows (word, n_near, best, best_n) of the words that have near words, for rows (word, n).

    Words are different from each other, not null, and have at least `least` code points.
    The best near word has the largest n, ties the smallest in code-point order.
    """
    spark = ship(words.sparkSession)

    def group(shorter: int, ends: bool):
        """As the word of length `length - shorter` or one more: by the first half, or by the rest."""
        base = F.col("length") - shorter
        half = F.floor(base / 2).cast("int")
        affix = F.right("word", base - half) if ends else F.left("word", half)
        return F.struct(base.alias("shorter"), half.alias("half"), F.lit(ends).alias("ends"), F.xxhash64(base, F.lit(ends), affix).alias("key"))

    groups = F.array(*[group(shorter, ends) for shorter in (0, 1) for ends in (False, True)])
    spread = (
        words.withColumn("length", F.length("word"))
        .select("word", "n", F.inline(groups))
        .where(F.col("shorter") >= least)
    )
    blocks = F.ceil(F.col("rows") / F.lit(BLOCK_ROWS)).cast("int")
    sizes = spread.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    sizes = materialize(sizes.select("key", blocks.alias("blocks"), "rows"), "group_sizes")
    total = sizes.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0] or 0
    units = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / UNIT_ROWS))
    placed = spread.join(sizes.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = met.select(
        "word", "n", "shorter", "half", "ends", "key", "block",
        F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
    )
    unit = F.pmod(F.xxhash64("key", "left", "right"), F.lit(units)).cast("int").alias("unit")
    compared = paired.groupBy(unit).applyInArrow(compare_unit, "word string, n_near long, best string, best_n long")
    return (
        compared.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("order"), "best")).alias("first"))
        .select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.order")).alias("best_n"))
    )


def roots(forms: DataFrame, most_steps: int) -> DataFrame:
    """Rows (word, root): the end of the chain of forms from every word of rows (word, form).

    Each round doubles the steps a row has taken; no chain has more than `most_steps`.
    """
    step = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(0, math.ceil(math.log2(max(1, most_steps))))):
        further = step.select(F.col("word").alias("root"), F.col("root").alias("end"))
        step = materialize(step.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root")), "forms")
    return step


def variants(words: DataFrame, least: int, ratio: int = 10) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each row (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point order) if
    that is at least `ratio` times its own n, else null, and form_n that n. The root is where
    the forms lead to, the word itself without one. n grows at each step, so no chain has
    more steps than the largest n has powers of `ratio`. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("chains of forms end only if n grows: ratio is 2 or more")
    words = materialize(words.select("word", "n"), "words")
    near = near_words(words, least)
    is_form = F.col("best_n") >= F.col("n") * ratio
    linked = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    linked = materialize(linked, "near_words")
    largest = linked.agg(F.max("n")).first()[0] or 1
    ends = roots(linked.where(F.col("form").isNotNull()), math.ceil(math.log(largest, ratio)) + 1)
    return linked.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
