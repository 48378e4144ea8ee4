"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents longer than a sequence are cut. Pieces of full length have a sequence of
their own; the rest is packed. A round range-sorts the open pieces and the gaps of all
sequences by size, largest first. A sweep per range gives each piece the smallest gap
that still holds it: gaps are stacked as they come, a piece takes the top. Pieces and
gaps a range is left with are matched by their rank across ranges, for which only two
numbers per range are gathered. Gaps shrink, and the next round begins. Pieces larger
than every gap open as many new sequences as their tokens need at least.

Pieces over half a sequence come first, then those over a quarter, then all others; a
class hands what is left of it to the next one once it is small. A gap that holds
several of the largest open pieces offers itself several times in a round, so that the
number of rounds depends on the shape of the lengths and hardly on their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.llm import bpe
from grantmill.llm.common import checkpoint, chunks, ship, texts

# Rows that one sweep should get; it decides the number of ranges only.
SWEEP_ROWS = 200_000
CLASSES = (0.5, 0.25, 0.0)
HANDED_ON = 0.3

GAP, PIECE = 0, 1


def cut(
    df: DataFrame, vocab: Broadcast, limit: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id_col, piece, start, length, ids) with ids as little-endian 32-bit numbers.

    A document is the ids of its text and then end_id, so a null or empty text is one
    piece of one token. Repeated rows and null ids are documents of their own.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType(), False),
            T.StructField("start", T.LongType(), False),
            T.StructField("length", T.LongType(), False),
            T.StructField("ids", T.BinaryType(), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bpe.vocabulary(vocab.value)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in chunks(batch, 1):
                rows, starts, ids = [], [], []
                for row, coded in enumerate(bpe.encode_texts(known, texts(part, 1))):
                    coded += end
                    for at in range(0, len(coded), 4 * limit):
                        rows.append(row)
                        starts.append(at // 4)
                        ids.append(coded[at : at + 4 * limit])
                start = np.array(starts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)),
                        pa.array((start // limit).astype(np.int32)),
                        pa.array(start),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=schema.names,
                )

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, largest first: each piece takes the top of the stack of gaps before it.

    Pieces without a gap here and gaps without a piece are numbered in order.
    """
    where = TaskContext.get().partitionId()
    stack: list[tuple[int, int]] = []
    lone = 0

    def made(kinds: list, ids: list, sizes: list, sequences: list, places: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(kinds, pa.int32()),
                pa.array(ids, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(sequences, pa.int64()),
                pa.array([where] * len(ids), pa.int32()),
                pa.array(places, pa.int64()),
            ],
            names=["kind", "id", "size", "sequence", "part", "place"],
        )

    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for kind, number, size in zip(*(batch.column(c).to_pylist() for c in ("kind", "id", "size")), strict=True):
            if kind == GAP:
                stack.append((number, size))
                continue
            if stack:
                row = (PIECE, number, size, stack.pop()[0], None)
            else:
                row = (PIECE, number, size, None, lone)
                lone += 1
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield made(*out)
    for at in range(0, len(stack), 10_000):
        some = stack[at : at + 10_000]
        n = len(some)
        yield made([GAP] * n, [g for g, _ in some], [s for _, s in some], [g for g, _ in some], [*range(at, at + n)])


def _across(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which gaps lone pieces take, from (part, lone pieces, gaps left): rows (part, place,
    count, gap part, gap place); the piece `place + i` takes the gap `gap place - i`."""
    stack: list[list[int]] = []
    runs: list[tuple[int, int, int, int, int]] = []
    for part, pieces, gaps in sorted(parts):
        place = 0
        while place < pieces and stack:
            top = stack[-1]
            n = min(pieces - place, top[1])
            runs.append((part, place, n, top[0], top[1] - 1))
            top[1] -= n
            place += n
            if not top[1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return runs


def assign(pieces: DataFrame, limit: int = 4096, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """Rows (id, sequence) for rows (id long unique, size long from 1 to limit).

    The sizes in a sequence add up to limit at most. A sequence is numbered by the piece
    that opened it. No pieces give no rows.
    """
    spark = ship(pieces.sparkSession)
    # A full piece leaves no gap and takes no part in the rounds.
    full = pieces.where(F.col("size") >= limit).select("id", F.col("id").alias("sequence"))
    todo = checkpoint(pieces.where(F.col("size") < limit).select("id", F.col("size").cast("long").alias("size")))
    placed = [full]
    nothing = spark.createDataFrame([], "id long, size long")
    gaps, waiting = nothing, nothing
    n_gaps = held = 0
    upper = limit
    for share in CLASSES:
        lower = int(limit * share)
        waiting = waiting.unionByName(todo.where((F.col("size") > lower) & (F.col("size") <= upper)))
        upper = lower
        begun, most = waiting.agg(F.count("*"), F.max("size")).first()
        held = begun
        while held:
            # A gap that holds the largest piece several times stands for several gaps of that size.
            times = F.greatest(F.lit(1), F.floor(F.col("size") / F.lit(most)).cast("int"))
            offered = F.array_repeat(F.when(times > 1, F.lit(most)).otherwise(F.col("size")), times)
            items = waiting.select(F.lit(PIECE).alias("kind"), "id", "size").unionByName(
                gaps.select(F.lit(GAP).alias("kind"), "id", F.explode(offered).alias("size"))
            )
            order = [F.desc("size"), F.col("kind"), F.col("id")]
            ranges = math.ceil((held + n_gaps) / sweep_rows)
            ranged = items.repartitionByRange(ranges, *order) if ranges > 1 else items.repartition(1)
            swept = checkpoint(
                ranged.sortWithinPartitions(*order).mapInArrow(
                    _sweep, "kind int, id long, size long, sequence long, part int, place long"
                )
            )
            lone = swept.where((F.col("kind") == PIECE) & F.col("place").isNotNull())
            counts = [
                tuple(r)
                for r in swept.where("place is not null")
                .groupBy("part")
                .agg(F.count_if(F.col("kind") == PIECE), F.count_if(F.col("kind") == GAP))
                .collect()
            ]
            runs = _across(counts)
            taken = swept.where((F.col("kind") == PIECE) & F.col("place").isNull()).select("id", "size", "sequence")
            if runs:
                taken = taken.unionByName(_take_across(swept, lone, runs))
            # What an earlier range had left over went to the first lone pieces of a later one.
            matched = dict.fromkeys((part for part, _, _ in counts), 0)
            for part, place, n, _, _ in runs:
                matched[part] = place + n
            taken = checkpoint(taken) if runs else taken
            placed.append(taken.select("id", "sequence"))
            gaps = checkpoint(
                gaps.unionByName(taken.select(F.col("sequence").alias("id"), (-F.col("size")).alias("size")))
                .groupBy("id")
                .agg(F.sum("size").alias("size"))
                .where("size > 0")
            )
            n_gaps, widest = gaps.agg(F.count("*"), F.max("size")).first()
            waiting = _after(lone, matched)
            # Pieces no gap holds are the first ones of each range that are still open.
            homeless = F.col("size") > F.lit(widest or 0)
            per_part = {
                part: row
                for part, *row in waiting.groupBy("part")
                .agg(F.count("*"), F.count_if(homeless), F.sum(F.when(homeless, F.col("size"))), F.max("size"))
                .collect()
            }
            held = sum(row[0] for row in per_part.values())
            rest = sum(row[1] for row in per_part.values())
            if rest:
                most = max(row[3] for row in per_part.values())
                tokens = sum(row[2] or 0 for row in per_part.values())
                rest = opened = rest if lower >= limit // 2 else min(rest, -(-tokens // limit))
                through = dict(matched)
                for part in sorted(per_part):
                    n = min(rest, per_part[part][1])
                    through[part] = matched.get(part, 0) + n
                    rest -= n
                seeds = _between(lone, matched, through)
                placed.append(seeds.select("id", F.col("id").alias("sequence")))
                gaps = gaps.unionByName(seeds.select("id", (limit - F.col("size")).alias("size")))
                waiting = _after(lone, through)
                held -= opened
                n_gaps += opened
            elif held:
                most = max(row[3] for row in per_part.values())
            waiting = waiting.select("id", "size")
            if lower and held <= HANDED_ON * begun:
                break
    result = placed[0]
    for more in placed[1:]:
        result = result.unionByName(more)
    return result


def _bound(places: dict[int, int]) -> Column:
    """The number given for a row's range; there are as few numbers as ranges."""
    return F.array(*[F.lit(places.get(part, 0)).cast("long") for part in range(max(places) + 1)])[F.col("part")]


def _after(lone: DataFrame, places: dict[int, int]) -> DataFrame:
    return lone.where(F.col("place") >= _bound(places)) if any(places.values()) else lone


def _between(lone: DataFrame, places: dict[int, int], through: dict[int, int]) -> DataFrame:
    if not any(through.values()):
        return lone.limit(0)
    return _after(lone, places).where(F.col("place") < _bound(through))


def _take_across(swept: DataFrame, lone: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The lone pieces' gaps from other ranges, by equal rank; runs are as few as ranges."""
    told = lone.sparkSession.createDataFrame(
        runs, "run_part int, first long, n long, gap_part int, gap_place long"
    )
    inside = (
        (F.col("part") == F.col("run_part"))
        & (F.col("place") >= F.col("first"))
        & (F.col("place") < F.col("first") + F.col("n"))
    )
    wanted = lone.join(F.broadcast(told), inside).select(
        "id", "size", "gap_part", (F.col("gap_place") - (F.col("place") - F.col("first"))).alias("gap_place")
    )
    spare = swept.where(F.col("kind") == GAP).select(
        F.col("part").alias("gap_part"), F.col("place").alias("gap_place"), "sequence"
    )
    return wanted.join(spare, ["gap_part", "gap_place"]).select("id", "size", "sequence")


def pack(pieces: DataFrame, limit: int = 4096, length_col: str = "length") -> DataFrame:
    """The given rows with sequence_id and offset, where columns of these names are replaced.

    Pieces of length zero or null, or longer than the limit, can't be placed: sequence_id
    and offset are null. Offsets start at zero in each sequence and leave no gap.
    """
    keyed = checkpoint(
        pieces.drop("sequence_id", "offset").select(
            F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")
        )
    )
    length = F.col("row").getField(length_col)
    sized = keyed.select("id", length.cast("long").alias("size")).where((F.col("size") >= 1) & (F.col("size") <= limit))
    sequences = assign(sized, limit)
    # At most `limit` pieces share a sequence and those without one stand alone, so the window's groups are small.
    together = Window.partitionBy(F.coalesce("sequence", -1 - F.col("id"))).orderBy("id")
    offset = F.coalesce(F.sum(length).over(together.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = keyed.join(sequences, "id", "left").withColumn("offset", F.when(F.col("sequence").isNotNull(), offset))
    return placed.select("row.*", F.col("sequence").alias("sequence_id"), "offset")
