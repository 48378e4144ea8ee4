"""Delimited files with quoted line breaks, read by many tasks per file.

Spark reads text by ranges of a file and gives every line to the range it starts in. Whether
a range starts inside a quoted field depends on all ranges before it. So one pass finds,
for each range and for both answers, whether it ends inside a field, and the lines of a
record that begins in an earlier or ends in a later range. These short summaries, one row
per range, are combined along each file. A second pass reads every range from its own
state; records that reach across ranges are put together from the summaries.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantmill.session import materialize, ship_code

QUOTE = '"'
# Text of one record that a summary keeps; a longer record makes its file one task's work.
LONGEST_PART = 1 << 24
# The place of a record that reaches into the next range, after all others of its range.
LAST = 1 << 40

_TRACK = "struct<ends boolean, head string, tail string, too_long boolean>"
SUMMARY = f"file string, block long, closed {_TRACK}, open {_TRACK}"
RECORDS = "file string, block long, row long, record string"


def ends_inside(line: str, inside: bool, sep: str = "\t") -> bool:
    """Whether a line that begins inside (or outside) a quoted field ends inside one.

    A quote opens a field only as its first character, and two quotes inside stand for one.
    A closing quote that neither separator nor line end follows makes the rest of the field
    plain text.
    """
    at = 0
    if not inside:
        if not line.startswith(QUOTE):
            at = line.find(sep + QUOTE)
            if at < 0:
                return False
            at += len(sep)
        at += 1
    while True:
        at = line.find(QUOTE, at)
        if at < 0:
            return True
        if line.startswith(QUOTE, at + 1):
            at += 2
            continue
        at = line.find(sep + QUOTE, at + 1)
        if at < 0:
            return False
        at += len(sep) + 1


def range_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, block, line): every line with its file and the start of the range that read it."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of batches that come from one range. A task reads its ranges one after the other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        names = files.indices.to_numpy()
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (names[1:] != names[:-1])) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield files.dictionary[int(names[start])].as_py(), int(blocks[start]), batch.slice(start, stop - start)


def _with_quotes(lines: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring(lines, QUOTE).to_numpy(zero_copy_only=False)).tolist()


class _Track:
    """A range read from one of both states: where it ends, and the records that reach out of it."""

    def __init__(self, inside: bool):
        self.inside = inside
        self.in_head = inside
        self.head: list[str] = []
        self.tail: list[str] = []
        self.size, self.head_too_long, self.tail_too_long = 0, False, False

    def _keep(self, line: str) -> None:
        self.size += len(line) + 1
        if self.size <= LONGEST_PART:
            (self.head if self.in_head else self.tail).append(line)
        elif self.in_head:
            self.head_too_long = True
        else:
            self.tail_too_long = True

    def plain(self, lines: pa.Array) -> None:
        """Lines without a quote."""
        if self.inside and not (self.head_too_long if self.in_head else self.tail_too_long):
            for line in lines.to_pylist():
                self._keep(line)

    def line(self, line: str, sep: str) -> None:
        before, self.inside = self.inside, ends_inside(line, self.inside, sep)
        if before or self.inside:
            self._keep(line)
        if before and not self.inside:
            self.in_head, self.tail, self.size, self.tail_too_long = False, [], 0, False

    def told(self) -> dict:
        tail = "\n".join(self.tail) if self.inside and not self.in_head else None
        return {
            "ends": self.inside,
            "head": "\n".join(self.head),
            "tail": tail,
            "too_long": self.head_too_long or self.tail_too_long,
        }


def summaries(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """One row of SUMMARY for every range: as read from outside and from inside a field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("ends", pa.bool_()), ("head", pa.string()), ("tail", pa.string()), ("too_long", pa.bool_())])
        key, closed, open_ = None, _Track(False), _Track(True)

        def told() -> pa.RecordBatch:
            columns = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([closed.told()], kind), pa.array([open_.told()], kind)]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "closed", "open"])

        for file, block, part in _ranges(batches):
            if key != (file, block):
                if key is not None:
                    yield told()
                key, closed, open_ = (file, block), _Track(False), _Track(True)
            lines, at = part.column(2), 0
            for quoted in [*_with_quotes(lines), len(lines)]:
                for track in (closed, open_):
                    track.plain(lines.slice(at, quoted - at))
                    if quoted < len(lines):
                        track.line(lines[quoted].as_py(), sep)
                at = quoted + 1
        if key is not None:
            yield told()

    return range_lines(ship_code(spark), path).mapInArrow(run, SUMMARY)


def with_states(summary: DataFrame) -> DataFrame:
    """Each range with the state it begins in, `opens`.

    A range whose end does not depend on its beginning settles the state for those after
    it; the others keep or flip it. There is one row per range of a file.
    """
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("closed.ends") == F.col("open.ends")
    flips = (~settles & F.col("closed.ends")).cast("int")
    placed = summary.withColumn("_flips", F.coalesce(F.sum(flips).over(along), F.lit(0)))
    ended = F.last(F.when(settles, F.col("closed.ends")), True).over(along)
    flipped = F.last(F.when(settles, F.col("_flips")), True).over(along)
    since = F.col("_flips") - F.coalesce(flipped, F.lit(0))
    opens = F.coalesce(ended, F.lit(False)) != (since % 2 == 1)
    return placed.select("file", "block", opens.alias("opens"))


def with_texts(summary: DataFrame) -> DataFrame:
    """Each range with `opens` and what it is like when read from there.

    The texts of a summary do not go through the windows of a file: one task would get those of all ranges.
    """
    flags = summary.select("file", "block", F.struct("closed.ends").alias("closed"), F.struct("open.ends").alias("open"))
    # One row for each range of a file.
    found = summary.join(F.broadcast(with_states(flags)), ["file", "block"])
    return found.select("file", "block", "opens", F.when(F.col("opens"), F.col("open")).otherwise(F.col("closed")).alias("read"))


def across_ranges(states: DataFrame) -> DataFrame:
    """Rows of RECORDS for the records that reach from one range into others."""
    head = F.when(F.col("opens"), F.struct(F.lit(0).alias("part"), F.col("read.head").alias("text")))
    tail = F.when(F.col("read.tail").isNotNull(), F.struct(F.lit(1).alias("part"), F.col("read.tail").alias("text")))
    parts = states.select("file", "block", F.inline(F.array_compact(F.array(head, tail))))
    begun = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("number", F.sum("part").over(begun))
    whole = numbered.groupBy("file", "number").agg(
        F.min("block").alias("first"), F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("parts")
    )
    record = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return whole.select("file", F.col("first").alias("block"), F.lit(LAST).cast("long").alias("row"), _without_return(record).alias("record"))


def _without_return(record):
    """The record without the carriage return of its line end."""
    return F.when(F.endswith(record, F.lit("\r")), F.left(record, F.length(record) - 1)).otherwise(record)


def within_ranges(lines: DataFrame, header: list[str], sep: str) -> DataFrame:
    """Rows of RECORDS for the records inside one range, from rows (file, block, line, opens).

    The first record of every file must be the header; it is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, skip, row, held = None, False, False, 0, []
        for file, block, part in _ranges(batches):
            if key != (file, block):
                key, inside, row, held = (file, block), part.column(3)[0].as_py(), 0, []
                skip = inside
            lines = part.column(2)
            ends = np.ones(len(lines), bool)
            if inside or QUOTE in lines[0].as_py() or pc.any(pc.match_substring(lines, QUOTE)).as_py():
                at = 0
                for quoted in [*_with_quotes(lines), len(lines)]:
                    ends[at:quoted] = not inside
                    if quoted < len(lines):
                        inside = ends_inside(lines[quoted].as_py(), inside, sep)
                        ends[quoted] = not inside
                    at = quoted + 1
            stops = np.flatnonzero(ends) + 1
            done = int(stops[-1]) if len(stops) else 0
            records: list[str] | pa.Array = pa.array([], pa.string())
            if len(stops):
                offsets = pa.array(np.concatenate([[0], stops]).astype(np.int32))
                records = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.slice(0, done)), "\n")
                if held:
                    first = "\n".join([*held, records[0].as_py()])
                    records = pa.concat_arrays([pa.array([first], pa.string()), records.slice(1).cast(pa.string())])
                    held = []
                if skip:  # the end of a record from an earlier range
                    records, skip = records.slice(1), False
            held += lines.slice(done).to_pylist()
            if not len(records):
                continue
            records = pc.replace_substring_regex(records, "\r$", "")
            if block == 0 and row == 0:
                found = next(csv.reader([records[0].as_py().removeprefix("\ufeff")], delimiter=sep), [])
                if found != header:
                    raise ValueError(f"CSV header does not conform to the other files: {file} has {found}, not {header}")
                records, row = records.slice(1), 1
            numbers = np.arange(row, row + len(records))
            row += len(records)
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(records), pa.string()), pa.array(np.full(len(records), block)), pa.array(numbers), records.cast(pa.string())],
                names=["file", "block", "row", "record"],
            )

    return lines.mapInArrow(run, RECORDS)


def split_records(spark: SparkSession, path: str | list[str], header: list[str], sep: str = "\t") -> DataFrame | None:
    """Rows of RECORDS of all files: every record's text and its place, headers left out.

    (file, block, row) orders the records as they stand in the files. None if a record is
    too long to be put together: such files are for a reader that takes them whole.
    """
    states = materialize(with_texts(materialize(summaries(spark, path, sep), "summaries")), "ranges")
    across, too_long = states.agg(F.max(F.col("opens") | F.col("read.ends")), F.max("read.too_long")).first()
    if too_long:
        return None
    # One row for each range of a file that begins inside a field.
    opened = F.broadcast(states.where("opens").select("file", "block", "opens"))
    lines = range_lines(spark, path).join(opened, ["file", "block"], "left")
    inside = within_ranges(lines.select("file", "block", "line", F.coalesce("opens", F.lit(False)).alias("opens")), header, sep)
    return inside.unionByName(across_ranges(states)) if across else inside
