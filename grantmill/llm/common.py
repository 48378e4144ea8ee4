"""What the operators share: table access, code for the executors, checkpoints, batches."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# Text bytes that one Python step handles at a time.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _archive() -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="grantmill-"), "grantmill_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, as --py-files would."""
    context = spark.sparkContext
    if not any("grantmill_code.zip" in str(f) for f in context._python_includes):
        context.addPyFile(_archive())
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder in spark.checkpoint.dir that all executors share.

    Only a local session without that setting gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="grantmill-checkpoint-"))
    return df.checkpoint()


def free_name(wanted: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes in one string column; a single row may be larger."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = used = 0
    for row, size in enumerate(sizes):
        if row > start and used + size > limit:
            yield batch.slice(start, row - start)
            start, used = row, 0
        used += int(size)
    yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: int) -> list[str]:
    """The texts of a column; a null is an empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


_held: dict[int, dict | Remembered] = {}
_holder = ""


def hold(owner: str, memory: dict | Remembered) -> None:
    """Let one operator at a time remember in this process; what the one before it remembered is forgotten.

    Python workers serve the steps of a session in turn, and would end with what all of them remembered.
    """
    global _holder
    if owner != _holder:
        for kept in _held.values():
            kept.clear()
        _held.clear()
        _holder = owner
    _held[id(memory)] = memory


class Remembered[V]:
    """A bounded memory of two generations: what was used since the last turn, and before it."""

    def __init__(self, limit: int, owner: str = ""):
        self.limit = limit
        self.owner = owner
        self.now: dict[str, V] = {}
        self.before: dict[str, V] = {}

    def clear(self) -> None:
        self.now, self.before = {}, {}

    def turn(self) -> dict[str, V]:
        """The current generation, a new one if it is full."""
        if self.owner:
            hold(self.owner, self)
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        return self.now

    def recall(self, keys: set[str]) -> set[str]:
        """Take what the older generation knows into the current one; the keys neither knows."""
        old = keys & self.before.keys()
        self.now.update((k, self.before[k]) for k in old)
        return keys - old


def remember(cache: dict, limit: int, owner: str) -> None:
    """Forget everything once a cache is full; only speed depends on it."""
    hold(owner, cache)
    if len(cache) > limit:
        with suppress(KeyError):
            cache.clear()
