"""Session settings, the shared scratch folder, and this package's code for executors."""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# A join whose output partitioning is used again downstream is left unsplit by
# default. Splitting a hot key is worth the extra exchange.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Text repeats in columnar files, and a table of some megabytes may be hundreds in memory. Counted by its
    # file size alone it would be collected by the driver and broadcast.
    "spark.sql.sources.fileCompressionFactor": "16",
    # Rows of a large table that a join drops are mostly left out where the table is read, by
    # a Bloom filter of 8 MB over the other side's keys; the join itself stays exact. Spark's
    # own limits would leave it out where the other side has more than some megabytes. Sizes
    # are counted with the factor above: 16 GB are files of 1 GB.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "16GB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1600GB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "10000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "10000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(1 << 26),
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(1 << 26),
}

# A task sorts and groups what it reads, in many times the room of its compressed shuffle blocks. So large shuffles
# are cut finely and small ones put together again: no task's share grows with the tables. A local session
# keeps its own number of partitions, as its tables are small.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "500",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
}


def is_local(spark: SparkSession) -> bool:
    """Whether the driver's process is the only executor."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the plans rely on to an existing session."""
    for name, value in (RUNTIME_SETTINGS if is_local(spark) else {**RUNTIME_SETTINGS, **CLUSTER_SETTINGS}).items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str | int = "*", memory: str = "8g", app: str = "grantmill") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    partitions = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@functools.cache
def _private_folder() -> str:
    return tempfile.mkdtemp(prefix="grantmill-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share.

    The cluster names that folder in spark.checkpoint.dir, or the session sets it with
    setCheckpointDir. Only a local session without either gets a private one: elsewhere
    each executor would write to its own disk.
    """
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    base = chosen.get() if chosen.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _private_folder()
    return f"{base.rstrip('/')}/grantmill-{uuid.uuid4().hex}/{name}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system Spark reads, if it is there."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.mkdirs(target)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """The paths in a folder; none if it is not there."""
    system, target = _file_system(spark, path)
    return [status.getPath().toString() for status in system.listStatus(target)] if system.exists(target) else []


_open_areas: list[list[str]] = []
_kept_to_the_end: list[str] = []


@atexit.register
def _drop_scratch() -> None:
    """Delete scratch tables of lazy results if the session is still there; a lost one leaves them to the folder's owner."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _kept_to_the_end:
        with suppress(Exception):
            delete_path(spark, path)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each action inside when it ends, for steps that read each other's written tables only.

    Spark keeps them until the driver collects its garbage, so a driver with room to spare lets the
    shuffles of all steps pile up on the executors' disks. An action repeated on the same DataFrame shuffles again.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


@contextmanager
def scratch_area(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is materialized inside, for steps that end with a write of their own."""
    written: list[str] = []
    _open_areas.append(written)
    try:
        yield
    finally:
        _open_areas.remove(written)
        for path in written:
            delete_path(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and tells Spark the size. The table
    goes with the innermost ``scratch_area``; without one it goes with this process.
    """
    path = scratch_path(df.sparkSession, name)
    (_open_areas[-1] if _open_areas else _kept_to_the_end).append(path.rpartition("/")[0])
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _code_archive() -> str:
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="grantmill-"), "grantmill_core.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    return path


def ship_code(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, as --py-files would."""
    context = spark.sparkContext
    if not any("grantmill_core.zip" in str(f) for f in context._python_includes):
        context.addPyFile(_code_archive())
    return spark


def run_together(spark: SparkSession, *jobs: Callable[[], object]) -> None:
    """Run independent actions at the same time; the first error is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()


def materialize_together(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """``materialize`` for several tables with their names, written at the same time."""
    read: dict[int, DataFrame] = {}

    def write(at: int, df: DataFrame, name: str) -> None:
        read[at] = materialize(df, name)

    run_together(tables[0][0].sparkSession, *[functools.partial(write, i, *t) for i, t in enumerate(tables)])
    return [read[i] for i in range(len(tables))]
