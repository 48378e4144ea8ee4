"""Name, Spark query and oracle text of every check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import Fixtures
from checks.oracle import with_tables


@dataclass(frozen=True)
class Check:
    name: str
    run: Callable[[Fixtures], DataFrame]
    sql: str

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(Fixtures(spark, sf_dir))


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str):
    """Register a query under a name, with the SELECT that gives the same rows."""

    def register(run: Callable[[Fixtures], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"{name} is registered twice")
        CHECKS[name] = Check(name, run, with_tables(sql))
        return run

    return register
