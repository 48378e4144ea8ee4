from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.fixtures import Fixtures  # noqa: E402
from grantmill.plans.star import build_star  # noqa: E402
from grantmill.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="6g", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def fx(spark):
    return Fixtures(spark, SF_DIR)


@pytest.fixture(scope="session")
def stored(spark, fx, tmp_path_factory):
    return build_star(spark, fx, str(tmp_path_factory.mktemp("star")))


@pytest.fixture
def settings(spark):
    """Change runtime settings for one test."""
    changed = {}

    def change(**values):
        for name, value in values.items():
            key = "spark.sql." + name.replace("__", ".")
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def rows(df) -> list[tuple]:
    """Rows in an order that does not depend on the plan."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def executed_plan(df) -> str:
    """The final physical plan, after the query ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).toString()
