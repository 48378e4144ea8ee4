"""Time the cleaning, loading and report steps; print one JSON line.

Raw tables are derived from $BENCH_SF_DIR. Cleaning steps run over them, the
load step writes the star, and the reports read the written star, as a user
would run them. Every step runs once to warm up; the better of two more runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.fixtures import Fixtures  # noqa: E402
from grantmill.plans import clean, datasets, reports  # noqa: E402
from grantmill.plans.star import StoredStar, build_star  # noqa: E402
from grantmill.session import local_session, materialize  # noqa: E402


def _drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _timed(step: Callable[[], object]) -> float:
    start = time.perf_counter()
    step()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"), app="bench")
    root = tempfile.mkdtemp(prefix="grantmill-bench-")

    raw = Fixtures(spark, sf_dir)
    star = StoredStar(spark, f"{root}/star")
    steps: dict[str, Callable[[], object]] = {
        "clean_patents": lambda: _drain(raw.clean_patents),
        "clean_inventors": lambda: _drain(raw.star.inventors),
        "clean_companies": lambda: _drain(raw.star.companies),
        "clean_relationships": lambda: _drain(
            clean.clean_relationships(
                materialize(raw.clean_patent_inventor, "pi"), materialize(raw.clean_patent_company, "pc")
            )
        ),
        "build_star": lambda: build_star(spark, raw, f"{root}/star"),
        "q1_top_inventors": lambda: reports.top_inventors(star).collect(),
        "q2_top_companies": lambda: reports.top_companies(star).collect(),
        "q3_top_countries": lambda: reports.top_countries(star).collect(),
        "q4_patents_per_year": lambda: reports.yearly_trend(star).collect(),
        "q5_patent_detail": lambda: reports.patent_detail(star).collect(),
        "q6_top_companies_per_year": lambda: reports.top_companies_per_year(star).collect(),
        "q7_inventor_ranking": lambda: reports.inventor_ranking(star).collect(),
        "rank_all_inventors": lambda: _drain(reports.rank_all_inventors(star)),
        "patents_full_detail": lambda: _drain(reports.patents_full_detail(star)),
        "report_json": lambda: reports.report_json(star).collect(),
        "chart_country_share": lambda: datasets.chart_country_share(star).collect(),
        "dash_kpis": lambda: datasets.dash_kpis(star).collect(),
        "search_patents": lambda: datasets.search_patents(star, "tion").collect(),
    }
    seconds = {}
    for name, step in steps.items():
        step()
        seconds[name] = round(min(_timed(step) for _ in range(2)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of cleaning, load and reports",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
