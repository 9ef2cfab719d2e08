"""Wall times of the headline queries. Prints one line of JSON.

Every query is run in full and its rows are thrown away, as are the tables it settled.
``what_if_call`` is one scenario with one new project and no head count, the call that
project; both start from the bare fact. ``prepare`` makes the unit rates and the project
history, and the ``prepared_*`` entries use them: single calls, and batches of 1, 100 and
10,000 scenarios in one job.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from staffcast.operators.spread import scratch  # noqa: E402
from staffcast.plans import report  # noqa: E402
from staffcast.sources.readers import scenario_rows  # noqa: E402
from staffcast_checks import fixture  # noqa: E402
from staffcast_checks.catalog import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "function_rates", "department_rates", "project_profile", "opening_hours",
    "history_report", "rate_report", "project_ratio", "project_hours", "start_proration",
    "scenario_batch", "allocation_share", "project_month_profile", "life_pivot",
    "life_statistics", "project_load", "headcount_plan", "purge_user",
)
PROJECT = {
    "project_code": "N7", "project_name": "bench", "project_code_old": "P30",
    "execute_hour": 1200, "execute_month": 6, "start_date": "2001/9/20",
}
HEAD = {
    "HC": 1, "div": "ASIA", "deptid": "NATION_2", "project_code": "", "project_name": "",
    "sub_job_family": "HW",
}


def seconds(spark: SparkSession, make) -> float:
    start = time.perf_counter()
    with scratch(spark):
        make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("staffcast-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="staffcast-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    fact = fixture.recent_utilization(spark, SF_DIR)
    end = fixture.last_month(spark, SF_DIR)
    projects = fixture.utilization(spark, SF_DIR, units=False)

    def call(planned: list, staffed: list, **prepared) -> DataFrame:
        tables = scenario_rows(spark, "ASIA", "001", planned, staffed)
        return report.score_scenarios(fact, *tables, end, project_fact=projects, **prepared)

    def batch(count: int, **prepared) -> DataFrame:
        asked = F.col("scenario_id") <= count
        tables = (fixture.scenarios, fixture.plan_projects, fixture.plan_headcount)
        rows = [make(spark, SF_DIR).where(asked) for make in tables]
        return report.score_scenarios(fact, *rows, end, project_fact=projects, **prepared)

    # The first query pays for starting Spark; it is run once before it is timed.
    seconds(spark, lambda: QUERIES[HEADLINE[0]](spark, SF_DIR))
    times = {
        name: seconds(spark, lambda name=name: QUERIES[name](spark, SF_DIR)) for name in HEADLINE
    }
    times["what_if_call"] = seconds(spark, lambda: call([PROJECT], []))
    times["head_count_call"] = seconds(spark, lambda: call([], [HEAD]))
    start = time.perf_counter()
    ready = {"units": report.prepare_units(fact, end), "history": report.prepare_history(projects)}
    times["prepare"] = time.perf_counter() - start
    times["prepared_what_if_call"] = seconds(spark, lambda: call([PROJECT], [], **ready))
    times["prepared_head_count_call"] = seconds(spark, lambda: call([], [HEAD], **ready))
    for count in (1, 100, 10_000):
        times[f"prepared_batch_{count}"] = seconds(spark, lambda count=count: batch(count, **ready))

    scored = fixture.table(spark, SF_DIR, "customer").count()
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {name: round(t, 3) for name, t in times.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "scenarios_per_sec": round(scored / times["scenario_batch"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
