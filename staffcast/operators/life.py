"""Hours per entry of projects over the months of their life."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staffcast import schemas
from staffcast.functions import numeric

# The function and cut-off that are profiled, the number of month columns,
# and the statistics with the open hour ranges that are counted.
PROFILED_FUNCTION = "RH"
CUT_OFF = dt.date(2021, 7, 1)
LIFE_MONTHS = 50
RANGES = {
    "__50": (None, 50),
    "__100": (50, 100),
    "__200": (100, 200),
    "__300": (200, 300),
}

_LIFE = ["project_code", "sub_job_family_2"]
_ROW_ORDER = ["date", "start_stage", "stage", "pmcs_bu_start_dt"]


def project_month_profile(
    fact: DataFrame,
    projects: DataFrame,
    function: str = PROFILED_FUNCTION,
    before: dt.date = CUT_OFF,
) -> DataFrame:
    """Entries and hours of the listed projects by month, stage and start date.

    The list is applied to the combined rows: one per project, month, stage and start,
    however many entries a project has.
    """
    wanted = (F.col("sub_job_family_2") == function) & (F.col("date") < F.lit(before))
    grouped = (
        fact.where(wanted)
        .groupBy(
            *_LIFE, "date", F.col("project_start_stage").alias("start_stage"), "stage",
            "pmcs_bu_start_dt",
        )
        .agg(
            *[F.expr(f"avg({c}) AS {c}") for c in schemas.STAGE_DAYS],
            F.expr("count(1) AS cnt"),
            F.expr("sum(total_hour) AS sum_hour"),
        )
    )
    listed = grouped.join(projects.select("project_code"), "project_code", "left_semi")
    return (
        listed.withColumn(
            "hour_per_cnt",
            F.expr(numeric.round_to(numeric.safe_div("sum_hour", "cnt"), 1)),
        )
        .withColumn("No", F.row_number().over(W.partitionBy("project_code").orderBy(
            "sub_job_family_2", *_ROW_ORDER
        )))
    )


def life_months(profile: DataFrame) -> DataFrame:
    """Profile rows numbered over the life of each project: 1, 2, 3 and so on."""
    life = W.partitionBy(*_LIFE).orderBy(*_ROW_ORDER)
    return profile.withColumn("ordinal", F.row_number().over(life))


def fits(width: int) -> str:
    """True, or an error where a project lived longer than the month columns of a sheet."""
    message = f"a project lived longer than the {width} months of the sheet"
    return f"isnull(assert_true(max(ordinal) <= {width}, '{message}'))"


def life_pivot(months: DataFrame, width: int = LIFE_MONTHS) -> DataFrame:
    """One row per project: first and last month, start, and the hours side by side.

    The sheet has ``width`` month columns whatever the data; a longer life is an error
    (the months themselves have no such bound).
    """

    def at(n: int, value: str, name: str) -> Column:
        return F.expr(f"max(CASE WHEN ordinal = {n} THEN {value} END) AS `{name}`")

    return months.groupBy(*_LIFE).agg(
        at(1, "start_stage", "start_stage"),
        at(1, "pmcs_bu_start_dt", "pmcs_bu_start_dt"),
        F.expr("min(date) AS date_fst"),
        F.expr("max(date) AS date_lst"),
        *[at(n, "hour_per_cnt", str(n)) for n in range(1, width + 1)],
        F.expr(f"{fits(width)} AS fits"),
    ).where("fits").drop("fits")


def _in_range(low: int | None, high: int) -> str:
    """Strictly between the bounds: the bounds themselves are in no range."""
    above = "" if low is None else f"hour_per_cnt > {low} AND "
    return f"double(count_if({above}hour_per_cnt < {high}))"


def life_statistics(months: DataFrame, width: int = LIFE_MONTHS) -> DataFrame:
    """Maximum, minimum, mean and counts of the hours, by month of life side by side."""
    # A month no project reached has no extremes, a mean of zero and empty ranges.
    none = "CASE WHEN statistic IN ('max', 'min') THEN CAST(NULL AS DOUBLE) ELSE 0D END"
    return life_statistics_long(months).groupBy("statistic").agg(
        *[
            F.expr(f"coalesce(max(CASE WHEN ordinal = {n} THEN value END), {none}) AS `{n}`")
            for n in range(1, width + 1)
        ],
        F.expr(f"{fits(width)} AS fits"),
    ).where("fits").drop("fits")


def life_statistics_long(months: DataFrame) -> DataFrame:
    """One row per statistic and month of life: ordinal, statistic, value.

    The mean takes a project that did not live so long as zero; the others skip it.
    """
    projects = months.where("ordinal = 1").agg(F.count(F.lit(1))).scalar()
    by_month = months.groupBy("ordinal").agg(
        F.expr("max(hour_per_cnt) AS max"),
        F.expr("min(hour_per_cnt) AS min"),
        F.expr("sum(hour_per_cnt) AS sum"),
        *[F.expr(f"{_in_range(*bounds)} AS {name}") for name, bounds in RANGES.items()],
    ).withColumn("projects", projects).withColumn(
        "mean", F.expr(numeric.round_to(numeric.safe_div("coalesce(sum, 0)", "projects"), 1))
    )
    names = ["max", "min", "mean", *RANGES]
    return by_month.unpivot("ordinal", names, "statistic", "value")


def life_sheet(pivot: DataFrame, statistics: DataFrame) -> DataFrame:
    """The project rows with the statistic rows below them, as one table."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [pivot, statistics]
    )
