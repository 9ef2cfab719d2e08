"""Load of planned projects, project lists, and removal of one user's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffcast.functions import numeric

# Columns that the load extract leaves out, and days counted per month.
DROPPED = ("project_type", "save_time", "user_id", "project_code_old", "project_name_old")
WORKING_DAYS, CALENDAR_DAYS = 20, 30


def project_load(info: DataFrame, user_id: str | None = None) -> DataFrame:
    """Hours per month and per day of the saved projects, of one user or of all."""
    if user_id is not None:
        info = info.where(F.col("user_id") == user_id)
    per_month = numeric.round2(numeric.safe_div("execute_hour", "execute_month"))

    def per_day(days: int) -> Column:
        return F.expr(numeric.round2(f"(execute_hour_per_month / {days})"))

    return (
        info.drop(*DROPPED)
        .withColumn("execute_hour_per_month", F.expr(per_month))
        .withColumns({
            "execute_hour_per_day_20": per_day(WORKING_DAYS),
            "execute_hour_per_day_30": per_day(CALENDAR_DAYS),
        })
        .orderBy("project_code")
    )


def parse_project_lines(lines: DataFrame) -> DataFrame:
    """Fields of ``code,name,hours,months`` lines; ``is_valid`` marks complete ones.

    Lines of a plain code list have a code only: they are kept and not valid as models.
    """

    def field(i: int) -> str:
        return f"try_element_at(split(value, ','), {i})"

    hours, months = numeric.parse_number(field(3)), numeric.parse_number(field(4))
    return lines.where("trim(value) <> ''").selectExpr(
        f"trim({field(1)}) AS project_code",
        f"trim({field(2)}) AS project_name",
        f"{hours} AS execute_hour",
        f"{months} AS execute_month",
        f"size(split(value, ',')) = 4 AND {hours} IS NOT NULL AND {months} IS NOT NULL "
        "AS is_valid",
        "value AS line",
    )


def purge_user(table: DataFrame, user_id) -> DataFrame:
    """The table without the rows of one user; rows without a user stay."""
    return table.where(~F.coalesce(F.col("user_id") == user_id, F.lit(False)))
