"""Records around the reports: refused requests, tidy extracts, JSON records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffcast.functions import calendar, codes, numeric
from staffcast.operators import planning

# Columns that are rounded to one decimal in the extract of each intermediate table,
# and the columns that may arrive as day numbers.
ROUNDED = {
    "project_hours": ("add_hour",),
    "allocation": ("add_hour", "uti_rate", "add_hour_pct", "total_hour_dept_func"),
    "department_outlook": (
        "total_hour_by_dep_func_cal", "add_hour_pct", "total_hour_dept_func",
    ),
}
DAY_NUMBERS = {
    "project_hours": ("date", "start_date"),
    "allocation": ("start_date",),
    "department_outlook": (),
}


def reject_log(
    rejects: DataFrame,
    user_id: Column,
    message: Column,
    inputs: list[str],
    save_time: dt.datetime | None = None,
) -> DataFrame:
    """Log rows for rejected input: the input as JSON, the message, the time, the user.

    One row is written per rejected input row, so a request with very many bad rows
    never has to be gathered into one text.
    """
    when = F.current_timestamp() if save_time is None else F.lit(save_time)
    return rejects.select(
        F.to_json(F.struct(*inputs)).alias("user_input"),
        message.alias("error_msg"),
        when.alias("save_time"),
        user_id.alias("user_id"),
    )


def refused_requests(
    modelled: DataFrame, scenarios: DataFrame, save_time: dt.datetime | None = None
) -> DataFrame:
    """Log of the planned projects that made their scenario be refused."""
    users = scenarios.select("scenario_id", "user_id")
    rows = planning.invalid_rows(modelled).join(users, "scenario_id")
    return reject_log(
        rows,
        F.col("user_id"),
        F.lit(codes.INVALID_CODE_MESSAGE),
        ["scenario_id", "project_name", "project_code_old"],
        save_time,
    )


def unknown_units(
    unknown: DataFrame, scenarios: DataFrame, save_time: dt.datetime | None = None
) -> DataFrame:
    """Log of the departments and functions with planned head count that are no unit."""
    rows = unknown.join(scenarios.select("scenario_id", "user_id"), "scenario_id")
    message = F.lit(codes.UNKNOWN_UNIT_MESSAGE)
    return reject_log(rows, F.col("user_id"), message, ["scenario_id", "kind", "title"], save_time)


def unreadable_requests(requests: DataFrame, save_time: dt.datetime | None = None) -> DataFrame:
    """Log of the requests that cannot be answered at all, with their whole text."""
    bad = requests.where("problem IS NOT NULL")
    return logged_text(bad, F.col("text"), F.col("problem"), F.col("user"), save_time)


def refused_texts(
    modelled: DataFrame, requests: DataFrame, save_time: dt.datetime | None = None
) -> DataFrame:
    """Log of the requests that name an unknown old project, with their whole text."""
    bad = planning.invalid_rows(modelled).select("scenario_id").distinct()
    rows = requests.where("problem IS NULL").join(bad, "scenario_id", "left_semi")
    message = F.lit(codes.INVALID_CODE_MESSAGE)
    return logged_text(rows, F.col("text"), message, F.col("user"), save_time)


def rejected_lines(lines: DataFrame, user: str, save_time: dt.datetime | None = None) -> DataFrame:
    """Log of the lines of a project list that are no complete project."""
    bad = lines.where("NOT is_valid")
    message = F.lit("Not a complete project line")
    return logged_text(bad, F.col("line"), message, F.lit(user), save_time)


def logged_text(
    rows: DataFrame, text: Column, message: Column, user: Column, save_time: dt.datetime | None
) -> DataFrame:
    """Log rows with a text as it arrived, the message, the time and the user."""
    when = F.current_timestamp() if save_time is None else F.lit(save_time)
    return rows.select(
        text.alias("user_input"), message.alias("error_msg"), when.alias("save_time"),
        user.alias("user_id"),
    )


def tidy_result(df: DataFrame, kind: str, percent: bool = False) -> DataFrame:
    """Readable extract of an intermediate table or a report.

    Day numbers become dates and measures get one decimal, by the kind of table; with
    ``percent`` the six rates of a report are given times 100.
    """
    changes = {
        name: F.expr(calendar.epoch_day(name))
        for name in DAY_NUMBERS.get(kind, ())
        if name in df.columns and dict(df.dtypes)[name] != "date"
    }
    changes |= {
        name: F.expr(numeric.round_to(name, 1))
        for name in ROUNDED.get(kind, ())
        if name in df.columns
    }
    if percent:
        changes |= {
            name: F.col(name) * 100
            for name in ("b_1", "b_2", "b_3", "a_1", "a_2", "a_3")
            if name in df.columns
        }
    return df.withColumns(changes)


def as_records(df: DataFrame) -> DataFrame:
    """One JSON record per row, as a response lists them."""
    return df.fillna(0.0).select(F.to_json(F.struct("*")).alias("record"))
