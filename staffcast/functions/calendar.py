"""Dates: the report months and the share of the month a project starts in.

The report covers six months that end with the last month of the fact. They are
numbered 1 to 6: 1-3 are history, 4-6 are the months that a what-if recomputes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_MONTHS = 6
HISTORY = (1, 2, 3)
OUTLOOK = (4, 5, 6)


def last_month(fact: DataFrame) -> Column:
    """Last date of the whole fact as a scalar subquery.

    The subquery reads one column, is planned inside the query that uses it and reaches
    the scan as a pushed filter, so a fact partitioned by date is pruned at run time.
    """
    return fact.agg(F.max("date")).scalar()


def first_month(fact: DataFrame) -> Column:
    """First date of the whole fact as a scalar subquery."""
    return fact.agg(F.min("date")).scalar()


def _known(month: dt.date | Column) -> Column:
    return month if isinstance(month, Column) else F.lit(month).cast("date")


def anchor(fact: DataFrame, month: dt.date | Column | None = None) -> Column:
    """The month the report ends with: given by the caller, else found in the fact."""
    return last_month(fact) if month is None else _known(month)


def resolved(fact: DataFrame, month: dt.date | Column | None = None) -> Column:
    """``anchor`` as a known date: looked up once, for plans that use it often."""
    row = fact.sparkSession.range(1).select(anchor(fact, month).alias("month")).first()
    return _known(row["month"])


def opening_date(fact: DataFrame, date: dt.date | Column | None = None) -> Column:
    """The first date of the fact: given by the caller, else found in the fact."""
    return first_month(fact) if date is None else _known(date)


def month_date(month_no: Column, end: Column) -> Column:
    """Date of report month 1..6 when the report ends with ``end``."""
    return F.add_months(end, (month_no - REPORT_MONTHS).cast("int"))


def month_number(date: Column, end: Column) -> Column:
    """Report month of a date: 6 for the month of ``end``, 5 for the one before."""
    months = (F.year(date) - F.year(end)) * 12 + F.month(date) - F.month(end)
    return (months + REPORT_MONTHS).cast("int")


def parse_day(text: str) -> str:
    """Date that text starts with, as ``2021/8/1`` or ISO; anything else is missing."""
    day = rf"regexp_extract(trim({text}), r'^\d{{4}}([-/])\d{{1,2}}\1\d{{1,2}}', 0)"
    return f"try_cast(replace({day}, '/', '-') AS DATE)"


def epoch_day(days: str) -> str:
    """Date from a day number counted from 1970-01-01."""
    return f"date_from_unix_date(int({days}))"


def start_share(month: str, start: str) -> str:
    """Part of a month in which a project that starts on ``start`` is worked on.

    Months on or after the start count fully, the month of the start by the days left
    after it, earlier months not at all. A missing start gives a missing share.
    """
    return f"""CASE WHEN {start} IS NULL THEN CAST(NULL AS DOUBLE)
        WHEN {month} >= {start} THEN 1D
        WHEN {month} = trunc({start}, 'MM') THEN 1 - day({start}) / day(last_day({start}))
        ELSE 0D END"""
