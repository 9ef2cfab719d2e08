"""The life profile of a list of projects: rows, statistics, and both on one sheet."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from staffcast.operators import life
from staffcast.operators.spread import settle


@dataclass(frozen=True)
class LifeReport:
    months: DataFrame
    projects: DataFrame
    statistics: DataFrame
    sheet: DataFrame


def life_report(
    fact: DataFrame,
    projects: DataFrame,
    function: str = life.PROFILED_FUNCTION,
    before: dt.date = life.CUT_OFF,
    width: int = life.LIFE_MONTHS,
) -> LifeReport:
    """Profile all listed projects from one scan of the fact.

    ``months`` are the hours in long form, for lives of any length. The other tables are
    sheets of ``width`` month columns, and fail where a project lived longer.
    """
    profile = life.project_month_profile(fact, projects, function, before)
    months = settle(life.life_months(profile), "life-months")
    pivot = life.life_pivot(months, width)
    statistics = life.life_statistics(months, width)
    return LifeReport(months, pivot, statistics, life.life_sheet(pivot, statistics))
