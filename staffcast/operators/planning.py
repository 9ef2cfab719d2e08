"""The two request tables: planned projects and planned head count."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staffcast.functions import calendar, codes, numeric

HEADCOUNT_KEYS = (
    "scenario_id", "div", "deptid", "project_code", "project_name", "sub_job_family_2",
)


def typed_projects(raw: DataFrame) -> DataFrame:
    """Planned projects with numbers and dates; blank text becomes missing.

    A missing name is the empty name, which head count with an empty name matches.
    """
    return raw.withColumns({
        "project_name": F.expr("coalesce(project_name, '')"),
        "execute_hour": F.expr(numeric.parse_number("execute_hour")),
        "execute_month": F.expr(numeric.parse_number("execute_month")),
        "start_date": F.expr(calendar.parse_day("start_date")),
    })


def clean_plan(projects: DataFrame) -> DataFrame:
    """Planned projects that name both a new and an old project."""
    return projects.where(codes.is_filled("project_code")).where(
        codes.is_filled("project_code_old")
    )


def plan_rows(plan: DataFrame) -> DataFrame:
    """What a planned project counts with; repeated rows of one plan count once.

    The code of the new project does not tell rows apart: two new projects of one name
    that agree in all else are one.
    """
    return plan.selectExpr(
        "scenario_id", "division AS div", "project_name", "project_code_old",
        "execute_hour", "execute_month", "start_date",
    ).distinct()


def scenarios_of_list(
    listed: DataFrame, start_date: dt.date, name: str = "new project", scale: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """One scenario per project of a list: what if one more such project starts?

    ``listed`` holds parsed project lines with a ``scenario_id``, a ``division`` and a
    ``user_id``. ``scale`` multiplies the listed hours. Lines that are not valid are left
    out. Gives the scenario table and the planned project table.
    """
    valid = listed.where("is_valid")
    scenarios = valid.select("scenario_id", "division", "user_id")
    projects = valid.select(
        "scenario_id",
        "division",
        F.lit("0").alias("project_code"),
        F.lit(name).alias("project_name"),
        F.col("project_code").alias("project_code_old"),
        F.col("project_name").alias("project_name_old"),
        F.expr(f"string(execute_hour * {float(scale)}D)").alias("execute_hour"),
        F.expr("string(execute_month)").alias("execute_month"),
        F.lit(start_date.isoformat()).alias("start_date"),
    )
    return scenarios, projects


def headcount_plan(raw: DataFrame) -> DataFrame:
    """Head count by scenario, unit, project and planned function."""
    return (
        raw.fillna("", ["deptid", "sub_job_family"]).withColumns({
            "HC": F.expr(numeric.parse_number("HC")),
            "sub_job_family_2": F.expr(codes.planning_function("sub_job_family")),
        })
        .groupBy(*HEADCOUNT_KEYS)
        .agg(F.expr(f"{numeric.strict_sum('HC')} AS hc"))
    )


# Bits of a word of a set; the sign stays free.
_WORD_BITS = 63
TITLE_KINDS = ("DEP", "SUB")


def asked_titles(raw: DataFrame) -> DataFrame:
    """Departments and functions for which head count above zero is planned: (scenario_id, kind, title).

    A row without a title keeps its scenario, with a missing title.
    """
    titles = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(name).alias("title"))
        for kind, name in zip(TITLE_KINDS, ("deptid", "sub_job_family"))
    ])
    return raw.where(f"{numeric.parse_number('HC')} > 0").select("scenario_id", F.inline(titles))


def title_numbers(titles: DataFrame) -> DataFrame:
    """The distinct titles of each kind in order, numbered from 0: (kind, title, number).

    Titles are those of units, so there are few of them however many scenarios ask.
    """
    distinct = titles.where("title IS NOT NULL").select("kind", "title").distinct()
    place = F.row_number().over(W.partitionBy("kind").orderBy("title"))
    return distinct.withColumn("number", place - 1)


def active_titles(asked: DataFrame, numbers: DataFrame) -> DataFrame:
    """Departments and functions with planned head count, one row per scenario with two sets.

    A set maps words to bits over the ``numbers`` of the known titles, so a scenario is a row
    of bounded size however many rows it has. Titles that are not known are in no set; see
    ``unknown_titles``.
    """
    word = F.expr(f"int(number DIV {_WORD_BITS})")
    bits = (
        asked.join(numbers, ["kind", "title"], "left")
        .groupBy("scenario_id", "kind", word.alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, int(number % {_WORD_BITS}))) AS bits"))
    )
    return bits.groupBy("scenario_id").agg(*[
        F.expr(f"""map_from_entries(collect_list(struct(word, bits))
            FILTER (WHERE kind = '{kind}' AND word IS NOT NULL)) AS {kind}""")
        for kind in TITLE_KINDS
    ])


def titles_of(sets: DataFrame, numbers: DataFrame) -> DataFrame:
    """The sets of ``active_titles`` as sorted arrays of titles."""

    known = {
        f"all_{kind}": numbers.where(F.col("kind") == kind)
        .agg(F.array_sort(F.collect_list(F.struct("number", "title")))).scalar()
        for kind in TITLE_KINDS
    }

    def titles(kind: str) -> Column:
        word = lambda t: F.floor(t["number"] / _WORD_BITS).cast("int")
        bits = lambda t: F.coalesce(F.try_element_at(kind, word(t)), F.lit(0).cast("bigint"))
        held = F.filter(f"all_{kind}", lambda t: F.getbit(bits(t), t["number"] % _WORD_BITS) == 1)
        return F.transform(held, lambda t: t["title"])

    return sets.withColumns(known).select(
        "scenario_id", *[titles(kind).alias(kind) for kind in TITLE_KINDS]
    )


def unknown_titles(asked: DataFrame, numbers: DataFrame) -> DataFrame:
    """Titles that scenarios plan head count for, but that are no known unit, once each."""
    named = asked.where("title IS NOT NULL").distinct()
    return named.join(numbers, ["kind", "title"], "left_anti").select("scenario_id", "kind", "title")


def project_models(profile: DataFrame) -> DataFrame:
    """Effort of every profiled project, one row each."""
    return profile.groupBy("project_code").agg(
        F.max("execute_hour").alias("old_hour"),
        F.max("execute_month").alias("old_month"),
        F.max("stage_rows").alias("stage_rows"),
    )


def plan_with_models(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Plan rows with the effort of the old project each is modelled on.

    ``stage_rows`` is NULL for a code that is not among the settled ``models``. Very many
    scenarios may share one model project.
    """
    named = models.withColumnRenamed("project_code", "project_code_old")
    return rows.join(named, "project_code_old", "left")


def invalid_rows(modelled: DataFrame) -> DataFrame:
    """Planned projects whose old project is unknown or started before the fact."""
    return modelled.where("stage_rows IS NULL")


def validate_plan(modelled: DataFrame) -> DataFrame:
    """Codes a scenario is refused for: one row per scenario and unknown code."""
    return (
        invalid_rows(modelled)
        .groupBy("scenario_id", "project_code_old")
        .agg(F.lit(codes.INVALID_CODE_MESSAGE).alias("error_msg"))
    )


def project_ratio(modelled: DataFrame) -> DataFrame:
    """Size and duration of each new project relative to the old one.

    A new value that is zero or missing means "like the old project", ratio 1.
    """

    def ratio(new: str, old: str) -> str:
        return f"CASE WHEN {new} IS NULL OR {new} = 0 THEN 1D ELSE {numeric.safe_div(new, old)} END"

    return modelled.where("stage_rows IS NOT NULL").withColumns({
        "hr_ratio": F.expr(ratio("execute_hour", "old_hour")),
        "mon_ratio": F.expr(ratio("execute_month", "old_month")),
    })


def scenario_modes(scenarios: DataFrame, modelled: DataFrame) -> DataFrame:
    """Whether a scenario is refused, plans projects, or only head count.

    Every planned row is reduced to counts per scenario before the join, so a scenario
    with very many rows costs no more than any other.
    """
    counts = modelled.groupBy("scenario_id").agg(
        F.expr("count(1) AS planned"), F.expr("count_if(stage_rows IS NULL) AS unknown")
    )
    return (
        scenarios.join(counts, "scenario_id", "left")
        .withColumn("mode", F.expr(
            "CASE WHEN unknown > 0 THEN 'refused' WHEN planned > 0 THEN 'projects' "
            "ELSE 'headcount' END"
        ))
        .drop("planned", "unknown")
    )
