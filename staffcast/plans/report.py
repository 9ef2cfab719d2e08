"""Rate reports: history, head count, outlook, for one or for very many scenarios."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffcast.functions import calendar, numeric
from staffcast.operators import hours, planning, rates, what_if
from staffcast.operators.spread import at_once, settle, settle_together
from staffcast.plans import records
from staffcast.schemas import REPORT_COLUMNS
from staffcast.sources.readers import numbered_requests, split_requests


#: Old projects that a scan of the fact is filtered by; a plan that names more scans all of it.
NAMED_CODES = 1000


@dataclass(frozen=True)
class Units:
    """Rates of all units of all divisions, side by side by month, and the last month."""

    functions: DataFrame
    departments: DataFrame
    department_functions: DataFrame
    end: Column


def prepare_units(
    fact: DataFrame, end: dt.date | Column | None = None, additive: bool = False
) -> Units:
    """Reduce six months of the fact to the unit sheets that every scenario shares.

    ``end`` is the last month of the fact where the caller knows it; otherwise it is
    looked up. The sheets are settled, so the result can be used for any number of batches
    without working them out again.
    """
    table, end = at_once(
        fact.sparkSession,
        lambda: settle(rates.unit_rates(fact, end), "unit_rates"),
        lambda: calendar.resolved(fact, end),
    )
    units = unit_sheets(table, end, additive)
    sheets = {name: sheet for name, sheet in vars(units).items() if name != "end"}
    return Units(*settle_together(**sheets), end)


def unit_sheets(table: DataFrame, end: Column, additive: bool = False) -> Units:
    """The sheets of settled unit rates, worked out where they are read: for a single call."""
    return Units(
        rates.function_sheet(table),
        rates.department_sheet(table, additive),
        rates.department_function_sheet(table),
        end,
    )


def units_of_call(fact: DataFrame, end: dt.date | Column | None, additive: bool) -> Units:
    table = settle(rates.unit_rates(fact, end), "unit_rates")
    return unit_sheets(table, calendar.anchor(table, end), additive)


def prepare_headcount(raw: DataFrame) -> DataFrame:
    return settle(planning.headcount_plan(raw), "headcount")


def prepare_plan(raw: DataFrame) -> DataFrame:
    return settle(counted_plan(raw), "plan")


def counted_plan(raw: DataFrame) -> DataFrame:
    return planning.plan_rows(planning.clean_plan(planning.typed_projects(raw)))


def history_report(fact: DataFrame, end: dt.date | None = None) -> DataFrame:
    """Past three months of every department and function of every division."""
    rate = numeric.round2(numeric.strict_avg("uti_rate"))
    by_month = (
        rates.unit_rates(fact, end)
        .selectExpr(
            "div AS Div", "type AS Type",
            f"CASE WHEN type = '{rates.DEP}' THEN deptid ELSE sub_job_family_2 END AS Title",
            "month_no", "uti_rate",
        )
        .groupBy("Div", "Type", "Title", "month_no")
        .agg(F.expr(f"{rate} AS rate"))
    )
    # A unit seen only in later months keeps its row, with zeros.
    months = [
        numeric.or_zero(f"max(CASE WHEN month_no = {m} THEN rate END)") + f" AS b_{k}"
        for k, m in enumerate(calendar.HISTORY, start=1)
    ]
    return by_month.groupBy("Div", "Type", "Title").agg(*[F.expr(m) for m in months])


def headcount_report(
    units: Units, scenarios: DataFrame, headcount: DataFrame, also: tuple[str, ...] = ()
) -> DataFrame:
    """Report of scenarios that only add head count, departments and functions.

    ``also`` may name the user and the key of the request, which then go along with the scenario.
    """
    departments = what_if.hc_what_if_department(
        scenarios, units.departments, units.department_functions, headcount
    )
    functions = what_if.hc_what_if_function(scenarios, units.functions, headcount)
    return departments.unionByName(functions).select(*REPORT_COLUMNS, *also)


@dataclass(frozen=True)
class History:
    """What past projects took: their effort, and the hours of their opening months."""

    models: DataFrame
    opening: DataFrame


@dataclass(frozen=True)
class ProjectPlan:
    """Validated project plans: the mode of every scenario and what its projects add."""

    modelled: DataFrame
    scenarios: DataFrame
    staff: DataFrame
    effects: DataFrame


def prepare_history(
    fact: DataFrame, start: dt.date | None = None, codes: list[str] | None = None
) -> History:
    """Reduce the fact to what every plan looks up, and settle it.

    Efforts and opening hours are two sums of their own columns at their own grain (project and
    start stage; project, function and month), side by side; neither is written before it is
    down to projects. ``start`` is the first date of the fact where the caller knows it. The
    result can be used for any number of calls, batches and micro-batches; with ``codes``,
    which both scans are filtered by, only for plans that name no other old project.
    """
    started = calendar.opening_date(fact, start)
    if codes is not None:
        fact = fact.where(F.col("project_code").isin(codes))
    return History(*settle_together(
        project_models=rates.project_efforts(fact, started),
        opening_hours=hours.opening_sheet(hours.opening_hours(fact)),
    ))


def model_plan(plan: DataFrame, history: History) -> DataFrame:
    """Settled planned rows with their old projects."""
    return settle(planning.plan_with_models(plan, history.models), "modelled_plan")


def prepare_projects(
    modelled: DataFrame, history: History, units: Units, scenarios: DataFrame, headcount: DataFrame
) -> ProjectPlan:
    """Check the planned projects and work out the hours and heads they add.

    The planned rows are multiplied by the functions of their old project only, and are
    summed by project before anything is joined to the units. The modes are worked out where
    they are read, from the settled rows, so scenarios are not written with them.
    """
    ratios = planning.project_ratio(modelled)
    modes = planning.scenario_modes(scenarios, modelled)
    staff = settle(
        what_if.project_staff(headcount, hours.project_passes(ratios), units.department_functions),
        "project_staff",
    )
    factors = hours.plan_factors(ratios, units.end)
    added = hours.added_hours(history.opening, factors)
    effects = settle(
        what_if.project_effects(added, staff, units.functions), "project_effects"
    )
    return ProjectPlan(modelled, modes, staff, effects)


def project_report(
    units: Units, scenarios: DataFrame, plan: ProjectPlan, also: tuple[str, ...] = ()
) -> DataFrame:
    """Report of scenarios that start new projects, departments and functions."""
    departments = what_if.project_what_if_department(
        scenarios, units.departments, units.department_functions, plan.effects, plan.staff
    )
    functions = what_if.project_what_if_function(scenarios, units.functions, plan.effects)
    return departments.unionByName(functions).select(*REPORT_COLUMNS, *also)


def combined_report(
    units: Units, headcount: DataFrame, plan: ProjectPlan, also: tuple[str, ...] = ()
) -> DataFrame:
    """Every accepted scenario by the branch its mode asks for.

    A branch that no scenario asks for is left out of the plan: a single call plans one.
    """
    modes = {row["mode"] for row in plan.scenarios.select("mode").distinct().collect()}

    def of(mode: str) -> DataFrame:
        return plan.scenarios.where(F.col("mode") == mode)

    if "headcount" not in modes:
        return project_report(units, of("projects"), plan, also)
    heads_only = headcount_report(units, of("headcount"), headcount, also)
    if "projects" not in modes:
        return heads_only
    return heads_only.unionByName(project_report(units, of("projects"), plan, also))


def score_scenarios(
    fact: DataFrame,
    scenarios: DataFrame,
    projects: DataFrame,
    headcount: DataFrame,
    end: dt.date | Column | None = None,
    additive: bool = False,
    project_fact: DataFrame | None = None,
    start: dt.date | None = None,
    units: Units | None = None,
    history: History | None = None,
) -> DataFrame:
    """Report of a whole table of scenarios.

    A scenario with valid planned projects gets the project outlook, one without any
    gets the head count outlook, and one that names an unknown old project gets no
    report (see ``records.refused_requests``). Scenarios do not influence each other.
    ``end`` and ``start`` are the last and first date of the fact where the caller knows
    them. ``project_fact`` is the fact without division and department, for sources in which
    those cost a join: the history of a project does not need them. With prepared ``units``
    and ``history`` the fact is not read.
    """
    heads, units, plan = at_once(
        fact.sparkSession,
        lambda: prepare_headcount(headcount),
        lambda: units or units_of_call(fact, end, additive),
        lambda: plan_scenarios(project_fact or fact, projects, start, history),
    )
    if plan is None:
        return headcount_report(units, scenarios, heads)
    return combined_report(units, heads, prepare_projects(*plan, units, scenarios, heads))


def plan_scenarios(
    fact: DataFrame, projects: DataFrame, start: dt.date | None, history: History | None
) -> tuple[DataFrame, History] | None:
    """Modelled plan and the history behind it; nothing where no project is planned.

    A plan that names few old projects looks for them alone in the fact.
    """
    if history is not None:
        modelled = model_plan(counted_plan(projects), history)
        return None if modelled.isEmpty() else (modelled, history)
    plan = prepare_plan(projects)
    named = plan.select("project_code_old").distinct().limit(NAMED_CODES + 1).collect()
    if not named:
        return None
    codes = [r[0] for r in named] if len(named) <= NAMED_CODES else None
    history = prepare_history(fact, start, codes)
    return model_plan(plan, history), history


def prepare_requests(requests: DataFrame) -> DataFrame:
    """The distinct requests that can be answered, numbered and settled.

    Their keys are random digits, which only zstd writes in half their size.
    """
    return settle(numbered_requests(requests), "asked", "zstd")


def answer_requests(
    requests: DataFrame,
    units: Units,
    history: History,
    save_time: dt.datetime | None = None,
    asked: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answers and refusals of parsed requests; each request is in one of them.

    Answers carry the user and the key of the request, refusals its whole text. The requests are
    read once for the answers and again for the refusals, so they are settled unless they are
    read from tables or files that stay. ``asked`` are the same requests, prepared.
    """
    asked = prepare_requests(requests) if asked is None else asked
    scenarios, projects, headcount = split_requests(asked, numbered=True)
    heads = prepare_headcount(headcount)
    modelled = model_plan(counted_plan(projects), history)
    plan = prepare_projects(modelled, history, units, scenarios, heads)
    answers = combined_report(units, heads, plan, ("user_id", "request_id"))
    refused = records.unreadable_requests(requests, save_time).unionByName(
        records.refused_texts(keyed(modelled, scenarios), requests, save_time)
    )
    report = answers.withColumn("scenario_id", F.col("request_id")).drop("request_id")
    return report, refused


def keyed(rows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Rows about numbered requests with the key of the request as ``scenario_id``."""
    keys = scenarios.select("scenario_id", "request_id")
    return rows.join(keys, "scenario_id").drop("scenario_id").withColumnRenamed("request_id", "scenario_id")
