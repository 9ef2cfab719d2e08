"""The registered queries. Each takes (spark, folder of tables) and returns a DataFrame.

Measures are rounded where a sum of fractions could differ in its last bit.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffcast import schemas
from staffcast_checks import fixture
from staffcast.functions import calendar, numeric
from staffcast.operators import allocation, hours, life, planning, projects, rates
from staffcast.operators.spread import at_once, place, settle, settle_together
from staffcast.plans import monthly, records, report
from staffcast.plans.life import life_report
from staffcast.sources import readers, writers
from staffcast.sources.readers import parse_requests

Query = Callable[[SparkSession, str], DataFrame]
_SAVED = dt.datetime(2022, 3, 4, 10, 20)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({
        name: F.expr(numeric.round_to(name, n)) for name, n in digits.items()
    })


def _recent(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    """The report months of the fact and the last of them."""
    return fixture.recent_utilization(spark, sf), fixture.last_month(spark, sf)


def _history(spark: SparkSession, sf: str) -> report.History:
    fact = fixture.utilization(spark, sf, units=False)
    return report.prepare_history(fact, fixture.first_month(spark, sf))


def function_rates(spark: SparkSession, sf: str) -> DataFrame:
    fact, end = _recent(spark, sf)
    table = rates.function_rates(fact, end)
    return rounded(table, uti_rate=4, attendance_emp=4)


def department_rates(spark: SparkSession, sf: str) -> DataFrame:
    fact, end = _recent(spark, sf)
    table = rates.department_rates(fact, end)
    return rounded(table, uti_rate=4, attendance_emp=4)


def unit_rates(spark: SparkSession, sf: str) -> DataFrame:
    table = rates.unit_rates(*_recent(spark, sf))
    return rounded(table, uti_rate=4, attendance_emp=4)


def unit_rates_by_load(spark: SparkSession, sf: str) -> DataFrame:
    """The unit rates from the states of two loads that share months and employees."""
    fact, end = _recent(spark, sf)
    path = place(spark, "store")
    late = (F.col("date") == end) & (F.crc32(F.coalesce("project_code", F.lit(""))) % 2 == 0)
    monthly.add_load(fact.where(~late), path, "first")
    monthly.add_load(fact.where(late), path, "late")
    return rounded(monthly.rates_of_store(spark, path, end), uti_rate=4, attendance_emp=4)


def project_profile(spark: SparkSession, sf: str) -> DataFrame:
    fact = fixture.utilization(spark, sf, units=False)
    return rates.project_profile(fact, fixture.first_month(spark, sf))


def headcount_plan(spark: SparkSession, sf: str) -> DataFrame:
    return planning.headcount_plan(fixture.plan_headcount(spark, sf))


def active_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Every title that is asked for is known here: the numbers are made from the requests."""
    asked = planning.asked_titles(fixture.plan_headcount(spark, sf))
    numbers = settle(planning.title_numbers(asked), "titles")
    sets = planning.titles_of(planning.active_titles(asked, numbers), numbers)
    return sets.select("scenario_id", *[F.array_join(c, ",").alias(c) for c in ("DEP", "SUB")])


def unknown_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Log of the planned departments and functions that have no rate."""
    asked = planning.asked_titles(fixture.plan_headcount(spark, sf))
    fact = fixture.recent_utilization(spark, sf)
    units = fact.select(F.lit("DEP").alias("kind"), F.col("deptid").alias("title")).union(
        fact.select(F.lit("SUB"), "sub_job_family")
    )
    numbers = settle(planning.title_numbers(units), "titles")
    unknown = planning.unknown_titles(asked, numbers)
    return _logged(records.unknown_units(unknown, fixture.scenarios(spark, sf), _SAVED))


def history_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.history_report(*_recent(spark, sf))


def history_report_function(spark: SparkSession, sf: str) -> DataFrame:
    return history_report(spark, sf).where(F.col("Type") == rates.SUB)


def history_report_department(spark: SparkSession, sf: str) -> DataFrame:
    return history_report(spark, sf).where(F.col("Type") == rates.DEP)


def _headcount_report(spark: SparkSession, sf: str) -> DataFrame:
    units, heads = at_once(
        spark,
        lambda: report.units_of_call(*_recent(spark, sf), additive=False),
        lambda: report.prepare_headcount(fixture.plan_headcount(spark, sf)),
    )
    return report.headcount_report(units, fixture.scenarios(spark, sf), heads)


def hc_what_if_function(spark: SparkSession, sf: str) -> DataFrame:
    return _headcount_report(spark, sf).where(F.col("Type") == rates.SUB)


def hc_what_if_department(spark: SparkSession, sf: str) -> DataFrame:
    return _headcount_report(spark, sf).where(F.col("Type") == rates.DEP)


def rate_report(spark: SparkSession, sf: str) -> DataFrame:
    """All scenarios as if none planned a project: departments and functions."""
    return _headcount_report(spark, sf)


def plan_clean(spark: SparkSession, sf: str) -> DataFrame:
    plan = planning.typed_projects(fixture.plan_projects(spark, sf))
    return planning.clean_plan(plan).drop("project_name_old")


def _modelled_history(spark: SparkSession, sf: str) -> tuple[DataFrame, report.History]:
    """Planned rows with their old projects, and the history of these."""
    plan, history = at_once(
        spark,
        lambda: report.prepare_plan(fixture.plan_projects(spark, sf)),
        lambda: _history(spark, sf),
    )
    return report.model_plan(plan, history), history


def _modelled(spark: SparkSession, sf: str) -> DataFrame:
    """Planned rows with their old projects, where the opening hours are not asked for."""
    fact = fixture.utilization(spark, sf, units=False)
    models = rates.project_efforts(fact, fixture.first_month(spark, sf))
    plan = report.counted_plan(fixture.plan_projects(spark, sf))
    plan, models = settle_together(plan=plan, project_models=models)
    return planning.plan_with_models(plan, models)


def plan_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return planning.validate_plan(_modelled(spark, sf))


def scenario_modes(spark: SparkSession, sf: str) -> DataFrame:
    return planning.scenario_modes(fixture.scenarios(spark, sf), _modelled(spark, sf))


def reject_log(spark: SparkSession, sf: str) -> DataFrame:
    return _logged(records.refused_requests(
        _modelled(spark, sf), fixture.scenarios(spark, sf), _SAVED
    ))


def project_ratio(spark: SparkSession, sf: str) -> DataFrame:
    table = planning.project_ratio(_modelled(spark, sf))
    return rounded(table, hr_ratio=4, mon_ratio=4)


def opening_hours(spark: SparkSession, sf: str) -> DataFrame:
    fact = fixture.utilization(spark, sf, units=False)
    return hours.opening_hours(fact)


def _prorated(spark: SparkSession, sf: str) -> DataFrame:
    modelled, history = _modelled_history(spark, sf)
    scaled = hours.project_hours(
        hours.opening_rows(history.opening),
        planning.project_ratio(modelled),
        fixture.last_month(spark, sf),
    )
    return hours.prorate_start(scaled)


_HOUR_KEYS = (
    "scenario_id", "project_name", "project_code_old", "sub_job_family_2", "date",
    "start_date", "execute_hour", "execute_month",
)


def _month_listing(spark: SparkSession, sf: str, *measures: str) -> DataFrame:
    return _prorated(spark, sf).select(*_HOUR_KEYS, *measures)


def project_hours(spark: SparkSession, sf: str) -> DataFrame:
    table = _month_listing(spark, sf, "total_hour_pro_func", "add_hour")
    return rounded(table, add_hour=2)


def start_proration(spark: SparkSession, sf: str) -> DataFrame:
    table = _month_listing(spark, sf, "start_mth_pct", "add_hour_adj")
    return rounded(table, start_mth_pct=4, add_hour_adj=2)


def tidy_result(spark: SparkSession, sf: str) -> DataFrame:
    """Project hours with dates as day numbers, as an extract receives them, tidied."""
    raw = _month_listing(spark, sf, "add_hour").withColumns({
        "date": F.unix_date("date"), "start_date": F.unix_date("start_date"),
    })
    return records.tidy_result(raw, "project_hours")


def _shares(spark: SparkSession, sf: str, by_department: bool) -> tuple[DataFrame, DataFrame]:
    """The settled factors of the allocation, and the rates of its units."""
    fact, end = _recent(spark, sf)
    table = rates.department_rates if by_department else rates.function_rates
    (modelled, history), heads, units, end = at_once(
        spark,
        lambda: _modelled_history(spark, sf),
        lambda: report.prepare_headcount(fixture.plan_headcount(spark, sf)),
        lambda: settle(table(fact, end), "rates"),
        lambda: calendar.resolved(fact, end),
    )
    ratios = planning.project_ratio(modelled)
    modes = planning.scenario_modes(fixture.scenarios(spark, sf), modelled)
    shares = allocation.factors(
        hours.added_hours(history.opening, hours.plan_factors(ratios, end)),
        end,
        heads,
        hours.project_passes(ratios),
        modes.where("mode = 'projects'"),
        by_department,
    )
    return settle(shares, "shares"), units


def _listed(spark: SparkSession, sf: str, by_department: bool) -> DataFrame:
    return allocation.listing(*_shares(spark, sf, by_department))


_ADDED = ("emp_pct", "add_hour_pct", "add_attendance_emp")


def allocation_function(spark: SparkSession, sf: str) -> DataFrame:
    table = _listed(spark, sf, by_department=False).select(
        "scenario_id", "project_name", "div", "sub_job_family_2", "date", "hc", "emp", *_ADDED
    )
    return rounded(table, emp_pct=4, add_hour_pct=2, add_attendance_emp=2)


def allocation_department(spark: SparkSession, sf: str) -> DataFrame:
    table = _listed(spark, sf, by_department=True).select(
        "scenario_id", "project_name", "div", "deptid", "sub_job_family_2", "date", "hc", "emp",
        *_ADDED,
    )
    return rounded(table, emp_pct=4, add_hour_pct=2, add_attendance_emp=2)


def allocation_share(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of the shares of each project, function and month: one, or missing."""
    sums = allocation.share_sums(*_shares(spark, sf, by_department=True))
    return rounded(sums.withColumnRenamed("units", "departments"), share=4)


def _project_report(spark: SparkSession, sf: str) -> DataFrame:
    units, heads, (modelled, history) = at_once(
        spark,
        lambda: report.units_of_call(*_recent(spark, sf), additive=False),
        lambda: report.prepare_headcount(fixture.plan_headcount(spark, sf)),
        lambda: _modelled_history(spark, sf),
    )
    scenarios = fixture.scenarios(spark, sf)
    plan = report.prepare_projects(modelled, history, units, scenarios, heads)
    return report.project_report(units, plan.scenarios.where("mode = 'projects'"), plan)


def project_what_if_function(spark: SparkSession, sf: str) -> DataFrame:
    return _project_report(spark, sf).where(F.col("Type") == rates.SUB)


def project_what_if_department(spark: SparkSession, sf: str) -> DataFrame:
    return _project_report(spark, sf).where(F.col("Type") == rates.DEP)


def _batch(spark: SparkSession, sf: str, additive: bool) -> DataFrame:
    fact, end = _recent(spark, sf)
    return report.score_scenarios(
        fact,
        fixture.scenarios(spark, sf),
        fixture.plan_projects(spark, sf),
        fixture.plan_headcount(spark, sf),
        end,
        additive=additive,
        project_fact=fixture.utilization(spark, sf, units=False),
        start=fixture.first_month(spark, sf),
    )


def scenario_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _batch(spark, sf, additive=False)


def scenario_batch_additive(spark: SparkSession, sf: str) -> DataFrame:
    """The same batch with departments summed over all functions, equal values included."""
    return _batch(spark, sf, additive=True)


def project_list_batch(spark: SparkSession, sf: str) -> DataFrame:
    """One scenario per valid line of a project list, all in one batch."""
    scenarios, planned = planning.scenarios_of_list(
        fixture.listed_projects(spark, sf), fixture.LIST_START
    )
    fact, end = _recent(spark, sf)
    return report.score_scenarios(
        fact,
        scenarios,
        planned,
        fixture.no_headcount(spark),
        end,
        project_fact=fixture.utilization(spark, sf, units=False),
        start=fixture.first_month(spark, sf),
    )


def report_records(spark: SparkSession, sf: str) -> DataFrame:
    """The head count report as JSON records, rates in percent."""
    return records.as_records(
        rounded(
            records.tidy_result(_headcount_report(spark, sf), "report", percent=True),
            **dict.fromkeys(("b_1", "b_2", "b_3", "a_1", "a_2", "a_3"), 1),
        )
    )


def project_month_profile(spark: SparkSession, sf: str) -> DataFrame:
    return life.project_month_profile(
        fixture.utilization(spark, sf, units=False),
        fixture.project_codes(spark, sf),
        before=fixture.LIFE_BEFORE,
    )


def _life(spark: SparkSession, sf: str):
    return life_report(
        fixture.utilization(spark, sf, units=False),
        fixture.project_codes(spark, sf),
        before=fixture.LIFE_BEFORE,
    )


def life_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return _life(spark, sf).projects


def life_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _life(spark, sf).statistics


def life_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return _life(spark, sf).sheet


def project_load(spark: SparkSession, sf: str) -> DataFrame:
    return projects.project_load(fixture.project_info(spark, sf))


def project_load_user(spark: SparkSession, sf: str) -> DataFrame:
    return projects.project_load(fixture.project_info(spark, sf), user_id="000")


def project_list(spark: SparkSession, sf: str) -> DataFrame:
    return projects.parse_project_lines(fixture.project_lines(spark, sf)).drop("line")


def project_list_file(spark: SparkSession, sf: str) -> DataFrame:
    """The project list written as a text file and read line by line."""
    path = place(spark, "project_list")
    fixture.project_lines(spark, sf).write.text(path)
    return readers.read_project_list(spark, path).drop("line")


def headcount_file(spark: SparkSession, sf: str) -> DataFrame:
    """Head count by unit and project, from a sheet that was written with a header and read again.

    A sheet does not tell blank text from missing text, which is taken as blank.
    """
    path = place(spark, "headcount_sheet")
    raw = fixture.plan_headcount(spark, sf).withColumns({
        "Serial": F.col("scenario_id").cast("string"), "savetime": F.lit("2022/3/4 10:20"), "UserId": F.lit("001"),
    })
    writers.write_sheet(raw.select(*schemas.HEADCOUNT_FILE.names), path)
    keys = ["div", "deptid", "project_code", "project_name", "sub_job_family"]
    return readers.read_headcount_csv(spark, path).fillna("", keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr(f"{numeric.lenient_sum(numeric.parse_number('HC'))} AS hc"),
    )


def list_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Log of the lines of the project list that are left out of the batch."""
    lines = projects.parse_project_lines(fixture.project_lines(spark, sf))
    return _logged(records.rejected_lines(lines, "001", _SAVED))


def _logged(log: DataFrame) -> DataFrame:
    return log.withColumn("save_time", F.date_format("save_time", "yyyy-MM-dd HH:mm"))


def _answered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    requests = parse_requests(fixture.request_lines(spark, sf))
    asked, units, history = at_once(
        spark,
        lambda: report.prepare_requests(requests),
        lambda: report.prepare_units(*_recent(spark, sf)),
        lambda: _history(spark, sf),
    )
    return report.answer_requests(requests, units, history, _SAVED, asked)


def request_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to all requests that came as JSON text."""
    return _answered(spark, sf)[0].drop("scenario_id")


def request_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Log of all requests without an answer, with their whole text."""
    return _logged(_answered(spark, sf)[1])


def life_months(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of the projects by month of life, in long form."""
    return _life(spark, sf).months.select(
        "project_code", "sub_job_family_2", "ordinal", "date", "hour_per_cnt"
    )


def tidy_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """Department allocation, tidied: one decimal for the hours."""
    table = _listed(spark, sf, by_department=True).select(
        "scenario_id", "project_name", "div", "deptid", "sub_job_family_2", "date",
        "add_hour_pct", "total_hour_dept_func",
    )
    return records.tidy_result(table, "allocation")


def tidy_department_outlook(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of every department and month with what new projects add, tidied."""
    shares, units = _shares(spark, sf, by_department=True)
    outlook = allocation.department_outlook(
        shares, units.withColumnRenamed("total_hour_dept_func", "total_hour")
    )
    return records.tidy_result(
        outlook.withColumnRenamed("total_hour", "total_hour_dept_func"), "department_outlook"
    )


def purge_user(spark: SparkSession, sf: str) -> DataFrame:
    return projects.purge_user(fixture.table(spark, sf, "events"), 8)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        function_rates, department_rates, unit_rates, unit_rates_by_load, project_profile, headcount_plan,
        active_titles, unknown_titles, history_report, history_report_function, history_report_department,
        hc_what_if_function, hc_what_if_department, rate_report, plan_clean, plan_rejects,
        scenario_modes, reject_log, project_ratio, opening_hours, project_hours,
        start_proration, tidy_result, allocation_function, allocation_department,
        allocation_share, project_what_if_function, project_what_if_department,
        scenario_batch, scenario_batch_additive, project_list_batch, report_records,
        project_month_profile, life_pivot, life_statistics, life_sheet, project_load,
        project_load_user, project_list, project_list_file, headcount_file, purge_user, list_rejects, request_batch,
        request_rejects, life_months, tidy_allocation, tidy_department_outlook,
    )
}
