"""Rates of functions and departments, and the profile of past projects."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffcast import schemas
from staffcast.functions import calendar, numeric

DEP, SUB = "DEP", "SUB"
FUNCTION_KEYS = ("div", "sub_job_family_2", "date")
DEPARTMENT_KEYS = ("div", "deptid", "sub_job_family_2", "date")

# What is summed of a unit and month.
MEASURES = (
    "utilization_rate_by_dep", "utilization_rate_by_div_func", "total_hour", "attendance",
    "termination_n",
)

# Employees of the month less those about to leave.
_EMPLOYEES = (
    f"double({numeric.distinct_with_missing('emplid')} - "
    f"{numeric.strict_sum('termination_n')}) AS emp_cnt"
)
_ATTENDANCE_EMP = f"{numeric.strict_avg('attendance')} AS attendance_emp"


def _aggregates(*texts: str) -> list[Column]:
    return [F.expr(text) for text in texts]


def _recent(fact: DataFrame, end: Column) -> DataFrame:
    """Six months of the fact; a missing department or function is the blank one."""
    recent = fact.where(F.col("date") >= F.add_months(end, 1 - calendar.REPORT_MONTHS))
    return recent.fillna("", ["deptid", "sub_job_family_2"])


def _strict_sum(name: str) -> str:
    """Sum over partial sums, missing where a row had no value."""
    return f"CASE WHEN sum(n_{name}) = sum(rows) THEN double(sum(sum_{name})) END"


def _strict_avg(name: str) -> str:
    return f"CASE WHEN sum(n_{name}) = sum(rows) THEN sum(sum_{name}) / sum(rows) END"


def _partial(*names: str) -> list[Column]:
    """Rows, and sum and number of the values of some columns."""
    sums = [f"sum({n}) AS sum_{n}" for n in names]
    return _aggregates("count(1) AS rows", *sums, *[f"count({n}) AS n_{n}" for n in names])


def function_rates(fact: DataFrame, end: dt.date | Column | None = None) -> DataFrame:
    """Last six months by division, function and month."""
    return (
        _recent(fact, calendar.anchor(fact, end))
        .groupBy(*FUNCTION_KEYS)
        .agg(*_aggregates(
            f"{numeric.strict_avg('utilization_rate_by_div_func')} AS uti_rate",
            f"{numeric.strict_sum('total_hour')} AS total_hour_func",
            f"{numeric.strict_sum('attendance')} AS attendance_func",
            _EMPLOYEES,
            _ATTENDANCE_EMP,
        ))
    )


def department_rates(fact: DataFrame, end: dt.date | Column | None = None) -> DataFrame:
    """Last six months by division, department, function and month."""
    return (
        _recent(fact, calendar.anchor(fact, end))
        .groupBy(*DEPARTMENT_KEYS)
        .agg(*_aggregates(
            f"{numeric.strict_avg('utilization_rate_by_dep')} AS uti_rate",
            f"{numeric.strict_sum('total_hour')} AS total_hour_dept_func",
            _EMPLOYEES,
            _ATTENDANCE_EMP,
        ))
    )


def unit_rates(fact: DataFrame, end: dt.date | Column | None = None) -> DataFrame:
    """Function and department rates together, from one scan of six months of the fact.

    The rows are summed by employee first. Only these sums are repeated for the two
    groupings, and distinct employees are counted among them.
    """
    end = calendar.anchor(fact, end)
    employed = _recent(fact, end).groupBy(*DEPARTMENT_KEYS, "emplid").agg(*_partial(*MEASURES))
    return (
        employed.groupingSets(_unit_sets(), *map(F.col, DEPARTMENT_KEYS))
        .agg(
            F.expr(f"CASE WHEN grouping(deptid) = 0 THEN '{DEP}' ELSE '{SUB}' END AS type"),
            *_unit_measures("grouping(deptid) = 0", numeric.distinct_with_missing("emplid")),
        )
        .withColumn("month_no", calendar.month_number(F.col("date"), end))
    )


def _unit_sets(*more: str) -> list[list[Column]]:
    """Departments with their functions, and functions over all departments."""
    return [[F.col(k) for k in (*keys, *more)] for keys in (DEPARTMENT_KEYS, FUNCTION_KEYS)]


def _unit_measures(is_department: str, employees: str) -> list[Column]:
    """Rates of a unit and month over partial sums of its rows."""
    return _aggregates(
        f"""CASE WHEN {is_department}
            THEN {_strict_avg('utilization_rate_by_dep')}
            ELSE {_strict_avg('utilization_rate_by_div_func')} END AS uti_rate""",
        f"{_strict_sum('total_hour')} AS total_hour",
        f"{_strict_sum('attendance')} AS attendance",
        f"double({employees} - {_strict_sum('termination_n')}) AS emp_cnt",
        f"{_strict_avg('attendance')} AS attendance_emp",
    )


#: Columns of the states: partial sums, numbers of values, and employees as a bitmap.
STATE_COLUMNS = ", ".join([
    "div string", "deptid string", "sub_job_family_2 string", "date date", "bucket bigint", "rows bigint",
    *[f"sum_{m} {'bigint' if m == 'termination_n' else 'double'}, n_{m} bigint" for m in MEASURES],
    "employees binary",
])


def unit_states(fact: DataFrame, numbers: DataFrame) -> DataFrame:
    """Partial states of the unit rates: they add up over any split of the rows.

    One row per department, function, month and bucket of employee numbers: partial sums, and
    the employees as a bitmap over ``numbers`` (emplid, number), which must hold every employee of
    the rows. Rows without an employee are in the bucket that is missing.
    """
    employed = (
        fact.fillna("", ["deptid", "sub_job_family_2"])
        .groupBy(*DEPARTMENT_KEYS, "emplid").agg(*_partial(*MEASURES))
    )
    numbered = employed.join(numbers, "emplid", "left").withColumn(
        "bucket", F.bitmap_bucket_number("number")
    )
    return numbered.groupBy(*DEPARTMENT_KEYS, "bucket").agg(
        *_added(),
        F.expr("CASE WHEN bucket IS NOT NULL THEN "
               "bitmap_construct_agg(bitmap_bit_position(number)) END AS employees"),
    )


def rates_of_states(states: DataFrame, end: dt.date | Column | None = None) -> DataFrame:
    """The unit rates of the last six months, from the states of any number of loads.

    The same rows and columns as ``unit_rates`` over all rows of the loads. The states of a unit are
    added by bucket; employees of several departments or loads count once.
    """
    end = calendar.anchor(states, end)
    recent = states.where(F.col("date") >= F.add_months(end, 1 - calendar.REPORT_MONTHS))
    by_bucket = recent.groupingSets(
        _unit_sets("bucket"), *map(F.col, [*DEPARTMENT_KEYS, "bucket"])
    ).agg(
        F.expr(f"CASE WHEN grouping(deptid) = 0 THEN '{DEP}' ELSE '{SUB}' END AS type"),
        *_added(),
        F.expr("bitmap_or_agg(employees) AS employees"),
    )
    distinct = "coalesce(sum(CASE WHEN bucket IS NOT NULL THEN bitmap_count(employees) END), 0L)"
    return (
        by_bucket.groupBy("type", *DEPARTMENT_KEYS)
        .agg(*_unit_measures(f"type = '{DEP}'", f"({distinct} + max(bigint(bucket IS NULL)))"))
        .withColumn("month_no", calendar.month_number(F.col("date"), end))
    )


def _added() -> list[Column]:
    """Partial sums over partial sums."""
    names = ["rows", *[f"{part}_{name}" for name in MEASURES for part in ("sum", "n")]]
    return _aggregates(*[f"sum({name}) AS {name}" for name in names])


def _wide(months: tuple[int, ...], **values: str) -> list[Column]:
    """One column per value and report month: ``name_1`` is the first of ``months``."""
    return _aggregates(*[
        f"max(CASE WHEN month_no = {month} THEN {value} END) AS {name}_{k}"
        for name, value in values.items()
        for k, month in enumerate(months, start=1)
    ])


def _seen() -> list[Column]:
    """Whether the unit has a rate in each outlook month, as 0 or 1."""
    return _aggregates(*[
        f"max(int(month_no = {month})) AS seen_{k}"
        for k, month in enumerate(calendar.OUTLOOK, start=1)
    ])


def function_sheet(rates: DataFrame) -> DataFrame:
    """One row per division and function with the six months side by side.

    ``b`` is the history; the other columns are what the outlook months are made of.
    ``dep_emp`` is the head count summed over the departments of the function. Months
    become columns here, on the small rate table, so scenarios are never multiplied by
    months and need no pivot of their own.
    """

    def own(value: str) -> str:
        return f"CASE WHEN type = '{SUB}' THEN {value} END"

    def departments(month: int) -> str:
        here = f"type = '{DEP}' AND month_no = {month}"
        return f"""CASE WHEN count_if({here} AND emp_cnt IS NULL) = 0
            THEN sum(CASE WHEN {here} THEN emp_cnt END) END"""

    return rates.groupBy("div", "sub_job_family_2").agg(
        *_wide(calendar.HISTORY, b=own(numeric.round2("uti_rate"))),
        *_wide(
            calendar.OUTLOOK,
            hour=own("total_hour"),
            att=own("attendance"),
            emp=own("emp_cnt"),
            att_emp=own("attendance_emp"),
        ),
        *_aggregates(*[
            f"{departments(m)} AS dep_emp_{k}" for k, m in enumerate(calendar.OUTLOOK, start=1)
        ]),
        *_seen(),
    )


def department_function_sheet(rates: DataFrame) -> DataFrame:
    """One row per division, department and function with the outlook months side by side."""
    return rates.where(f"type = '{DEP}'").groupBy("div", "deptid", "sub_job_family_2").agg(
        *_wide(calendar.OUTLOOK, hour="total_hour", emp="emp_cnt", att_emp="attendance_emp"),
        *_seen(),
    )


def department_sheet(rates: DataFrame, additive: bool = False) -> DataFrame:
    """One row per division and department with the six months side by side.

    ``b`` is the mean rate of the functions. ``plain`` is the outlook without added
    head count. ``hour``, ``emp`` and ``att_emp`` sum the distinct values of the
    functions, so two functions with the same value count once; ``additive`` sums all.
    """
    total = numeric.strict_sum if additive else numeric.strict_sum_distinct
    monthly = (
        rates.where(f"type = '{DEP}'")
        .withColumn("own", F.expr(numeric.safe_div("total_hour", "emp_cnt * attendance_emp")))
        .groupBy("div", "deptid", "month_no")
        .agg(*_aggregates(
            f"{numeric.strict_avg('uti_rate')} AS rate",
            f"{numeric.strict_avg('own')} AS plain",
            f"{total('total_hour')} AS hour",
            f"{total('emp_cnt')} AS emp",
            f"{total('attendance_emp')} AS att_emp",
        ))
    )
    return monthly.groupBy("div", "deptid").agg(
        *_wide(calendar.HISTORY, b=numeric.round2("rate")),
        *_wide(
            calendar.OUTLOOK,
            plain=numeric.round2("plain"),
            hour="hour",
            emp="emp",
            att_emp="att_emp",
        ),
        *_seen(),
    )


STAGE_KEYS = ("project_code", "project_start_stage")


def stage_sums(fact: DataFrame, started: dt.date | Column | None = None) -> DataFrame:
    """Partial sums of the projects that started inside the fact, by project and start stage."""
    means = [*schemas.STAGE_DAYS, "execute_hour", "execute_month"]
    first = calendar.opening_date(fact, started)
    return (
        fact.where(F.col("pmcs_bu_start_dt") >= first)
        .groupBy(*STAGE_KEYS)
        .agg(
            *_partial(*means),
            *_aggregates("count(execute_day) AS n_execute_day", "max(execute_day) AS max_execute_day"),
        )
    )


def project_profile(fact: DataFrame, started: dt.date | Column | None = None) -> DataFrame:
    """Mean stage days and effort of the projects that started inside the fact.

    One row per project and distinct start stage; ``stage_rows`` counts them. ``started``
    is the first date of the whole fact, for callers that know it or pass a part of it. The
    fact is summed by project and stage first, so a large project reaches the second sum as
    a handful of rows, whose stages are listed below each other again.
    """
    means = [*schemas.STAGE_DAYS, "execute_hour", "execute_month"]
    return (
        _project_sums(fact, started, *means)
        .selectExpr(
            "project_code",
            *[f"{_mean(c)} AS {c.removesuffix('_day')}" for c in means],
            "CASE WHEN n_execute_day = rows THEN max_execute_day END AS execute_day",
            "inline(stages)",
            "stage_rows",
        )
    )


def project_efforts(fact: DataFrame, started: dt.date | Column | None = None) -> DataFrame:
    """Effort of every project of the profile, one row each: what plans are modelled on."""
    return _project_sums(fact, started, "execute_hour", "execute_month").selectExpr(
        "project_code",
        f"{_mean('execute_hour')} AS old_hour",
        f"{_mean('execute_month')} AS old_month",
        "stage_rows",
    )


def _mean(name: str) -> str:
    return f"CASE WHEN n_{name} = rows THEN sum_{name} / rows END"


def _project_sums(fact: DataFrame, started: dt.date | Column | None, *means: str) -> DataFrame:
    names = ["rows", *[f"{part}_{name}" for name in means for part in ("sum", "n")], "n_execute_day"]
    return stage_sums(fact, started).groupBy("project_code").agg(
        *_aggregates(*[f"sum({name}) AS {name}" for name in names]),
        *_aggregates(
            "max(max_execute_day) AS max_execute_day",
            "collect_list(struct(project_start_stage)) AS stages",
            "count(1) AS stage_rows",
        ),
    )
