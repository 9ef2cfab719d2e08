"""Added hours shared out over the units that work on a function, kept as factors.

The share of a unit in the hours of a project is its employees plus added head count over the
same sum of all units of the function. What depends on the project (its hours and added heads
by function) is one row per project; what depends on the units (employees and attendance by
month) is the rate table. The listing of every project by unit and month is only made where it is
read, and no exchange sees its rows; sums over it are made without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffcast.functions import numeric
from staffcast.operators.hours import month_hours

_FUNCTION = ["div", "sub_job_family_2", "date"]
_PROJECT = ["scenario_id", "project_name", "div"]


def factors(
    added: DataFrame, end: Column, headcount: DataFrame, projects: DataFrame, scenarios: DataFrame,
    by_department: bool,
) -> DataFrame:
    """One row per new project: how often its heads count, its hours, and its added heads.

    ``added`` are the added hours of the plan rows, ``projects`` the passes of the projects and
    ``scenarios`` those that are listed. ``hours`` maps functions to hours by date, ``staff``
    functions to head count, by department where wanted. The maps are bounded by the functions and
    departments that the project names.
    """
    keys = [*_PROJECT, "sub_job_family_2"]
    unit = [*keys, "deptid"] if by_department else keys
    heads = headcount.groupBy(*unit).agg(F.expr(f"{numeric.lenient_sum('hc')} AS hc"))
    if by_department:
        entries = F.map_from_entries(F.collect_list(F.struct("deptid", "hc")))
        heads = heads.groupBy(*keys).agg(entries.alias("hc"))
    worked = month_hours(added, end)
    both = worked.select(*keys, "hours", F.lit(None).cast(heads.schema["hc"].dataType).alias("hc")).unionByName(
        heads.select(*keys, F.lit(None).cast(worked.schema["hours"].dataType).alias("hours"), "hc")
    )

    def by_function(value: str, name: str) -> Column:
        return F.expr(
            f"map_from_entries(collect_list(struct(sub_job_family_2, {value})) "
            f"FILTER (WHERE {value} IS NOT NULL)) AS {name}"
        )

    named = both.groupBy(*_PROJECT).agg(by_function("hours", "hours"), by_function("hc", "staff"))
    return projects.join(scenarios.select("scenario_id"), "scenario_id").join(named, _PROJECT, "left")


def _by_department(rates: DataFrame) -> bool:
    return "deptid" in rates.columns


def _function_months(rates: DataFrame) -> DataFrame:
    """Heads, number of units and, with departments, the departments of every function and month."""
    departments = [F.collect_set("deptid").alias("departments")] if _by_department(rates) else []
    return rates.groupBy(*_FUNCTION).agg(
        F.expr(f"{numeric.strict_sum('emp_cnt')} AS employed"),
        F.sum("emp_cnt").alias("heads"),
        F.count(F.lit(1)).alias("units"),
        *departments,
    )


def _shared(rows: DataFrame, by_department: bool) -> DataFrame:
    """Rows of projects by function and month with their hours and with all heads that share them."""
    staffed = "staff_here"
    if by_department:
        # Heads of departments that have a rate in the month.
        staffed = (
            "aggregate(map_values(map_filter(staff_here, (d, h) -> array_contains(departments, d))), "
            "0D, (x, y) -> x + y)"
        )
    return rows.selectExpr(
        "*",
        "try_element_at(try_element_at(hours, sub_job_family_2), date) AS add_hour_adj",
        "try_element_at(staff, sub_job_family_2) AS staff_here",
    ).withColumn("staffed", F.expr(f"coalesce({staffed}, 0D)")).withColumn(
        "emp_all", F.expr("employed + staffed")
    ).drop("hours", "staff")


def listing(projects: DataFrame, rates: DataFrame) -> DataFrame:
    """Share of every unit in the added hours of every project, month by month.

    ``projects`` are the settled factors and ``rates`` the settled function or department rates.
    """
    own = F.struct(*[c for c in rates.columns if c not in _FUNCTION])
    held = rates.dropna("any", subset=_FUNCTION).groupBy(*_FUNCTION).agg(F.collect_list(own).alias("held"))
    months = _function_months(rates).join(held, _FUNCTION)
    hc = "try_element_at(staff_here, deptid)" if _by_department(rates) else "staff_here"
    # What the units of a function share is worked out once, before they are listed.
    return (
        _shared(projects.join(months, "div"), _by_department(rates))
        .select("*", F.inline("held")).drop("held")
        .withColumn("hc", F.expr(f"coalesce({hc}, 0D)"))
        .withColumn("emp", F.expr("emp_cnt + hc"))
        .withColumn("emp_pct", F.expr(numeric.safe_div("emp", "emp_all")))
        .withColumn("add_hour_pct", F.expr("add_hour_adj * emp_pct"))
        .withColumn("add_attendance_emp", F.expr("attendance_emp * hc * passes"))
        .drop("emp_all", "units", "staff_here", "staffed", "employed", "heads", "departments")
    )


def share_sums(projects: DataFrame, rates: DataFrame) -> DataFrame:
    """Sum of the shares of each project, function and month, and the number of its units.

    The heads of the units are summed by function and month, the added heads in each row; a sum
    of shares is their quotient by all heads.
    """
    rows = _shared(projects.join(_function_months(rates), "div"), _by_department(rates))
    total = numeric.safe_div("(heads + staffed)", "emp_all")
    return rows.selectExpr("scenario_id", "project_name", *_FUNCTION, f"{total} AS share", "units")


def department_outlook(projects: DataFrame, rates: DataFrame) -> DataFrame:
    """Hours of every department and month over all projects and functions, and what projects add.

    Hours per head are summed over the projects of a scenario before departments come in. Added
    heads only touch the departments that get some. Missing values count as zero.
    """
    # Projects are exchanged before they are multiplied by functions and months, and sums stay where they are.
    dealt = projects.repartition("scenario_id")
    shared = _shared(dealt.join(_function_months(rates), "div"), True).withColumn(
        "per_head", F.expr(numeric.safe_div("add_hour_adj", "emp_all"))
    )
    of_function = shared.groupBy("scenario_id", *_FUNCTION).agg(
        F.sum("per_head").alias("per_head"), F.count(F.lit(1)).alias("projects")
    )
    keys = ["scenario_id", "div", "deptid", "date"]
    by_employees = of_function.join(rates, _FUNCTION).selectExpr(
        *keys, "emp_cnt * per_head AS add_hour_pct", "total_hour * projects AS total_hour"
    )
    by_heads = (
        shared.select(
            "scenario_id", "div", "date", "per_head", "departments", F.explode("staff_here").alias("deptid", "hc")
        )
        .where("array_contains(departments, deptid)")
        .selectExpr(*keys, "hc * per_head AS add_hour_pct", "CAST(NULL AS DOUBLE) AS total_hour")
    )
    return by_employees.unionByName(by_heads).groupBy(*keys).agg(
        F.expr(f"{numeric.lenient_sum('add_hour_pct')} AS add_hour_pct"),
        F.expr(f"{numeric.lenient_sum('total_hour')} AS total_hour"),
    )
