"""Outlook of every unit in every scenario, with added head count or new projects.

The units of a division come as wide sheets (``rates.function_sheet`` and so on), so a
scenario row meets each unit once and holds its three outlook months side by side.
Column ``name_k`` belongs to the k-th outlook month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffcast.functions import numeric
from staffcast.operators import rates

STEPS = (1, 2, 3)
_FUNCTION = ["div", "sub_job_family_2"]
_DEPARTMENT = ["div", "deptid"]


def _steps(**templates: str) -> list[str]:
    """Expressions for the three outlook months; ``#`` stands for the number of the month."""
    return [
        f"{template.replace('#', str(k))} AS {name}_{k}"
        for name, template in templates.items()
        for k in STEPS
    ]


def _sums(*names: str) -> list[Column]:
    return [F.expr(f"sum({name}_{k}) AS {name}_{k}") for name in names for k in STEPS]


def _along(rows: DataFrame) -> list[str]:
    """What goes along with a scenario where it has them: the user and the key of the request."""
    return [c for c in rows.columns if c in ("user_id", "request_id")]


def _units_with(scenarios: DataFrame, sheet: DataFrame, added: DataFrame, unit: str) -> DataFrame:
    """Every unit of the division a scenario asks about, with what is added to few of them.

    What is added to the units of a scenario is gathered to one list, bounded by the units, so
    scenarios are exchanged and never their units. All exchanges go by the scenario alone: those
    that ``added`` or the scenarios have behind them are not made again.
    """
    values = [c for c in added.columns if c not in ("scenario_id", "div", unit)]
    entries = F.collect_list(F.struct("div", F.col(unit).alias("unit"), F.struct(*values).alias("of")))
    named = added.where(F.col(unit).isNotNull()).groupBy("scenario_id").agg(entries.alias("added"))
    asked = scenarios.select("scenario_id", F.col("division").alias("div"), *_along(scenarios))
    here = F.expr("""map_from_entries(transform(
        filter(added, a -> a.div = div), a -> named_struct('key', a.unit, 'value', a.of)))""")
    rows = asked.join(named, "scenario_id", "left").withColumn("added", here).join(sheet, "div")
    return rows.withColumn("added", F.try_element_at("added", F.col(unit))).select("*", "added.*").drop("added")


def _report(rows: DataFrame, kind: str, title: str, hc: str, outlook: str) -> DataFrame:
    return rows.selectExpr(
        "scenario_id",
        "div AS Div",
        f"'{kind}' AS Type",
        f"{title} AS Title",
        *_steps(b=numeric.or_zero("b_#")),
        f"{numeric.or_zero(hc)} AS hc",
        *_steps(a=numeric.or_zero(numeric.round2(outlook))),
        *_along(rows),
    )


def hc_what_if_function(
    scenarios: DataFrame, functions: DataFrame, headcount: DataFrame
) -> DataFrame:
    """Functions when only head count is added: more attendance, the same hours."""
    staff = headcount.groupBy("scenario_id", *_FUNCTION).agg(
        F.expr(f"{numeric.or_zero(numeric.strict_sum('hc'))} AS hc")
    )
    rows = _units_with(scenarios, functions, staff, "sub_job_family_2")
    return _report(
        rows, rates.SUB, "sub_job_family_2", "hc",
        numeric.safe_div("hour_#", "att_# + att_emp_# * coalesce(hc, 0D)"),
    )


def hc_what_if_department(
    scenarios: DataFrame,
    departments: DataFrame,
    department_functions: DataFrame,
    headcount: DataFrame,
) -> DataFrame:
    """Departments when only head count is added: mean rate of their functions.

    The whole head count of a department is added to each of its functions. Only the
    departments that get head count are worked out again; the others keep their rate.
    """
    staff = headcount.groupBy("scenario_id", *_DEPARTMENT).agg(
        F.expr(f"{numeric.or_zero(numeric.strict_sum('hc'))} AS hc")
    )
    rate = numeric.safe_div("hour_#", "(emp_# + hc) * att_emp_#")
    changed = (
        staff.join(department_functions, _DEPARTMENT)
        .selectExpr(
            "scenario_id", *_DEPARTMENT, "hc", *_steps(rate=rate, seen="seen_#")
        )
        .groupBy("scenario_id", *_DEPARTMENT)
        .agg(F.max("hc").alias("hc"), *[F.expr(e) for e in _steps(
            changed="CASE WHEN count(rate_#) = sum(seen_#) THEN avg(rate_#) END"
        )])
    )
    rows = _units_with(scenarios, departments, changed, "deptid")
    return _report(
        rows, rates.DEP, "deptid", "hc",
        "CASE WHEN hc IS NULL THEN plain_# ELSE changed_# END",
    )


def project_staff(
    headcount: DataFrame, passes: DataFrame, department_functions: DataFrame
) -> DataFrame:
    """Head count of the new projects by department and function.

    Only rows that carry the name of a project of their scenario count. Departments
    without any rate keep their row: their head count still counts for the function.
    """
    named = (
        headcount.groupBy("scenario_id", "project_name", "div", "deptid", "sub_job_family_2")
        .agg(F.expr(f"{numeric.lenient_sum('hc')} AS hc"))
        .join(passes, ["scenario_id", "project_name", "div"])
    )
    units = department_functions.select(
        *_DEPARTMENT,
        "sub_job_family_2",
        *[f"{name}_{k}" for name in ("att_emp", "seen") for k in STEPS],
    )
    return named.join(units, [*_DEPARTMENT, "sub_job_family_2"], "left")


def project_effects(
    added: DataFrame, staff: DataFrame, functions: DataFrame
) -> DataFrame:
    """What each new project adds to each function of its division.

    ``hour`` are the added hours, ``hc`` the added head count, and ``per_head`` the
    hours that fall on one head when the hours are shared over all departments: added
    hours over employees plus added head count. ``has_staff`` tells whether the project plans
    any head count in the function. Hours and head count are stacked and summed by one
    aggregation instead of being joined.
    """
    keys = ["scenario_id", "project_name", "div", "sub_job_family_2"]
    hours = added.selectExpr(
        *keys, "0D AS hc", "0L AS passes", "false AS has_staff", *_steps(hour="hour_#", staffed="0D")
    )
    heads = staff.selectExpr(
        *keys, "hc", "passes", "true AS has_staff",
        *_steps(hour="0D", staffed="CASE WHEN seen_# = 1 THEN hc ELSE 0D END"),
    )
    summed = hours.unionByName(heads).groupBy(*keys).agg(
        F.sum("hc").alias("hc"), F.max("passes").alias("passes"),
        F.max("has_staff").alias("has_staff"), *_sums("hour", "staffed"),
    )
    heads_of = functions.select(
        *_FUNCTION, *[f"{n}_{k}" for n in ("emp", "dep_emp") for k in STEPS]
    )
    return summed.join(heads_of, _FUNCTION).selectExpr(
        *keys,
        "has_staff",
        "hc * passes AS hc",
        *_steps(
            # With no head at all in the function there is nobody to give the hours to.
            hour="CASE WHEN emp_# + hc <> 0 THEN hour_# ELSE 0D END",
            per_head=f"coalesce({numeric.safe_div('hour_#', 'dep_emp_# + staffed_#')}, 0D)",
        ),
    )


def project_what_if_function(
    scenarios: DataFrame, functions: DataFrame, effects: DataFrame
) -> DataFrame:
    """Functions with new projects: base once, plus the sum over all projects."""
    added = effects.selectExpr(
        "scenario_id", *_FUNCTION, "hc AS add_hc", *_steps(add_hour="hour_#")
    ).groupBy("scenario_id", *_FUNCTION).agg(F.sum("add_hc").alias("add_hc"), *_sums("add_hour"))
    rows = _units_with(scenarios, functions, added, "sub_job_family_2")
    return _report(
        rows, rates.SUB, "sub_job_family_2",
        "CASE WHEN greatest(seen_1, seen_2, seen_3) = 1 THEN add_hc END",
        numeric.safe_div(
            "(hour_# + coalesce(add_hour_#, 0D))",
            "(att_# + coalesce(att_emp_# * add_hc, 0D))",
        ),
    )


def project_what_if_department(
    scenarios: DataFrame,
    departments: DataFrame,
    department_functions: DataFrame,
    effects: DataFrame,
    staff: DataFrame,
) -> DataFrame:
    """Departments with new projects: base once, plus the sum over functions and projects.

    The hours of a department are (employees + own added head count) x hours per head.
    The employee part is summed over the projects of a scenario before departments come
    in; the head count part only touches the departments that get head count. Both are dealt
    by scenario before they are listed by department, so no exchange sees that list.
    """
    sums = _sums("add_hour", "add_att", "add_hc")
    per_head = (
        effects.groupBy("scenario_id", *_FUNCTION).agg(*_sums("per_head")).repartition("scenario_id")
    )
    by_employees = per_head.join(department_functions, _FUNCTION).selectExpr(
        "scenario_id", *_DEPARTMENT,
        *_steps(add_hour="coalesce(emp_# * per_head_#, 0D)", add_att="0D", add_hc="0D"),
    )
    keys = ["scenario_id", "project_name", *_FUNCTION]
    by_headcount = staff.join(
        effects.where("has_staff").select(*keys, *[f"per_head_{k}" for k in STEPS]), keys
    ).selectExpr(
        "scenario_id", *_DEPARTMENT,
        *_steps(
            add_hour="CASE WHEN seen_# = 1 THEN hc * per_head_# ELSE 0D END",
            add_att="coalesce(att_emp_# * hc * passes, 0D)",
            add_hc="CASE WHEN seen_# = 1 THEN hc * passes ELSE 0D END",
        ),
    ).groupBy("scenario_id", *_DEPARTMENT).agg(*sums).repartition("scenario_id")
    added = by_employees.unionByName(by_headcount).groupBy("scenario_id", *_DEPARTMENT).agg(*sums)
    rows = _units_with(scenarios, departments, added, "deptid")
    hc = ", ".join(f"CASE WHEN seen_{k} = 1 THEN coalesce(add_hc_{k}, 0D) END" for k in STEPS)
    return _report(
        rows, rates.DEP, "deptid", f"greatest({hc})",
        numeric.safe_div(
            "(hour_# + coalesce(add_hour_#, 0D))",
            "(att_emp_# * emp_# + coalesce(add_att_#, 0D))",
        ),
    )
