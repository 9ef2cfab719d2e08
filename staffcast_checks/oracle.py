"""DuckDB SQL for every registered query.

Written row by row and month by month, with windows and long tables, so that it shares
no formulation with the Spark job it is compared with.
"""

from __future__ import annotations

import re


def r(value: str, digits: int = 2) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,6)), {digits}) AS DOUBLE)"


def pick(values: tuple[str, ...], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[CAST({index} % {len(values)} AS INTEGER) + 1]"


def mapped(code: str) -> str:
    return (
        f"CASE WHEN {code} IN ('AR','HW','OP','RF','RX') THEN 'RH' "
        f"WHEN {code} = 'PV' THEN 'E4' ELSE {code} END"
    )


def strict(function: str, value: str) -> str:
    return f"CASE WHEN COUNT({value}) = COUNT(*) THEN {function}({value}) END"


FUNCTION_CODE = pick(("HW", "RF", "OP", "PV", "E4", "ME"), "l_suppkey")
PLAN_CODE = pick(("HW", "RF", "OP", "PV", "E4", "ME", "AR"), "o_orderkey")
LEAVING = "(l_returnflag = 'R' AND l_linenumber = 7)"
DAYS = ", ".join(
    f"CAST(l_partkey % 50 + {10 * i} AS DOUBLE) AS C{i}_day" for i in range(6)
)
MEAN_DAYS = ", ".join(f"{strict('AVG', f'C{i}_day')} AS C{i}" for i in range(7))
FUNCTION_RATE = r(
    "(MAX(total_hour_func) + COALESCE(SUM(add_hour_pct), 0)) "
    "/ NULLIF(MAX(attendance_func) + COALESCE(SUM(add_attendance_emp), 0), 0)"
)
DEPARTMENT_RATE = r(
    "(CASE WHEN COUNT(total_hour_dept_func) = COUNT(*) THEN SUM(DISTINCT total_hour_dept_func) END "
    "+ COALESCE(SUM(add_hour_pct), 0)) "
    "/ NULLIF(SUM(DISTINCT attendance_emp) * SUM(DISTINCT emp_cnt) "
    "+ COALESCE(SUM(add_attendance_emp), 0), 0)"
)
EMP = (
    "CAST(COUNT(DISTINCT emplid) + MAX(CASE WHEN emplid IS NULL THEN 1 ELSE 0 END) "
    "- SUM(termination_n) AS DOUBLE) AS emp_cnt"
)

# Named steps, each built on earlier ones.
STEPS: dict[str, str] = {
    "fact": f"""
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               r_name AS div,
               CASE WHEN l_suppkey % 17 IN (0, 1) THEN '' ELSE n_name END AS deptid,
               CASE WHEN l_suppkey % 19 <> 5 THEN CAST(l_suppkey AS VARCHAR) END AS emplid,
               {FUNCTION_CODE} AS sub_job_family,
               {mapped(FUNCTION_CODE)} AS sub_job_family_2,
               'P' || l_partkey AS project_code,
               'C' || CASE WHEN l_partkey % 10 = 3 THEN l_linenumber % 2
                           ELSE l_partkey % 7 END AS project_start_stage,
               l_linestatus AS stage,
               CAST(DATE '1994-07-01' + to_months(CAST(l_partkey % 24 AS INTEGER)) AS DATE)
                   AS pmcs_bu_start_dt,
               {DAYS},
               CASE WHEN NOT {LEAVING} THEN CAST(l_partkey % 50 + 60 AS DOUBLE) END AS C6_day,
               CAST(100 * (l_partkey % 90) AS DOUBLE) AS execute_hour,
               CAST(1 + l_partkey % 36 AS DOUBLE) AS execute_month,
               CAST(20 * (1 + l_partkey % 36) + l_linenumber AS DOUBLE) AS execute_day,
               CASE WHEN (l_orderkey + l_linenumber) % 499 <> 3 THEN l_quantity END
                   AS total_hour, l_quantity + l_linenumber AS attendance,
               CASE WHEN {LEAVING} THEN 1 ELSE 0 END AS termination_n,
               l_quantity / (l_quantity + l_linenumber) AS rate_func,
               l_quantity / (l_quantity + l_linenumber + 1) AS rate_dep
        FROM lineitem
        LEFT JOIN supplier ON l_suppkey = s_suppkey
        LEFT JOIN nation ON s_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "anchor": "SELECT MAX(date) AS m, MIN(date) AS first FROM fact",
    "recent": """
        SELECT fact.*, m,
               6 - CAST(datediff('month', date, m) AS INTEGER) AS month_no
        FROM fact, anchor WHERE date >= m - INTERVAL 5 MONTH""",
    "func_rates": f"""
        SELECT div, sub_job_family_2, date, month_no, AVG(rate_func) AS uti_rate,
               {strict('SUM', 'total_hour')} AS total_hour_func, SUM(attendance) AS attendance_func,
               {EMP}, AVG(attendance) AS attendance_emp
        FROM recent GROUP BY ALL""",
    "dept_rates": f"""
        SELECT div, deptid, sub_job_family_2, date, month_no, AVG(rate_dep) AS uti_rate,
               {strict('SUM', 'total_hour')} AS total_hour_dept_func, SUM(attendance) AS attendance,
               {EMP}, AVG(attendance) AS attendance_emp
        FROM recent GROUP BY ALL""",
    "profile": f"""
        SELECT * FROM (
            SELECT project_code, {MEAN_DAYS},
                   {strict('AVG', 'execute_hour')} AS execute_hour,
                   {strict('AVG', 'execute_month')} AS execute_month,
                   {strict('MAX', 'execute_day')} AS execute_day,
                   COUNT(DISTINCT project_start_stage) AS stage_rows
            FROM fact, anchor WHERE pmcs_bu_start_dt >= first GROUP BY project_code)
        JOIN (SELECT DISTINCT project_code, project_start_stage FROM fact, anchor
              WHERE pmcs_bu_start_dt >= first) USING (project_code)""",
    "known": """
        SELECT DISTINCT project_code AS project_code_old, execute_hour AS old_hour,
               execute_month AS old_month, stage_rows FROM profile""",
    "scenarios": """
        SELECT c_custkey AS scenario_id, r_name AS division,
               'U' || (c_custkey % 100) AS user_id
        FROM customer LEFT JOIN region ON r_regionkey = c_custkey % 5""",
    "plan": """
        SELECT o_custkey AS scenario_id, r_name AS division,
               CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_orderkey % 40 = 0 THEN NULL
                    ELSE 'N' || o_orderkey END AS project_code,
               CASE WHEN o_orderkey % 25 = 24 THEN '' ELSE 'NP' || (o_orderkey % 4) END
                   AS project_name,
               CASE WHEN o_orderkey % 55 = 3 THEN NULL
                    WHEN o_orderkey % 5 = 0 THEN 'P30'
                    WHEN o_orderkey % 90 = 1
                        THEN 'P' || ((2 * o_orderkey) // 15 // 24 * 24 + (2 * o_orderkey) // 15 % 6)
                    WHEN o_orderkey % 130 = 2 THEN 'PX' || o_orderkey
                    ELSE 'P' || ((2 * o_orderkey) // 15 // 24 * 24 + 6
                                 + (2 * o_orderkey) // 15 % 18) END AS project_code_old,
               CASE WHEN o_orderkey % 15 = 0 THEN 0 WHEN o_orderkey % 15 IN (7, 8) THEN NULL
                    ELSE floor(o_totalprice / 100) END AS execute_hour,
               CAST(CASE WHEN o_orderkey % 31 = 0 THEN 0 WHEN o_orderkey % 31 = 5 THEN NULL
                    ELSE 1 + o_orderkey % 36 END AS DOUBLE) AS execute_month,
               CASE WHEN o_orderkey % 77 <> 5
                    THEN DATE '2001-08-15' + CAST(o_orderkey % 120 AS INTEGER) END AS start_date
        FROM orders LEFT JOIN region ON r_regionkey = o_custkey % 5""",
    "clean": """
        SELECT * FROM plan WHERE project_code IS NOT NULL AND project_code_old IS NOT NULL""",
    "modelled": """
        SELECT DISTINCT scenario_id, division AS div, project_name, project_code_old,
               execute_hour, execute_month, start_date, old_hour, old_month, stage_rows
        FROM clean LEFT JOIN known USING (project_code_old)""",
    "modes": """
        SELECT scenario_id, division, user_id,
               CASE WHEN EXISTS (SELECT 1 FROM modelled b WHERE b.scenario_id = s.scenario_id
                                 AND b.stage_rows IS NULL) THEN 'refused'
                    WHEN EXISTS (SELECT 1 FROM modelled b WHERE b.scenario_id = s.scenario_id)
                        THEN 'projects'
                    ELSE 'headcount' END AS mode
        FROM scenarios s""",
    "ratio": """
        SELECT *, CASE WHEN execute_hour IS NULL OR execute_hour = 0 THEN 1.0
                       ELSE execute_hour / NULLIF(old_hour, 0) END AS hr_ratio,
               CASE WHEN execute_month IS NULL OR execute_month = 0 THEN 1.0
                    ELSE execute_month / NULLIF(old_month, 0) END AS mon_ratio
        FROM modelled WHERE stage_rows IS NOT NULL""",
    "opening": f"""
        SELECT project_code, sub_job_family_2, total_hour_pro_func, CAST(n AS INTEGER) AS n
        FROM (
            SELECT *, row_number() OVER (PARTITION BY project_code, sub_job_family_2
                                         ORDER BY date) AS n
            FROM (SELECT project_code, sub_job_family_2, date,
                         {strict('SUM', 'total_hour')} AS total_hour_pro_func
                  FROM fact GROUP BY ALL))
        WHERE n <= 3""",
    "hours": """
        SELECT ratio.*, sub_job_family_2, total_hour_pro_func,
               CAST(m - to_months(CAST(3 - n AS INTEGER)) AS DATE) AS date,
               total_hour_pro_func * hr_ratio / NULLIF(mon_ratio, 0) AS add_hour
        FROM ratio JOIN opening ON project_code_old = opening.project_code, anchor""",
    "prorated": """
        SELECT *, add_hour * start_mth_pct AS add_hour_adj FROM (
            SELECT *, CASE WHEN start_date IS NULL THEN NULL
                           WHEN date >= start_date THEN 1.0
                           WHEN date = date_trunc('month', start_date)
                               THEN 1 - day(start_date) / CAST(day(last_day(start_date)) AS DOUBLE)
                           ELSE 0.0 END AS start_mth_pct
            FROM hours)""",
    "month_hours": """
        SELECT scenario_id, project_name, sub_job_family_2, date,
               COALESCE(SUM(add_hour_adj * stage_rows), 0) AS add_hour_adj
        FROM prorated GROUP BY ALL""",
    "passes": """
        SELECT scenario_id, project_name, MAX(stage_rows) AS passes FROM ratio GROUP BY ALL""",
    "hc_raw": f"""
        SELECT o_custkey AS scenario_id, r_name AS div,
               CASE WHEN o_orderkey % 33 = 4 THEN NULL WHEN o_orderkey % 10 = 9 THEN 0.0
                    ELSE CAST(1 + o_orderkey % 3 AS DOUBLE) END AS HC,
               CASE WHEN o_orderkey % 29 = 0 THEN 'NATION_X'
                    ELSE 'NATION_' || (r_regionkey + 5 * (o_orderkey % 5)) END AS deptid,
               'N' || (o_orderkey % 3) AS project_code,
               CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE 'NP' || (o_orderkey % 5) END
                   AS project_name,
               {PLAN_CODE} AS sub_job_family, {mapped(PLAN_CODE)} AS sub_job_family_2
        FROM orders LEFT JOIN region ON r_regionkey
             = (o_custkey % 5 + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) % 5""",
    "hc": f"""
        SELECT scenario_id, div, deptid, project_code, project_name, sub_job_family_2,
               {strict('SUM', 'HC')} AS hc
        FROM hc_raw GROUP BY ALL""",
    # History: mean over the functions of a department, the rate itself for a function.
    "past": f"""
        SELECT div, 'SUB' AS type, sub_job_family_2 AS title, month_no,
               {r('uti_rate')} AS rate FROM func_rates
        UNION ALL
        SELECT div, 'DEP', deptid, month_no, {r('AVG(uti_rate)')} FROM dept_rates
        GROUP BY div, deptid, month_no""",
    "history": """
        SELECT div AS Div, type AS Type, title AS Title,
               COALESCE(MAX(rate) FILTER (WHERE month_no = 1), 0) AS b_1,
               COALESCE(MAX(rate) FILTER (WHERE month_no = 2), 0) AS b_2,
               COALESCE(MAX(rate) FILTER (WHERE month_no = 3), 0) AS b_3
        FROM past GROUP BY ALL""",
    # Head count only, long: one row per scenario, unit and outlook month.
    "hc_future": f"""
        SELECT scenario_id, div, 'SUB' AS type, sub_job_family_2 AS title, month_no,
               {r('total_hour_func / NULLIF(attendance_func + attendance_emp * COALESCE(hc, 0), 0)')}
                   AS rate
        FROM scenarios JOIN func_rates ON div = division
        LEFT JOIN (SELECT scenario_id, div, sub_job_family_2, {strict('SUM', 'hc')} AS hc
                   FROM hc GROUP BY ALL) USING (scenario_id, div, sub_job_family_2)
        WHERE month_no >= 4
        UNION ALL
        SELECT scenario_id, div, 'DEP', deptid, month_no, {r(strict('AVG', 'x'))} FROM (
            SELECT scenario_id, div, deptid, month_no,
                   total_hour_dept_func / NULLIF((emp_cnt + COALESCE(hc, 0)) * attendance_emp, 0)
                       AS x
            FROM scenarios JOIN dept_rates ON div = division
            LEFT JOIN (SELECT scenario_id, div, deptid, {strict('SUM', 'hc')} AS hc
                       FROM hc GROUP BY ALL) USING (scenario_id, div, deptid)
            WHERE month_no >= 4)
        GROUP BY scenario_id, div, deptid, month_no""",
    "hc_added": f"""
        SELECT scenario_id, div, 'SUB' AS type, sub_job_family_2 AS title,
               {strict('SUM', 'hc')} AS hc
        FROM hc GROUP BY scenario_id, div, sub_job_family_2
        UNION ALL
        SELECT scenario_id, div, 'DEP', deptid, {strict('SUM', 'hc')}
        FROM hc GROUP BY scenario_id, div, deptid""",
    # Detailed allocation: every project of every scenario against every unit and month.
    "staff_func": """
        SELECT scenario_id, project_name, div, sub_job_family_2, SUM(COALESCE(hc, 0)) AS hc
        FROM hc GROUP BY ALL""",
    "staff_dept": """
        SELECT scenario_id, project_name, div, deptid, sub_job_family_2,
               SUM(COALESCE(hc, 0)) AS hc
        FROM hc GROUP BY ALL""",
    "alloc_func": """
        SELECT *, add_hour_adj * emp_pct AS add_hour_pct,
               attendance_emp * hc * passes AS add_attendance_emp FROM (
            SELECT *, emp / NULLIF(SUM(emp) OVER (PARTITION BY scenario_id, project_name, div,
                                                  sub_job_family_2, date), 0) AS emp_pct
            FROM (SELECT scenario_id, project_name, passes, func_rates.*,
                         COALESCE(hc, 0) AS hc, emp_cnt + COALESCE(hc, 0) AS emp, add_hour_adj
                  FROM passes JOIN modes USING (scenario_id)
                  JOIN func_rates ON func_rates.div = division
                  LEFT JOIN staff_func USING (scenario_id, project_name, div, sub_job_family_2)
                  LEFT JOIN month_hours USING (scenario_id, project_name, sub_job_family_2, date)
                  WHERE mode = 'projects'))""",
    "alloc_dept": """
        SELECT *, add_hour_adj * emp_pct AS add_hour_pct,
               attendance_emp * hc * passes AS add_attendance_emp FROM (
            SELECT *, emp / NULLIF(SUM(emp) OVER (PARTITION BY scenario_id, project_name, div,
                                                  sub_job_family_2, date), 0) AS emp_pct
            FROM (SELECT scenario_id, project_name, passes, dept_rates.*,
                         COALESCE(hc, 0) AS hc, emp_cnt + COALESCE(hc, 0) AS emp, add_hour_adj
                  FROM passes JOIN modes USING (scenario_id)
                  JOIN dept_rates ON dept_rates.div = division
                  LEFT JOIN staff_dept
                      USING (scenario_id, project_name, div, deptid, sub_job_family_2)
                  LEFT JOIN month_hours USING (scenario_id, project_name, sub_job_family_2, date)
                  WHERE mode = 'projects'))""",
    "prj_future": f"""
        SELECT scenario_id, div, 'SUB' AS type, sub_job_family_2 AS title, month_no,
               SUM(hc * passes) AS hc,
               {FUNCTION_RATE}
                   AS rate
        FROM alloc_func WHERE month_no >= 4
        GROUP BY scenario_id, div, sub_job_family_2, month_no
        UNION ALL
        SELECT scenario_id, div, 'DEP', deptid, month_no, SUM(hc * passes),
               {DEPARTMENT_RATE}
        FROM alloc_dept WHERE month_no >= 4
        GROUP BY scenario_id, div, deptid, month_no""",
    "prj_future_additive": f"""
        SELECT * FROM prj_future WHERE type = 'SUB'
        UNION ALL
        SELECT a.scenario_id, a.div, 'DEP', a.deptid, a.month_no, hc,
               {r('(total_hour + add_hour) / NULLIF(attendance_emp * emp_cnt + add_attendance, 0)')}
        FROM (SELECT scenario_id, div, deptid, month_no, SUM(hc * passes) AS hc,
                     COALESCE(SUM(add_hour_pct), 0) AS add_hour,
                     COALESCE(SUM(add_attendance_emp), 0) AS add_attendance
              FROM alloc_dept WHERE month_no >= 4 GROUP BY ALL) a
        JOIN (SELECT div, deptid, month_no,
                     {strict('SUM', 'total_hour_dept_func')} AS total_hour,
                     SUM(attendance_emp) AS attendance_emp, SUM(emp_cnt) AS emp_cnt
              FROM dept_rates GROUP BY ALL) b USING (div, deptid, month_no)""",
    "entries": f"""
        SELECT project_code, sub_job_family_2, date, project_start_stage AS start_stage, stage,
               pmcs_bu_start_dt, {", ".join(f"AVG(C{i}_day) AS C{i}_day" for i in range(7))},
               COUNT(*) AS cnt, SUM(total_hour) AS sum_hour,
               {r("SUM(total_hour) / COUNT(*)", 1)} AS hour_per_cnt
        FROM fact WHERE sub_job_family_2 = 'RH' AND date < DATE '2001-07-01'
          AND project_code IN (SELECT 'P' || p_partkey FROM part)
        GROUP BY ALL""",
    "life": """
        SELECT *, row_number() OVER (PARTITION BY project_code, sub_job_family_2
                                     ORDER BY date, start_stage, stage, pmcs_bu_start_dt) AS n
        FROM entries""",
    "life_wide": f"""
        SELECT project_code, sub_job_family_2, MAX(start_stage) FILTER (WHERE n = 1) AS start_stage,
               MAX(pmcs_bu_start_dt) FILTER (WHERE n = 1) AS pmcs_bu_start_dt,
               MIN(date) AS date_fst, MAX(date) AS date_lst,
               {", ".join(f'MAX(hour_per_cnt) FILTER (WHERE n = {i}) AS "{i}"' for i in range(1, 51))}
        FROM life GROUP BY ALL""",
}


def _life_statistic(name: str, make) -> str:
    columns = ", ".join(f'{make(i)} AS "{i}"' for i in range(1, 51))
    return f"SELECT '{name}' AS statistic, {columns} FROM life_wide"


def _between(low: int | None, high: int):
    def count(i: int) -> str:
        above = f'"{i}" > {low} AND ' if low is not None else ""
        return f'CAST(COUNT(*) FILTER (WHERE {above}"{i}" < {high}) AS DOUBLE)'
    return count


STEPS["life_stats"] = " UNION ALL ".join([
    _life_statistic("max", lambda i: f'MAX("{i}")'),
    _life_statistic("min", lambda i: f'MIN("{i}")'),
    _life_statistic("mean", lambda i: r(f'AVG(COALESCE("{i}", 0))', 1)),
    _life_statistic("__50", _between(None, 50)),
    _life_statistic("__100", _between(50, 100)),
    _life_statistic("__200", _between(100, 200)),
    _life_statistic("__300", _between(200, 300)),
])


# The project list as scenarios: other inputs for the same steps.
LIST_INPUTS: dict[str, str] = {
    "scenarios": """
        SELECT p_partkey AS scenario_id, r_name AS division, '001' AS user_id
        FROM part LEFT JOIN region ON r_regionkey = p_partkey % 5
        WHERE p_partkey % 20 NOT IN (0, 7)""",
    "plan": """
        SELECT scenario_id, division, '0' AS project_code, 'new project' AS project_name,
               'P' || scenario_id AS project_code_old, p_retailprice AS execute_hour,
               CAST(p_size AS DOUBLE) AS execute_month, DATE '2001-10-10' AS start_date
        FROM scenarios JOIN part ON p_partkey = scenario_id""",
    "hc_raw": f"SELECT * FROM ({STEPS['hc_raw']}) WHERE FALSE",
}


def _needed(text: str, steps: dict[str, str]) -> list[str]:
    """Steps that a query mentions, with the steps those mention."""
    found: set[str] = set()
    waiting = [text]
    while waiting:
        words = set(re.findall(r"\w+", waiting.pop()))
        for name in steps:
            if name in words and name not in found:
                found.add(name)
                waiting.append(steps[name])
    return [name for name in steps if name in found]


def query(text: str, inputs: dict[str, str] | None = None) -> str:
    steps = STEPS | (inputs or {})
    names = _needed(text, steps)
    if not names:
        return text.strip()
    listed = ",\n".join(f"{name} AS ({steps[name]})" for name in names)
    return f"WITH {listed}\n{text.strip()}"


def _report(future: str, hc: str, where: str, mode: str | None = None) -> str:
    """Units of the division, their history, head count and outlook."""
    restricted = f"AND mode = '{mode}'" if mode else ""
    return f"""
        SELECT s.scenario_id, h.Div, h.Type, h.Title, b_1, b_2, b_3,
               COALESCE({hc}, 0) AS hc,
               COALESCE(MAX(f.rate) FILTER (WHERE f.month_no = 4), 0) AS a_1,
               COALESCE(MAX(f.rate) FILTER (WHERE f.month_no = 5), 0) AS a_2,
               COALESCE(MAX(f.rate) FILTER (WHERE f.month_no = 6), 0) AS a_3
        FROM modes s JOIN history h ON h.Div = s.division
        LEFT JOIN hc_added c ON c.scenario_id = s.scenario_id AND c.div = h.Div
             AND c.type = h.Type AND c.title = h.Title
        LEFT JOIN {future} f ON f.scenario_id = s.scenario_id AND f.div = h.Div
             AND f.type = h.Type AND f.title = h.Title
        WHERE {where} {restricted}
        GROUP BY s.scenario_id, h.Div, h.Type, h.Title, b_1, b_2, b_3"""


def _hc_report(where: str, mode: str | None = None) -> str:
    return _report("hc_future", "MAX(c.hc)", where, mode)


def _project_report(where: str, future: str = "prj_future") -> str:
    return _report(future, "MAX(f.hc)", where, "projects")


_HOUR_KEYS = (
    "scenario_id, project_name, project_code_old, sub_job_family_2, date, start_date, "
    "execute_hour, execute_month"
)
_PLAN = """scenario_id, division, project_code, project_name, project_code_old,
           execute_hour, execute_month, start_date"""
_RATES = f"{r('uti_rate', 4)} AS uti_rate, emp_cnt, {r('attendance_emp', 4)} AS attendance_emp"
_ADDED = (
    f"hc, emp, {r('emp_pct', 4)} AS emp_pct, {r('add_hour_pct')} AS add_hour_pct, "
    f"{r('add_attendance_emp')} AS add_attendance_emp"
)
_LOAD = f"""
    SELECT project_code, project_name, execute_hour, execute_month, per_month AS
           execute_hour_per_month, {r('per_month / 20')} AS execute_hour_per_day_20,
           {r('per_month / 30')} AS execute_hour_per_day_30
    FROM (SELECT *, {r('execute_hour / NULLIF(execute_month, 0)')} AS per_month FROM (
        SELECT 'N' || o_orderkey AS project_code, 'NP' || (o_orderkey % 4) AS project_name,
               CASE WHEN o_orderkey % 15 <> 8 THEN floor(o_totalprice / 100) END AS execute_hour,
               CAST(o_orderkey % 36 AS DOUBLE) AS execute_month,
               lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS user_id
        FROM orders))"""

_QUERIES: dict[str, str] = {
    "function_rates": f"""
        SELECT div, sub_job_family_2, date, total_hour_func, attendance_func, {_RATES}
        FROM func_rates""",
    "department_rates": f"""
        SELECT div, deptid, sub_job_family_2, date, total_hour_dept_func, {_RATES}
        FROM dept_rates""",
    "unit_rates": f"""
        SELECT div, NULL AS deptid, sub_job_family_2, date, 'SUB' AS type, month_no,
               total_hour_func AS total_hour, attendance_func AS attendance, {_RATES}
        FROM func_rates
        UNION ALL
        SELECT div, deptid, sub_job_family_2, date, 'DEP', month_no,
               total_hour_dept_func, attendance, {_RATES}
        FROM dept_rates""",
    "project_profile": "SELECT * FROM profile",
    "headcount_plan": "SELECT * FROM hc",
    "active_titles": """
        SELECT scenario_id, string_agg(DISTINCT deptid, ',' ORDER BY deptid) AS DEP,
               string_agg(DISTINCT sub_job_family, ',' ORDER BY sub_job_family) AS SUB
        FROM hc_raw WHERE HC > 0 GROUP BY scenario_id""",
    "history_report": "SELECT * FROM history",
    "history_report_function": "SELECT * FROM history WHERE Type = 'SUB'",
    "history_report_department": "SELECT * FROM history WHERE Type = 'DEP'",
    "hc_what_if_function": _hc_report("h.Type = 'SUB'"),
    "hc_what_if_department": _hc_report("h.Type = 'DEP'"),
    "rate_report": _hc_report("TRUE"),
    "plan_clean": f"SELECT {_PLAN} FROM clean",
    "plan_rejects": """
        SELECT DISTINCT scenario_id, project_code_old, 'Invalid project code!!' AS error_msg
        FROM modelled WHERE stage_rows IS NULL""",
    "scenario_modes": "SELECT * FROM modes",
    "reject_log": """
        SELECT '{"scenario_id":' || scenario_id || ',"project_name":"' || project_name
               || '","project_code_old":"' || project_code_old || '"}' AS user_input,
               'Invalid project code!!' AS error_msg, '2022-03-04 10:20' AS save_time, user_id
        FROM modelled JOIN scenarios USING (scenario_id) WHERE stage_rows IS NULL""",
    "project_ratio": f"""
        SELECT * REPLACE ({r('hr_ratio', 4)} AS hr_ratio, {r('mon_ratio', 4)} AS mon_ratio)
        FROM ratio""",
    "opening_hours": "SELECT * FROM opening",
    "project_hours": f"""
        SELECT {_HOUR_KEYS}, total_hour_pro_func, {r('add_hour')} AS add_hour FROM hours""",
    "start_proration": f"""
        SELECT {_HOUR_KEYS}, {r('start_mth_pct', 4)} AS start_mth_pct,
               {r('add_hour_adj')} AS add_hour_adj FROM prorated""",
    "tidy_result": f"SELECT {_HOUR_KEYS}, {r('add_hour', 1)} AS add_hour FROM hours",
    "allocation_function": f"""
        SELECT scenario_id, project_name, div, sub_job_family_2, date, {_ADDED}
        FROM alloc_func""",
    "allocation_department": f"""
        SELECT scenario_id, project_name, div, deptid, sub_job_family_2, date, {_ADDED}
        FROM alloc_dept""",
    "allocation_share": f"""
        SELECT scenario_id, project_name, div, sub_job_family_2, date,
               {r('SUM(emp_pct)', 4)} AS share, COUNT(*) AS departments
        FROM alloc_dept GROUP BY ALL""",
    "project_what_if_function": _project_report("h.Type = 'SUB'"),
    "project_what_if_department": _project_report("h.Type = 'DEP'"),
    "scenario_batch": _hc_report("TRUE", "headcount") + " UNION ALL " + _project_report("TRUE"),
    "scenario_batch_additive": (
        _hc_report("TRUE", "headcount") + " UNION ALL "
        + _project_report("TRUE", "prj_future_additive")
    ),
    "project_month_profile": """
        SELECT *, CAST(row_number() OVER (
                   PARTITION BY project_code
                   ORDER BY sub_job_family_2, date, start_stage, stage, pmcs_bu_start_dt
               ) AS INTEGER) AS "No"
        FROM entries""",
    "life_pivot": "SELECT * FROM life_wide",
    "life_statistics": "SELECT * FROM life_stats",
    "life_sheet": "SELECT * FROM life_wide UNION ALL BY NAME SELECT * FROM life_stats",
    "project_load": _LOAD,
    "project_load_user": f"{_LOAD} WHERE user_id = '000'",
    "project_list": """
        SELECT 'P' || p_partkey AS project_code,
               CASE WHEN p_partkey % 20 = 0 THEN '' ELSE p_name END AS project_name,
               CASE WHEN p_partkey % 20 NOT IN (0, 7) THEN p_retailprice END AS execute_hour,
               CAST(CASE WHEN p_partkey % 20 = 7 THEN 3 WHEN p_partkey % 20 <> 0 THEN p_size END
                    AS DOUBLE) AS execute_month,
               p_partkey % 20 NOT IN (0, 7) AS is_valid
        FROM part""",
    "life_months": """
        SELECT project_code, sub_job_family_2, CAST(n AS INTEGER) AS ordinal, date, hour_per_cnt
        FROM life""",
    "tidy_allocation": f"""
        SELECT scenario_id, project_name, div, deptid, sub_job_family_2, date,
               {r('add_hour_pct', 1)} AS add_hour_pct,
               {r('total_hour_dept_func', 1)} AS total_hour_dept_func
        FROM alloc_dept""",
    "tidy_department_outlook": f"""
        SELECT scenario_id, div, deptid, date,
               {r('COALESCE(SUM(add_hour_pct), 0)', 1)} AS add_hour_pct,
               {r('COALESCE(SUM(total_hour_dept_func), 0)', 1)} AS total_hour_dept_func
        FROM alloc_dept GROUP BY ALL""",
    "list_rejects": """
        SELECT CASE WHEN p_partkey % 20 = 0 THEN 'P' || p_partkey || ','
                    ELSE 'P' || p_partkey || ',' || p_name || ',many,3' END AS user_input,
               'Not a complete project line' AS error_msg, '2022-03-04 10:20' AS save_time,
               '001' AS user_id
        FROM part WHERE p_partkey % 20 IN (0, 7)""",
    "unknown_titles": """
        SELECT '{"scenario_id":' || scenario_id || ',"kind":"' || kind || '","title":"' || title
               || '"}' AS user_input,
               'Not a known unit' AS error_msg, '2022-03-04 10:20' AS save_time, user_id
        FROM (
            SELECT DISTINCT scenario_id, 'DEP' AS kind, deptid AS title FROM hc_raw
            WHERE HC > 0 AND deptid NOT IN (SELECT deptid FROM recent WHERE deptid IS NOT NULL)
            UNION ALL
            SELECT DISTINCT scenario_id, 'SUB', sub_job_family FROM hc_raw
            WHERE HC > 0 AND sub_job_family NOT IN (SELECT sub_job_family FROM recent))
        JOIN scenarios USING (scenario_id)""",
    "headcount_file": """
        SELECT div, deptid, project_code, project_name, sub_job_family, COUNT(*) AS rows,
               COALESCE(SUM(HC), 0) AS hc
        FROM hc_raw GROUP BY ALL""",
    "purge_user": """
        SELECT * FROM events
        WHERE user_id <> 8 OR user_id IS NULL""",
}
# The same rates, whatever way they are kept.
_QUERIES["unit_rates_by_load"] = _QUERIES["unit_rates"]
_QUERIES["project_list_file"] = _QUERIES["project_list"]

_PERCENT = ", ".join(
    f"'{c}': {r(f'{c} * 100', 1)}" if c != "hc" else "'hc': hc"
    for c in ("b_1", "b_2", "b_3", "hc", "a_1", "a_2", "a_3")
)
_QUERIES["report_records"] = f"""
    SELECT CAST(to_json({{'scenario_id': scenario_id, 'Div': Div, 'Type': Type,
                          'Title': Title, {_PERCENT}}}) AS VARCHAR) AS record
    FROM ({_hc_report("TRUE")})"""

ORACLE: dict[str, str] = {name: query(text) for name, text in _QUERIES.items()}
ORACLE["project_list_batch"] = query(_project_report("TRUE"), LIST_INPUTS)

# Requests as JSON text, one per order, as inputs for the same steps.
_REQUEST_REGION = "orders LEFT JOIN region ON r_regionkey = o_custkey % 5"
_REQUEST_PROJECT = """', "data_Prj": [{"project_code": "N' || o_orderkey
    || '", "project_name": "NP", "project_code_old": "'
    || CASE WHEN o_orderkey % 40 = 0 THEN 'PX' ELSE 'P' || (6 + o_orderkey % 18) END
    || '", "execute_hour": 500, "execute_month": "", "start_date": "2001/9/15"}]'"""
_REQUEST_STAFF = """', "data_HC": [{"HC": ' || (o_orderkey % 3) || ', "div": "' || r_name
    || '", "deptid": "NATION_' || (r_regionkey + 5 * (o_orderkey % 5))
    || '", "project_code": "", "project_name": "NP", "sub_job_family": "HW"}]'"""
_REQUEST_TEXT = f"""'{{"division": "' || r_name || '", "user": "R' || o_orderkey || '"'
    || CASE WHEN o_orderkey % 3 = 0 THEN {_REQUEST_PROJECT} ELSE '' END
    || CASE WHEN o_orderkey % 4 = 0 THEN {_REQUEST_STAFF} ELSE '' END || '}}'"""
REQUEST_INPUTS: dict[str, str] = {
    "scenarios": f"""
        SELECT o_orderkey AS scenario_id, r_name AS division, 'R' || o_orderkey AS user_id
        FROM {_REQUEST_REGION} WHERE o_orderkey % 50 NOT IN (1, 2, 3)""",
    "plan": """
        SELECT scenario_id, division, 'N' || scenario_id AS project_code, 'NP' AS project_name,
               CASE WHEN scenario_id % 40 = 0 THEN 'PX' ELSE 'P' || (6 + scenario_id % 18) END
                   AS project_code_old,
               500.0 AS execute_hour, CAST(NULL AS DOUBLE) AS execute_month,
               DATE '2001-09-15' AS start_date
        FROM scenarios WHERE scenario_id % 3 = 0""",
    "hc_raw": """
        SELECT scenario_id, division AS div, CAST(scenario_id % 3 AS DOUBLE) AS HC,
               'NATION_' || (r_regionkey + 5 * (scenario_id % 5)) AS deptid, '' AS project_code,
               'NP' AS project_name, 'HW' AS sub_job_family, 'RH' AS sub_job_family_2
        FROM scenarios JOIN region ON r_name = division WHERE scenario_id % 4 = 0""",
}
_ANSWERS = f"{_hc_report('TRUE', 'headcount')} UNION ALL {_project_report('TRUE')}"
ORACLE["request_batch"] = query(f"""
    SELECT user_id, a.* EXCLUDE (scenario_id)
    FROM ({_ANSWERS}) a JOIN scenarios USING (scenario_id)""", REQUEST_INPUTS)
ORACLE["request_rejects"] = query(f"""
    SELECT CASE o_orderkey % 50 WHEN 1 THEN '{{"division": "' || r_name || '", '
                WHEN 2 THEN '{{"user": "R' || o_orderkey || '"}}'
                ELSE '{{"division": "' || r_name || '"}}' END AS user_input,
           CASE o_orderkey % 50 WHEN 1 THEN 'Not a JSON request' WHEN 2 THEN 'No division'
                ELSE 'No user' END AS error_msg,
           '2022-03-04 10:20' AS save_time,
           CASE WHEN o_orderkey % 50 = 2 THEN 'R' || o_orderkey END AS user_id
    FROM {_REQUEST_REGION} WHERE o_orderkey % 50 IN (1, 2, 3)
    UNION ALL
    SELECT {_REQUEST_TEXT}, 'Invalid project code!!', '2022-03-04 10:20', 'R' || o_orderkey
    FROM {_REQUEST_REGION}
    WHERE o_orderkey IN (SELECT scenario_id FROM modelled WHERE stage_rows IS NULL)""",
    REQUEST_INPUTS)
