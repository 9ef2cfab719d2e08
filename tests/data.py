"""Small tables built in memory."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import types as T

from staffcast import schemas

MONTHS = [dt.date(2020 + (i + 5) // 12, (i + 5) % 12 + 1, 1) for i in range(14)]  # to 2021-07

DEFAULTS = {
    "date": MONTHS[-1], "div": "D1", "deptid": "A", "emplid": "e1", "sub_job_family": "HW",
    "sub_job_family_2": "RH", "project_code": "P1", "project_start_stage": "C0", "stage": "C1",
    "pmcs_bu_start_dt": MONTHS[0], **{c: 10.0 for c in schemas.STAGE_DAYS},
    "execute_hour": 1000.0, "execute_month": 10.0, "execute_day": 300.0, "total_hour": 80.0,
    "attendance": 160.0, "termination_n": 0, "utilization_rate_by_div_func": 0.5,
    "utilization_rate_by_dep": 0.5,
}
PROJECT = {
    "scenario_id": 1, "division": "D1", "project_code": "N1", "project_name": "new",
    "project_code_old": "P1", "project_name_old": None, "execute_hour": 0.0,
    "execute_month": 0.0, "start_date": dt.date(2000, 1, 1),
}
HEAD = {
    "scenario_id": 1, "HC": 1.0, "div": "D1", "deptid": "A", "project_code": "",
    "project_name": "new", "sub_job_family": "RH",
}


def _frame(spark, rows, defaults, schema: T.StructType):
    full = [{**defaults, **row} for row in rows]
    return spark.createDataFrame([tuple(r[n] for n in schema.names) for r in full], schema)


def fact(spark, rows):
    return _frame(spark, rows, DEFAULTS, schemas.UTILIZATION)


def _text(row):
    return {
        k: None if v is None else v if k == "scenario_id" else str(v) for k, v in row.items()
    }


def projects(spark, rows):
    return _frame(
        spark, [_text({**PROJECT, **r}) for r in rows], {}, schemas.PLAN_PROJECTS_RAW
    )


def heads(spark, rows):
    return _frame(spark, [_text({**HEAD, **r}) for r in rows], {}, schemas.PLAN_HEADCOUNT_RAW)


def scenarios(spark, rows):
    return spark.createDataFrame([(*r, f"u{r[0]}") for r in rows], schemas.SCENARIOS)


def random_company(seed: int) -> list[dict]:
    rnd = random.Random(seed)
    start = {f"P{i}": rnd.choice([MONTHS[0], MONTHS[3], dt.date(2019, 1, 1)]) for i in range(8)}
    rows = []
    for emp in range(26):
        division = rnd.choice(["D1", "D1", "D2"])
        department = rnd.choice("ABC") if division == "D1" else rnd.choice("XY")
        function = rnd.choice(["RH", "E4", "ME"])
        for month in MONTHS:
            for _ in range(rnd.choice([0, 1, 1, 2])):
                code = f"P{rnd.randrange(8)}"
                hours = rnd.choice([40.0, 80.0, 80.0, 120.0])
                rows.append({
                    **DEFAULTS, "date": month, "div": division, "deptid": department,
                    "emplid": f"e{emp}", "sub_job_family_2": function, "project_code": code,
                    "project_start_stage": rnd.choice(["C0", "C1"]) if code == "P2" else "C0",
                    "pmcs_bu_start_dt": start[code],
                    "execute_hour": 0.0 if code == "P3" else 100.0 * (1 + int(code[1:])),
                    "execute_month": 4.0 + int(code[1:]),
                    "total_hour": None if rnd.random() < 0.004 else hours,
                    "attendance": None if rnd.random() < 0.004 else hours + rnd.choice([0, 40.0]),
                    "termination_n": int(rnd.random() < 0.12),
                    "utilization_rate_by_div_func": None if rnd.random() < 0.01 else hours / 160,
                    "utilization_rate_by_dep": hours / 200,
                })
    return rows


def random_plans(seed: int, count: int):
    """Scenarios, planned projects and head count, with every kind of odd row."""
    rnd = random.Random(seed)
    asked, planned, staffed = [], [], []
    for s in range(1, count + 1):
        division = rnd.choice(["D1", "D1", "D2", "D9"])
        asked.append((s, division))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            planned.append({
                **PROJECT, "scenario_id": s, "division": division,
                "project_code": rnd.choice(["N1", "N2", "N3", "N4", "", None]),
                "project_name": rnd.choice(["new", "next", None]),
                "project_code_old": f"P{rnd.randrange(8)}" if rnd.random() > 0.06
                else rnd.choice(["PX", "", " "]),
                "execute_hour": rnd.choice([0.0, None, 250.0, 900.0]),
                "execute_month": rnd.choice([0.0, None, 3.0, 12.0]),
                "start_date": rnd.choice([
                    None, dt.date(2021, 1, 1), dt.date(2021, 5, 1), dt.date(2021, 5, 20),
                    dt.date(2021, 6, 30), dt.date(2021, 7, 12), dt.date(2021, 9, 3),
                ]),
            })
        for _ in range(rnd.choice([0, 1, 2, 5])):
            staffed.append({
                **HEAD, "scenario_id": s, "HC": rnd.choice([None, 0.0, 1.0, 2.0, 3.0]),
                "div": division if rnd.random() > 0.1 else "D2",
                "deptid": rnd.choice(["A", "B", "C", "X", "Y", "Z"]),
                "project_code": rnd.choice(["", "N1"]),
                "project_name": rnd.choice(["new", "next", "", "other"]),
                "sub_job_family": rnd.choice(["HW", "RX", "RH", "PV", "E4", "ME"]),
            })
    return asked, planned, staffed
