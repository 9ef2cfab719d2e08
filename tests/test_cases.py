"""Small companies in which one rule decides the result, worked out by hand.

The fact ends in 2021-07, so the outlook months are May, June and July 2021.
"""

from __future__ import annotations

import datetime as dt

import data
import pytest
from compare import plan_of
from pyspark.sql import functions as F

from staffcast.functions import calendar
from staffcast.operators import allocation, hours, planning, rates
from staffcast.operators.spread import settle
from staffcast.plans import records, report

MAY, JUNE, JULY = data.MONTHS[-3:]


def one_unit(**change):
    """Department A, function RH, one employee, 80 of 160 hours in each of 14 months."""
    return [{"date": m, "project_code": "OLD", **change} for m in data.MONTHS]


def model(code="P1", months=(0, 1, 2), total=10.0, **change):
    """An old project of another division: its hours count, its unit does not."""
    return [
        {"date": data.MONTHS[i], "div": "D9", "deptid": "Z", "project_code": code,
         "total_hour": total, "execute_hour": 100.0, "execute_month": 10.0, **change}
        for i in months
    ]


def models(fact):
    return planning.project_models(rates.project_profile(fact))


@pytest.mark.parametrize("codes", [None, ["P1", "P2", "PX"]])
def test_history_equals_profile_and_opening_hours(spark, codes):
    rows = data.random_company(1)
    rows += [{**rows[0], "sub_job_family_2": None}, {**rows[1], "pmcs_bu_start_dt": None}, {**rows[2], "execute_hour": None}]
    rows += [{**rows[3], "project_code": None}, {**rows[4], "project_start_stage": None}]
    fact = data.fact(spark, rows)
    history = report.prepare_history(fact, codes=codes)
    wanted = F.lit(True) if codes is None else F.col("project_code").isin(codes)
    efforts = models(fact).where(wanted).select(history.models.columns)
    assert sorted(map(str, history.models.collect())) == sorted(map(str, efforts.collect()))
    opening = hours.opening_hours(fact).where(wanted)
    found = hours.opening_rows(history.opening).select(opening.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, opening.collect()))


def score(spark, fact, plans, heads=(), asked=((1, "D1"),), **options):
    result = report.score_scenarios(
        data.fact(spark, fact), data.scenarios(spark, list(asked)),
        data.projects(spark, list(plans)), data.heads(spark, list(heads)), **options,
    )
    return {
        (r["scenario_id"], r["Type"], r["Title"]): tuple(r[4:]) for r in result.collect()
    }


def test_project_cases(spark):
    """Many scenarios in one batch, each with one plan."""
    fact = (
        one_unit() + model() + model("GAP", (0, 4, 7, 9)) + model("TWO", (0, 5))
        + model("STAGES", project_start_stage="C0") + model("STAGES", project_start_stage="C1")
        + model("FREE", execute_hour=0.0)
        + model("EARLY", pmcs_bu_start_dt=dt.date(2020, 5, 31))
    )
    plans = {
        1: [{}],
        2: [{"execute_hour": 300.0}],
        3: [{"execute_hour": 300.0, "execute_month": 20.0}],
        4: [{"execute_hour": None, "execute_month": None}],
        5: [{"project_code_old": "GAP"}],
        6: [{"project_code_old": "TWO"}],
        7: [{"project_code_old": "STAGES"}],
        8: [{"project_code_old": "FREE", "execute_hour": 50.0}],
        9: [{"project_code_old": "EARLY"}],
        10: [{"project_code_old": "NONE"}],
        11: [{"project_code": " "}, {"project_code_old": ""}],
        12: [{"start_date": JUNE}],
        13: [{"start_date": dt.date(2021, 6, 15)}],
        14: [{"start_date": dt.date(2021, 6, 30)}],
        15: [{"start_date": dt.date(2021, 8, 1)}],
        16: [{"start_date": None}],
        17: [{"project_name": "a", "execute_hour": 300.0}, {"project_name": "b"}],
        18: [{}, {"project_code_old": "GAP"}],
        19: [{}, {}],
        20: [{}, {"project_code_old": "NONE"}],
    }
    plain = 0.5
    expected = {  # added hours by month; each month of the unit has 80 of 160 hours
        1: (10, 10, 10), 2: (30, 30, 30), 3: (15, 15, 15), 4: (10, 10, 10), 5: (10, 10, 10),
        6: (10, 10, 0), 7: (40, 40, 40), 8: (0, 0, 0), 11: (0, 0, 0), 12: (0, 10, 10),
        13: (0, 5, 10), 14: (0, 0, 10), 15: (0, 0, 0), 16: (0, 0, 0), 17: (40, 40, 40),
        18: (20, 20, 20), 19: (10, 10, 10),
    }
    rows = score(
        spark, fact,
        [{"scenario_id": s, **p} for s, many in plans.items() for p in many],
        asked=[(s, "D1") for s in plans],
    )
    assert {s for s, _, _ in rows} == set(expected)
    for s, hours_added in expected.items():
        outlook = [
            round((80 + h) / 160 + 1e-9, 2) for h in hours_added
        ]
        assert rows[s, "SUB", "RH"] == (plain, plain, plain, 0.0, *outlook), s
        assert rows[s, "DEP", "A"] == (plain, plain, plain, 0.0, *outlook), s


def test_head_count_cases(spark):
    """Two departments with two functions; head count with and without projects."""
    fact = [
        {"date": m, "project_code": "OLD", "deptid": d, "sub_job_family_2": f,
         "emplid": d + f, "total_hour": h}
        for m in data.MONTHS
        for d, f, h in (("A", "RH", 80.0), ("A", "ME", 40.0), ("B", "RH", 120.0))
    ] + model()
    heads = [
        {"scenario_id": 1, "HC": 1.0},                            # A, RH
        {"scenario_id": 2, "HC": 1.0, "sub_job_family": "HW"},    # the same by another code
        {"scenario_id": 3, "deptid": "Z"},                        # unknown department
        {"scenario_id": 4, "HC": None}, {"scenario_id": 4, "HC": 2.0, "deptid": "B"},
        {"scenario_id": 5, "HC": 1.0, "project_name": ""},        # project mode, no name
        {"scenario_id": 6, "HC": 1.0},                            # project mode, by name
        {"scenario_id": 7, "div": "D2"},
    ]
    rows = score(
        spark, fact, [{"scenario_id": s} for s in (5, 6)], heads,
        asked=[(s, "D1") for s in range(1, 8)],
    )
    a = {key: value[3:] for key, value in rows.items()}
    # Only head count: function 200 / (320 + 160), department mean of 80/320 and 40/320.
    for s in (1, 2):
        assert a[s, "SUB", "RH"] == (1.0, 0.42, 0.42, 0.42)
        assert a[s, "SUB", "ME"] == (0.0, 0.25, 0.25, 0.25)
        assert a[s, "DEP", "A"] == (1.0, 0.19, 0.19, 0.19)
        assert a[s, "DEP", "B"] == (0.0, 0.75, 0.75, 0.75)
    # An unknown department counts for the function and has no row of its own.
    assert a[3, "SUB", "RH"][0] == 1.0 and a[3, "DEP", "A"] == (0.0, 0.38, 0.38, 0.38)
    assert (3, "DEP", "Z") not in a
    # A missing number makes the sum of the function missing, which is shown as zero.
    assert a[4, "SUB", "RH"] == (0.0, 0.63, 0.63, 0.63)
    assert a[4, "DEP", "B"] == (2.0, 0.25, 0.25, 0.25)
    # Project: 10 hours more for RH, half of them in each department.
    assert a[5, "SUB", "RH"] == (0.0, 0.66, 0.66, 0.66)
    assert a[5, "DEP", "B"] == (0.0, 0.78, 0.78, 0.78)
    # With one more head in A two thirds of the hours go there: 80+40+6.67 over the
    # distinct sums 160 x 1 plus 160 more; in B 123.33 of 160.
    assert a[6, "SUB", "RH"] == (1.0, 0.44, 0.44, 0.44)
    assert a[6, "DEP", "A"] == (1.0, 0.4, 0.4, 0.4)
    assert a[6, "DEP", "B"] == (0.0, 0.77, 0.77, 0.77)
    # Head count of another division changes nothing.
    assert a[7, "SUB", "RH"] == (0.0, 0.63, 0.63, 0.63)


def test_equal_values_of_functions_count_once_unless_additive(spark):
    fact = [
        {"date": m, "project_code": "OLD", "sub_job_family_2": f, "emplid": f}
        for m in data.MONTHS for f in ("RH", "ME")
    ] + model()
    once = score(spark, fact, [{}])[1, "DEP", "A"]
    twice = score(spark, fact, [{}], additive=True)[1, "DEP", "A"]
    assert once[4:] == (0.56, 0.56, 0.56)     # (80 + 10) / (160 x 1)
    assert twice[4:] == (0.27, 0.27, 0.27)    # (160 + 10) / (320 x 2)


def test_missing_values_and_months(spark):
    fact = [r for r in one_unit() if r["date"] not in (MAY, data.MONTHS[-5])]
    fact += [{"date": JUNE, "project_code": "OLD", "emplid": "e2", "attendance": None}]
    fact += [{"date": data.MONTHS[-4], "project_code": "OLD", "emplid": "e2",
              "utilization_rate_by_div_func": None, "utilization_rate_by_dep": None}]
    rows = score(spark, fact, [])
    expected = (0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5)
    assert rows[1, "SUB", "RH"] == expected and rows[1, "DEP", "A"] == expected


def test_zero_employees_get_no_hours(spark):
    fact = [{**r, "termination_n": 1} for r in one_unit()] + model()
    rows = score(spark, fact, [{}])
    assert rows[1, "SUB", "RH"][4:] == (0.5, 0.5, 0.5)
    assert rows[1, "DEP", "A"][4:] == (0.0, 0.0, 0.0)


def test_scenarios_do_not_influence_each_other(spark):
    fact = data.random_company(7)
    asked, planned, staffed = data.random_plans(7, 12)
    together = score(spark, fact, planned, staffed, asked)
    for s, division in asked[:3]:
        alone = score(
            spark, fact,
            [p for p in planned if p["scenario_id"] == s],
            [h for h in staffed if h["scenario_id"] == s],
            [(s, division)],
        )
        assert alone == {key: row for key, row in together.items() if key[0] == s}


def test_known_dates_give_the_same_report(spark):
    fact = one_unit() + model()
    known = score(spark, fact, [{}], end=JULY, start=data.MONTHS[0])
    assert known == score(spark, fact, [{}])


def test_history_equals_report_history(spark):
    fact = data.random_company(4)
    rows = score(spark, fact, [])
    history = report.history_report(data.fact(spark, fact)).where("Div = 'D1'").collect()
    assert {(1, r["Type"], r["Title"]): tuple(r[3:]) for r in history} == {
        key: row[:3] for key, row in rows.items()
    }


def shares_of(spark, seed, by_department):
    fact = data.fact(spark, data.random_company(seed))
    asked, planned, staffed = data.random_plans(seed, 30)
    plan = planning.plan_rows(planning.clean_plan(
        planning.typed_projects(data.projects(spark, planned))
    ))
    modelled = planning.plan_with_models(plan, models(fact))
    ratios = planning.project_ratio(modelled)
    end = calendar.last_month(fact)
    opening = hours.opening_sheet(hours.opening_hours(fact))
    added = hours.added_hours(opening, hours.plan_factors(ratios, end))
    units = settle((rates.department_rates if by_department else rates.function_rates)(fact), "units")
    shares = allocation.factors(
        added, end,
        planning.headcount_plan(data.heads(spark, staffed)),
        hours.project_passes(ratios),
        data.scenarios(spark, asked),
        by_department,
    )
    return settle(shares, "shares"), units


def rounded(df):
    columns = sorted(df.columns)
    return sorted(str([round(r[c], 6) + 0.0 if isinstance(r[c], float) else r[c] for c in columns]) for r in df.collect())


@pytest.mark.parametrize("by_department", [True, False])
def test_sums_from_factors_equal_sums_of_the_listing(spark, by_department):
    """Shares add up to one or are missing; no exchange sees the rows by unit."""
    shares, units = shares_of(spark, 5, by_department)
    listed = allocation.listing(shares, units)
    assert "Exchange hashpartitioning" not in plan_of(listed) and "SortMergeJoin" not in plan_of(listed)
    grain = ["scenario_id", "project_name", "div", "sub_job_family_2", "date"]
    sums = listed.groupBy(*grain).agg(F.sum("emp_pct").alias("share"), F.count(F.lit(1)).alias("units"))
    found = allocation.share_sums(shares, units)
    assert rounded(found) == rounded(sums)
    values = [r["share"] for r in found.collect()]
    assert any(v is not None for v in values)
    assert all(v is None or v == pytest.approx(1.0) for v in values)
    if by_department:
        units = units.withColumnRenamed("total_hour_dept_func", "total_hour")
        by_unit = allocation.listing(shares, units).groupBy("scenario_id", "div", "deptid", "date").agg(
            F.expr("coalesce(sum(add_hour_pct), 0D) AS add_hour_pct"),
            F.expr("coalesce(sum(total_hour), 0D) AS total_hour"),
        )
        assert rounded(allocation.department_outlook(shares, units)) == rounded(by_unit)


def test_start_later_never_adds_hours(spark):
    days = [dt.date(2021, 4, 20) + dt.timedelta(days=3 * i) for i in range(40)]
    rows = score(
        spark, one_unit() + model(total=100.0),
        [{"scenario_id": i, "start_date": d} for i, d in enumerate(days)],
        asked=[(i, "D1") for i in range(len(days))],
    )
    outlooks = [rows[i, "SUB", "RH"][4:] for i in range(len(days))]
    for earlier, later in zip(outlooks, outlooks[1:]):
        assert all(a >= b for a, b in zip(earlier, later))


def test_refused_requests_are_logged(spark):
    fact = data.fact(spark, one_unit() + model())
    plan = report.prepare_plan(data.projects(spark, [
        {"scenario_id": 1}, {"scenario_id": 2, "project_code_old": "NONE"},
    ]))
    modelled = planning.plan_with_models(plan, models(fact))
    log = records.refused_requests(modelled, data.scenarios(spark, [(1, "D1"), (2, "D1")]))
    rows = log.collect()
    assert [(r["error_msg"], r["user_id"]) for r in rows] == [("Invalid project code!!", "u2")]
    assert '"project_code_old":"NONE"' in rows[0]["user_input"]
    assert rows[0]["save_time"] is not None


def test_tidy_result(spark):
    hours_table = spark.createDataFrame(
        [(18840, 18844, 12.345)], "date int, start_date int, add_hour double"
    )
    assert tuple(records.tidy_result(hours_table, "project_hours").first()) == (
        dt.date(2021, 8, 1), dt.date(2021, 8, 5), 12.3,
    )
    rate = spark.createDataFrame([("x", 0.5, 0.25)], "Title string, b_1 double, a_1 double")
    assert tuple(records.tidy_result(rate, "report", percent=True).first()) == ("x", 50.0, 25.0)


def test_title_sets_are_bounded_rows(spark):
    """A scenario with very many rows, more titles than a word has bits, unknown and missing titles."""
    known = [f"D{i:03d}" for i in range(150)]
    rows = [{"scenario_id": 1, "deptid": known[i * 7 % 150], "sub_job_family": "HW"} for i in range(400)]
    rows += [
        {"scenario_id": 2, "deptid": "D000"}, {"scenario_id": 2, "deptid": "D149", "HC": 0.0},
        {"scenario_id": 2, "deptid": "nowhere"}, {"scenario_id": 3, "deptid": None, "sub_job_family": None},
        {"scenario_id": 4, "HC": None}, {"scenario_id": 5, "deptid": "D063"}, {"scenario_id": 5, "deptid": "D062"},
    ]
    asked = planning.asked_titles(data.heads(spark, rows))
    units = spark.createDataFrame([("DEP", t) for t in known] + [("SUB", "HW"), ("SUB", "RH"), ("DEP", None)], "kind string, title string")
    numbers = settle(planning.title_numbers(units), "titles")
    sets = planning.active_titles(asked, numbers)
    assert max(len(r["DEP"]) for r in sets.collect()) == 3  # words, whatever the number of rows
    got = {r["scenario_id"]: (r["DEP"], r["SUB"]) for r in planning.titles_of(sets, numbers).collect()}
    assert got == {
        1: (known, ["HW"]), 2: (["D000"], ["RH"]), 3: ([], []), 5: (["D062", "D063"], ["RH"]),
    }
    unknown = {tuple(r) for r in planning.unknown_titles(asked, numbers).collect()}
    assert unknown == {(2, "DEP", "nowhere")}
