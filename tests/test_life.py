"""Life profile, project load, project lists and purging."""

from __future__ import annotations

import datetime as dt

import data
import pytest

from staffcast.operators import life, projects
from staffcast.plans.life import life_report


def codes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "project_code string")


def entries(code, values, **change):
    """One entry of the given hours in each following month."""
    return [
        {"date": data.MONTHS[i], "project_code": code, "total_hour": v, **change}
        for i, v in enumerate(values)
    ]


def test_profile_averages_and_cut_off(spark):
    fact = entries("P1", [10.0, 20.0]) + [
        {"date": data.MONTHS[0], "project_code": "P1", "total_hour": 15.0, "C0_day": 20.0},
        {"date": data.MONTHS[0], "project_code": "P1", "sub_job_family_2": "ME"},
        {"date": dt.date(2021, 7, 1), "project_code": "P1"},
        {"date": data.MONTHS[0], "project_code": "P9"},
    ]
    rows = life.project_month_profile(data.fact(spark, fact), codes(spark, "P1")).collect()
    found = {
        r["No"]: (r["date"], r["cnt"], r["sum_hour"], r["hour_per_cnt"], r["C0_day"])
        for r in rows
    }
    assert found == {
        1: (data.MONTHS[0], 2, 25.0, 12.5, 15.0), 2: (data.MONTHS[1], 1, 20.0, 20.0, 10.0),
    }


def test_a_code_listed_twice_counts_once(spark):
    fact = data.fact(spark, entries("P1", [10.0]) + entries("P2", [5.0]) + entries("P3", [1.0]))
    rows = life.project_month_profile(fact, codes(spark, "P1", "P2", "P2")).collect()
    assert sorted(r["project_code"] for r in rows) == ["P1", "P2"]


def test_pivot_and_statistics(spark):
    ranges = [49.0, 50.0, 50.1, 100.0, 200.0, 300.0]
    fact = entries("P1", ranges) + entries("P2", [60.0, 120.0], project_start_stage="C3")
    made = life_report(data.fact(spark, fact), codes(spark, "P1", "P2"))
    rows = {r["project_code"]: r for r in made.projects.collect()}
    assert [rows["P1"][str(i)] for i in range(1, 8)] == [*ranges, None]
    assert rows["P2"]["start_stage"] == "C3"
    assert (rows["P2"]["date_fst"], rows["P2"]["date_lst"]) == tuple(data.MONTHS[:2])
    assert made.projects.columns[-1] == "50"
    stats = {r["statistic"]: [r[str(i)] for i in range(1, 8)] for r in made.statistics.collect()}
    assert stats == {
        "max": [60.0, 120.0, 50.1, 100.0, 200.0, 300.0, None],
        "min": [49.0, 50.0, 50.1, 100.0, 200.0, 300.0, None],
        "mean": [54.5, 85.0, 25.1, 50.0, 100.0, 150.0, 0.0],
        "__50": [1, 0, 0, 0, 0, 0, 0],
        "__100": [1, 0, 1, 0, 0, 0, 0],
        "__200": [0, 1, 0, 0, 0, 0, 0],
        "__300": [0, 0, 0, 0, 0, 0, 0],
    }
    assert made.sheet.count() == 9


def test_stages_of_a_month_are_separate_and_long_lives_need_a_wider_sheet(spark):
    stages = [f"C{i}" for i in range(6)]
    fact = [
        {"date": m, "project_code": "P1", "stage": s, "total_hour": float(i)}
        for m in data.MONTHS[:10] for i, s in enumerate(stages)
    ]
    narrow = life_report(data.fact(spark, fact), codes(spark, "P1"))
    assert narrow.months.count() == 60 and narrow.projects.columns[-1] == "50"
    for table in (narrow.projects, narrow.statistics):
        with pytest.raises(Exception, match="longer than the 50 months"):
            table.collect()
    made = life_report(data.fact(spark, fact), codes(spark, "P1"), width=60)
    row = made.projects.first()
    assert made.projects.columns[-1] == "60"
    assert [row[str(i)] for i in (1, 6, 7, 60)] == [0.0, 5.0, 0.0, 5.0]
    assert "60" in made.statistics.columns


def test_empty_list(spark):
    made = life_report(data.fact(spark, entries("P1", [1.0])), codes(spark, "P9"))
    assert made.projects.count() == 0


def test_project_load(spark):
    info = spark.createDataFrame(
        [("B", "b", 1000.0, 3.0, "t", "s", "000", "o", "n"),
         ("A", "a", 100.0, 0.0, "t", "s", "000", "o", "n"),
         ("C", "c", 10.0, 1.0, "t", "s", "001", "o", "n")],
        "project_code string, project_name string, execute_hour double, execute_month double, "
        "project_type string, save_time string, user_id string, project_code_old string, "
        "project_name_old string",
    )
    rows = [tuple(r) for r in projects.project_load(info, "000").collect()]
    assert rows == [
        ("A", "a", 100.0, 0.0, None, None, None),
        ("B", "b", 1000.0, 3.0, 333.33, 16.67, 11.11),
    ]
    assert projects.project_load(info).count() == 3


def test_project_lines(spark):
    lines = spark.createDataFrame(
        [("P1,Alpha,640.5,21.25",), ("P2,",), ("P3,Beta,x,3",), ("",), ("P4,a,b,1,2",)],
        "value string",
    )
    rows = [tuple(r) for r in projects.parse_project_lines(lines).drop("line").collect()]
    assert rows == [
        ("P1", "Alpha", 640.5, 21.25, True),
        ("P2", "", None, None, False),
        ("P3", "Beta", None, 3.0, False),
        ("P4", "a", None, 1.0, False),
    ]


@pytest.mark.parametrize("user, left", [("1", [2, 3]), ("9", [1, 2, 3])])
def test_purge_keeps_rows_without_a_user(spark, user, left):
    table = spark.createDataFrame([(1, "1"), (2, "2"), (3, None)], "id int, user_id string")
    assert [r["id"] for r in projects.purge_user(table, user).orderBy("id").collect()] == left
