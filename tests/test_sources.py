"""Readers and writers, and requests as files, rows and a stream."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import data
import pytest
from compare import plan_of
from pyspark.sql import functions as F

from staffcast.operators.planning import scenarios_of_list
from staffcast.operators.projects import parse_project_lines
from staffcast.plans import records, report
from staffcast.schemas import REPORT_COLUMNS
from staffcast.sources import readers, writers
from staffcast.streaming.requests import score_request_folder

REQUESTS = [
    {"division": "D1", "user": "001",
     "data_Prj": [{"project_code": "0", "project_name": "new", "project_code_old": "P1",
                   "project_name_old": "old", "execute_hour": 0, "execute_month": "",
                   "start_date": "2021/6/15"}],
     "data_HC": [{"HC": 1, "div": "D1", "deptid": "A", "project_code": "0",
                  "project_name": "new", "sub_job_family": "HW",
                  "save_time": "2022/3/4 上午10:20", "user_id": "001"}]},
    {"division": "D1", "user": "002"},
    {"division": "D1", "user": "003",
     "data_Prj": [{"project_code": "1", "project_name": "x", "project_code_old": "NONE"}]},
]
# What cannot be answered, and why.
BAD = {
    '{"division": "D1", "user": "004"': "Not a JSON request",
    '["D1"]': "Not a JSON request",
    '{"user": "005"}': "No division",
    '{"division": " ", "user": "006"}': "No division",
    '{"division": "D1"}': "No user",
}


def company(spark):
    return data.fact(spark, [{"date": m, "project_code": "OLD"} for m in data.MONTHS] + [
        {"date": m, "div": "D9", "deptid": "Z", "project_code": "P1", "total_hour": 10.0}
        for m in data.MONTHS[:3]
    ])


def folder_of_requests(tmp_path):
    folder = tmp_path / "requests"
    folder.mkdir()
    for i, request in enumerate(REQUESTS):
        (folder / f"{i}.json").write_text(json.dumps(request, ensure_ascii=False) + "\n")
    (folder / "bad.json").write_text("\n".join([*BAD, "", ""]))
    return str(folder)


def test_no_request_is_lost(spark, tmp_path):
    requests = readers.read_requests(spark, folder_of_requests(tmp_path))
    assert requests.count() == len(REQUESTS) + len(BAD)
    log = records.unreadable_requests(requests, dt.datetime(2022, 1, 1)).collect()
    assert {r["user_input"]: r["error_msg"] for r in log} == BAD
    assert {r["user_id"] for r in log} == {None, "005", "006"}
    assert all(len(r["scenario_id"]) == 64 for r in requests.collect())


def test_requests_become_tables(spark, tmp_path):
    asked, planned, staffed = readers.split_requests(
        readers.read_requests(spark, folder_of_requests(tmp_path))
    )
    assert asked.count() == 3 and asked.select("scenario_id").distinct().count() == 3
    row = planned.where("project_code_old = 'P1'").first()
    assert (row["division"], row["execute_hour"], row["start_date"]) == ("D1", "0", "2021/6/15")
    assert staffed.columns == [
        "scenario_id", "HC", "div", "deptid", "project_code", "project_name", "sub_job_family",
    ]


def outlooks(rows, users):
    return {
        (users[r["scenario_id"]], r["Type"]): (r["hc"], r["a_1"], r["a_2"], r["a_3"])
        for r in rows
    }


# (80 + 10 x share) / (160 + 160 x 1 head) with shares 0, 0.5, 1; and the plain rate.
EXPECTED = {
    ("001", "SUB"): (1.0, 0.25, 0.27, 0.28), ("001", "DEP"): (1.0, 0.25, 0.27, 0.28),
    ("002", "SUB"): (0.0, 0.5, 0.5, 0.5), ("002", "DEP"): (0.0, 0.5, 0.5, 0.5),
}


def test_request_batch(spark, tmp_path):
    asked, planned, staffed = readers.split_requests(
        readers.read_requests(spark, folder_of_requests(tmp_path))
    )
    users = {r["scenario_id"]: r["user_id"] for r in asked.collect()}
    rows = report.score_scenarios(company(spark), asked, planned, staffed).collect()
    assert outlooks(rows, users) == EXPECTED


def test_requests_are_worked_out_by_number(spark, tmp_path, monkeypatch):
    """The key of a request is written once; what is worked out about it has a number instead."""
    texts = [json.dumps(r) for r in REQUESTS]
    lines = spark.createDataFrame([(t,) for t in [*texts, *texts[1:], "{}"]], "value string")
    tables, settle = {}, report.settle
    monkeypatch.setattr(report, "settle", lambda df, name, *how: tables.setdefault(name, settle(df, name, *how)))
    units, history = report.prepare_units(company(spark)), report.prepare_history(company(spark))
    answers, refused = report.answer_requests(readers.parse_requests(lines), units, history)
    key = {user: hashlib.sha256(t.encode()).hexdigest() for user, t in zip(("001", "002", "003"), texts)}
    rows = answers.collect()
    assert answers.columns == [*REPORT_COLUMNS, "user_id"] and len(rows) == 4
    assert outlooks(rows, {k: user for user, k in key.items()}) == EXPECTED
    assert all(key[r["user_id"]] == r["scenario_id"] for r in rows)
    assert sorted(r["user_input"] for r in refused.collect()) == sorted([texts[2], texts[2], "{}"])
    worked = {"headcount", "modelled_plan", "project_staff", "project_effects"}
    assert worked < set(tables)
    for name in worked:
        assert dict(tables[name].dtypes)["scenario_id"] == "bigint"
        assert not {"request_id", "user_id"} & set(tables[name].columns)
    optimized = answers.drop("scenario_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "request_id" not in optimized.split("Relation")[0] and "text" not in optimized


def test_literal_rows(spark):
    request = REQUESTS[0]
    tables = readers.scenario_rows(
        spark, "D1", "001", request["data_Prj"], request["data_HC"]
    )
    rows = report.score_scenarios(company(spark), *tables).collect()
    users = {r["scenario_id"]: "001" for r in rows}
    assert outlooks(rows, users) == {k: v for k, v in EXPECTED.items() if k[0] == "001"}


def test_request_stream(spark, tmp_path):
    folder = folder_of_requests(tmp_path)
    asked, _, _ = readers.split_requests(readers.read_requests(spark, folder))
    users = {r["scenario_id"]: r["user_id"] for r in asked.collect()}
    out = [str(tmp_path / name) for name in ("answers", "refusals", "state")]
    query = score_request_folder(spark, company(spark), folder, *out, files_per_batch=2)
    query.awaitTermination()
    assert query.exception() is None
    answers = spark.read.parquet(out[0]).collect()
    assert outlooks(answers, users) == EXPECTED
    assert all(users[r["scenario_id"]] == r["user_id"] for r in answers)
    refused = {r["user_input"]: r["error_msg"] for r in spark.read.parquet(out[1]).collect()}
    assert refused == {**BAD, json.dumps(REQUESTS[2]): "Invalid project code!!"}


def test_a_request_that_comes_again_is_answered_once(spark, tmp_path):
    """The same text in two batches of one run, and in a later run of the same query."""
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps(r) for r in REQUESTS[:2]]
    out = [str(tmp_path / name) for name in ("answers", "refusals", "state")]

    def run():
        query = score_request_folder(spark, company(spark), str(folder), *out, files_per_batch=1)
        query.awaitTermination()
        assert query.exception() is None

    (folder / "1.json").write_text(lines[0] + "\n")
    (folder / "2.json").write_text(lines[0] + "\n" + lines[1] + "\n")
    run()
    first = sorted(map(str, spark.read.parquet(out[0]).drop("batch").collect()))
    per_batch = {r["batch"]: r["n"] for r in spark.read.parquet(out[0]).groupBy("batch").agg(
        F.countDistinct("scenario_id").alias("n")).collect()}
    assert sorted(per_batch.values()) == [1, 1]
    (folder / "3.json").write_text(lines[1] + "\n" + lines[0] + "\n")
    run()
    assert sorted(map(str, spark.read.parquet(out[0]).drop("batch").collect())) == first


@pytest.mark.parametrize("by", [None, ["day"]])
def test_purge_rewrites_only_files_that_hold_the_user(spark, tmp_path, by):
    path = str(tmp_path / "table")
    rows = spark.range(0, 400, 1, 8).selectExpr(
        "id", "CASE WHEN id % 50 = 7 AND id < 120 THEN 'x' WHEN id % 9 <> 0 THEN concat('u', id % 5) END AS user_id",
        "date_add(DATE '2020-01-01', int(id / 200)) AS day",
    )
    writers.write_table(rows, path, by)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("part-*")}
    expected = sorted(map(str, rows.where("coalesce(user_id, '') <> 'x'").collect()))
    purged = writers.purge_user_files(spark, path, "x")
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("part-*")}
    assert len(purged) == 3 and len(before) >= 8
    assert len(before.items() & after.items()) == len(before) - 3
    kept = spark.read.parquet(path).select(rows.columns)
    assert sorted(map(str, kept.collect())) == expected
    assert writers.purge_user_files(spark, path, "x") == []
    assert not [p for p in (tmp_path / "table").iterdir() if p.name.startswith("_purge")]


def test_a_broken_purge_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    rows = spark.range(0, 100, 1, 4).selectExpr("id", "concat('u', id % 25) AS user_id")
    writers.write_table(rows, path)
    finish = writers._finish_purges
    with monkeypatch.context() as broken:
        calls = []
        broken.setattr(writers, "_finish_purges", lambda *a: calls.append(a) if len(calls) else (calls.append(a), finish(*a)))
        writers.purge_user_files(spark, path, "u3")
    assert spark.read.parquet(path).count() == 100  # staged, nothing replaced yet
    writers.purge_user_files(spark, path, "u4")
    kept = spark.read.parquet(path)
    assert kept.count() == 92 and kept.where("user_id IN ('u3', 'u4')").isEmpty()


@pytest.mark.parametrize("by", [None, ["date"]])
def test_date_bounds_read_no_column(spark, tmp_path, by):
    path = str(tmp_path / "fact")
    writers.write_table(company(spark).repartition(3), path, by)
    dates = [r["date"] for r in company(spark).select("date").collect()]
    assert readers.date_bounds(spark, path) == (min(dates), max(dates))
    plan = plan_of(readers.date_bounds_plan(spark, path))
    assert "LocalTableScan" in plan if by else "PushedAggregation: [MIN(date), MAX(date)]" in plan


def test_csv_files(spark, tmp_path):
    (tmp_path / "hc.csv").write_text(
        "HC,Serial,div,deptid,project_code,project_name,sub_job_family,savetime,UserId\n"
        "1,1,D1,A,1,Alpha,HW,2021/6/24,1\n"
    )
    (tmp_path / "prj.csv").write_text(
        "project_code,project_name,project_code_old,other_project_name,execute_hour,"
        "execute_month\n1,Alpha,P7,,4100,12\n"
    )
    head = readers.read_headcount_csv(spark, str(tmp_path / "hc.csv"))
    assert tuple(head.first()) == ("1", "D1", "A", "1", "Alpha", "HW")
    project = readers.read_projects_csv(spark, str(tmp_path / "prj.csv")).first()
    assert project["project_code_old"] == "P7" and project["start_date"] is None


def test_project_list_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("P1,Alpha,640.5,21.25\nP2,\n")
    rows = readers.read_project_list(spark, str(tmp_path / "list.txt")).collect()
    assert [(r["project_code"], r["is_valid"]) for r in rows] == [("P1", True), ("P2", False)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, None), ("b", 1.0, 2.0)], "k string, x double, y double")
    writers.write_sheet(df, str(tmp_path / "sheet"))
    assert spark.read.csv(str(tmp_path / "sheet"), header=True).count() == 2
    writers.write_records(df, str(tmp_path / "records"))
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "records")).collect()}
    assert {json.dumps(json.loads(v), sort_keys=True) for v in lines} == {
        '{"k": "a", "x": 0.5, "y": 0.0}', '{"k": "b", "x": 1.0, "y": 2.0}',
    }
    for _ in range(2):
        writers.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    users = spark.createDataFrame([(1, "000"), (2, None)], "id int, user_id string")
    writers.purge_user_table(users, "000", str(tmp_path / "kept"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()] == [2]
    with pytest.raises(Exception):
        writers.purge_user_table(users, "000", str(tmp_path / "kept"))


def test_fact_partitioned_by_date(spark, tmp_path):
    path = str(tmp_path / "fact")
    writers.write_table(company(spark), path, ["date"])
    fact = readers.read_utilization(spark, path)
    history = report.history_report(fact)
    assert {tuple(r) for r in history.collect()} == {
        ("D1", "DEP", "A", 0.5, 0.5, 0.5), ("D1", "SUB", "RH", 0.5, 0.5, 0.5),
    }


def test_source_table_gets_the_declared_types(spark):
    typed = company(spark)
    raw = typed.selectExpr(*[
        "date_format(date, 'yyyy/M/d') AS date" if n == "date"
        else "string(pmcs_bu_start_dt) AS pmcs_bu_start_dt" if n == "pmcs_bu_start_dt"
        else "string(total_hour) AS total_hour" if n == "total_hour"
        else "CAST(attendance AS DECIMAL(18,2)) AS attendance" if n == "attendance"
        else "CAST('NaN' AS DOUBLE) AS C0_day" if n == "C0_day"
        else "CAST(termination_n AS INT) AS termination_n" if n == "termination_n"
        else n
        for n in typed.columns
    ], "'x' AS more")
    fact = readers.as_utilization(raw)
    assert fact.schema.simpleString() == typed.schema.simpleString()
    assert fact.where("C0_day IS NOT NULL").isEmpty()
    assert fact.drop("C0_day").exceptAll(typed.drop("C0_day")).isEmpty()


def test_project_list_as_scenarios(spark):
    lines = spark.createDataFrame([("P1,old,300,20",), ("P9,none,1,1",), ("P1,",)], "value string")
    listed = parse_project_lines(lines).selectExpr(
        "*", "xxhash64(project_code) AS scenario_id", "'D1' AS division", "'001' AS user_id"
    )
    asked, planned = scenarios_of_list(listed, dt.date(2021, 5, 1), scale=2.0)
    assert asked.count() == 2
    rows = report.score_scenarios(company(spark), asked, planned, data.heads(spark, []))
    # Hours 600 of 1000 and months 20 of 10: three tenths of the 10 old hours each month.
    assert {(r["Type"], r["a_1"], r["a_3"]) for r in rows.collect()} == {
        ("DEP", 0.52, 0.52), ("SUB", 0.52, 0.52),
    }
