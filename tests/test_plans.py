"""Shape of the physical plans, and joins with hot keys."""

from __future__ import annotations

import datetime as dt
import re

import data
import pytest
from compare import database, differences, plan_of
from conftest import SMALL
from pyspark.sql import functions as F

from staffcast_checks import fixture
from staffcast_checks.catalog import QUERIES
from staffcast_checks.oracle import ORACLE
from staffcast.operators import hours, rates, spread
from staffcast.plans import report
from staffcast.sources import readers, writers


def test_rates_read_only_recent_partitions_and_needed_columns(spark, tmp_path):
    path = str(tmp_path / "fact")
    writers.write_table(data.fact(spark, data.random_company(1)), path, ["date"])
    plan = plan_of(rates.function_rates(readers.read_utilization(spark, path)))
    scan = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert any("date" in line and "subquery" in line.lower() for line in scan)
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert all("C0_day" not in line and "project_code" not in line for line in schemas)


def test_opening_hours_do_not_join_units(spark):
    fact = fixture.utilization(spark, SMALL, units=False)
    plan = plan_of(hours.opening_hours(fact))
    assert "Join" not in plan and "WindowGroupLimit" in plan


def test_history_reads_own_columns_and_writes_projects_only(spark):
    """Each grain reads its columns, and sums of the size of the fact are not written."""
    fact = fixture.utilization(spark, SMALL, units=False)
    efforts = plan_of(rates.project_efforts(fact, dt.date(1995, 1, 1)))
    opening = plan_of(hours.opening_sheet(hours.opening_hours(fact)))
    assert "l_suppkey" not in efforts and "l_linenumber" in efforts and "l_quantity" not in efforts
    assert "add_months" not in opening
    for plan in (efforts, opening):
        assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 1
    with spread.scratch(spark):
        history = report.prepare_history(fact)
        kinds = fact.select("project_code", "sub_job_family_2").distinct().count()
        assert history.opening.count() == kinds < 0.7 * fact.count()
        assert history.models.count() <= fact.select("project_code").distinct().count()


def test_scenarios_meet_broadcast_units(spark):
    plan = plan_of(QUERIES["scenario_batch"](spark, SMALL))
    assert "BroadcastHashJoin" in plan
    assert "Pivot" not in plan


def test_a_hot_key_is_joined_in_many_tasks(spark, tmp_path):
    """Two thirds of the rows have one key: Spark splits its partition, and loses nothing."""
    rows = spark.range(300_000).selectExpr(
        "id", "if(id % 3 = 0, concat('k', id % 500), 'hot') AS key", "uuid() AS filler"
    )
    lookup = spark.range(500).selectExpr("concat('k', id) AS key", "id AS v").unionByName(
        spark.createDataFrame([("hot", -1)], "key string, v long")
    )
    rows, lookup = spread.settle_together(rows=rows, lookup=lookup)
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        joined = rows.join(lookup, "key", "left")
        found = joined.selectExpr("spark_partition_id() AS part", "v").groupBy("part").agg(
            F.expr("count_if(v = -1) AS n")
        ).collect()
        tasks = [r for r in found if r["n"]]
    finally:
        for name in small:
            spark.conf.unset(name)
    assert sum(r["n"] for r in tasks) == 200_000 and len(tasks) > 1


def test_settled_tables_go_with_their_scope(spark, tmp_path):
    folder = tmp_path / "shared"
    spark.sparkContext.setCheckpointDir(str(tmp_path / "other"))
    with spread.scratch(spark):
        one, two = spread.settle_together(a=spark.range(3), b=spark.range(4))
        paths = [df.inputFiles()[0] for df in (one, two)]
        assert one.count() + two.count() == 7
    for path in paths:
        with pytest.raises(Exception, match="(?i)not exist|not_found|no such"):
            spark.read.parquet(path).count()
    assert not folder.exists()


def test_shared_dir_is_the_one_the_session_names(spark):
    assert spread.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_batch_without_any_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["scenario_batch"](spark, SMALL)
        assert "BroadcastHashJoin" not in plan_of(df) and "SortMergeJoin" in plan_of(df)
        assert differences(df, database(SMALL), ORACLE["scenario_batch"]) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_prepared_calls_do_not_read_the_fact(spark):
    fact = fixture.utilization(spark, SMALL)
    units, history = report.prepare_units(fact), report.prepare_history(fact)
    unread = spark.createDataFrame([], fact.schema)
    tables = [f(spark, SMALL) for f in (fixture.scenarios, fixture.plan_projects, fixture.plan_headcount)]
    df = report.score_scenarios(unread, *tables, units=units, history=history)
    assert differences(df, database(SMALL), ORACLE["scenario_batch"]) is None


def test_units_are_summed_by_employee_before_the_groupings(spark):
    plan = plan_of(rates.unit_rates(fixture.recent_utilization(spark, SMALL), fixture.last_month(spark, SMALL)))
    order = [line.strip() for line in plan.split("(1) Scan")[0].splitlines()]
    expand = next(i for i, line in enumerate(order) if "Expand" in line)
    assert any("HashAggregate" in line for line in order[expand + 1:])
    filters = [line for line in plan.splitlines() if "l_shipdate" in line and "Filter" in line]
    assert filters


def test_units_of_a_scenario_are_not_exchanged(spark):
    """What is added to units comes to the scenario before its units are listed, and users go along."""
    import re

    from staffcast.operators import what_if

    numbers = lambda names: ", ".join(f"double(1) AS {n}_{k}" for n in names for k in (1, 2, 3))
    scenarios = spark.sql("SELECT id AS scenario_id, 'A' AS division, concat('U', id) AS user_id FROM range(3)")
    sheet = spark.sql(f"SELECT 'A' AS div, concat('F', id) AS sub_job_family_2, {numbers(['b', 'hour', 'att', 'att_emp'])} FROM range(4)")
    heads = spark.sql("SELECT 1L AS scenario_id, 'A' AS div, unit AS sub_job_family_2, 2D AS hc FROM VALUES ('F1'), ('F1'), (NULL), ('X') AS t(unit)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = what_if.hc_what_if_function(scenarios, sheet, heads)
        plan = report._jdf.queryExecution().executedPlan().toString()
        rows = report.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"hashpartitioning\(scenario_id#\d+L?, div#\d+, sub_job_family_2#\d+", plan)) <= 1
    assert sorted((r.scenario_id, r.user_id, r.Title, r.hc) for r in rows) == [
        (i, f"U{i}", f"F{k}", 4.0 if (i, k) == (1, 1) else 0.0) for i in range(3) for k in range(4)
    ]


def test_shared_hours_are_worked_out_before_units_are_listed(spark, monkeypatch):
    from staffcast.operators import allocation

    seen, plain = [], allocation._shared
    monkeypatch.setattr(allocation, "_shared", lambda rows, by: seen.append(rows.columns) or plain(rows, by))
    rates = spark.sql("""SELECT 'A' AS div, dep AS deptid, fun AS sub_job_family_2, DATE '2020-01-01' AS date,
        emp AS emp_cnt, 1D AS attendance_emp FROM VALUES ('d', 'F', 2D), ('e', 'F', 3D), (NULL, 'F', 5D), ('d', NULL, 1D)
        AS t(dep, fun, emp)""")
    projects = spark.sql("""SELECT 1L AS scenario_id, 'p' AS project_name, 'A' AS div, 1L AS passes,
        map('F', map(DATE '2020-01-01', 20D)) AS hours, map('F', map('e', 10D)) AS staff""")
    rows = allocation.listing(projects, rates).collect()
    assert "deptid" not in seen[0]
    assert sorted((r.deptid or "", r.hc, r.emp, r.add_hour_pct) for r in rows) == [("", 0, 5, 5), ("d", 0, 2, 2), ("e", 10, 13, 13)]


def test_hours_per_head_are_summed_where_projects_were_dealt(spark):
    """Projects are exchanged; their functions and months are not."""
    import re

    from staffcast.operators import allocation

    rates = spark.sql("""SELECT div, dep AS deptid, fun AS sub_job_family_2, DATE '2020-01-01' AS date,
        emp AS emp_cnt, 100D AS total_hour FROM VALUES ('A', 'd', 'F', 2D), ('A', 'e', 'F', 3D) AS t(div, dep, fun, emp)""")
    projects = spark.sql("""SELECT id DIV 3 AS scenario_id, concat('p', id) AS project_name, if(id < 3, 'A', 'B') AS div, 1L AS passes,
        map('F', map(DATE '2020-01-01', 20D)) AS hours, map('F', map('e', 5D)) AS staff FROM range(0, 3, 1, 4)""")
    outlook = allocation.department_outlook(projects, rates)
    plan = outlook._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(scenario_id#\d+L?, div#\d+, sub_job_family_2#\d+", plan)
    assert sorted((r.deptid, r.add_hour_pct, r.total_hour) for r in outlook.collect()) == [("d", 12, 300), ("e", 48, 300)]


def test_hours_of_new_projects_are_exchanged_before_departments_are_listed(spark):
    """Scenarios and what their projects add are exchanged, never their departments or functions."""
    from staffcast.operators import what_if

    months = lambda text: ", ".join(text.replace("#", str(k)) for k in (1, 2, 3))
    scenarios = spark.sql("SELECT id AS scenario_id, 'A' AS division FROM range(3)")
    unit = months("1D AS b_#, 10D AS hour_#, 2D AS emp_#, 5D AS att_emp_#, 1 AS seen_#")
    departments = spark.sql(f"SELECT 'A' AS div, concat('d', id) AS deptid, {unit} FROM range(1, 3)")
    functions = spark.sql(f"SELECT 'A' AS div, fun AS sub_job_family_2, 10D AS att_1, 10D AS att_2, 10D AS att_3, {unit} FROM VALUES ('F'), ('G') AS t(fun)")
    both = spark.sql(f"""SELECT 'A' AS div, dep AS deptid, fun AS sub_job_family_2, {months("emp AS emp_#")}
        FROM VALUES ('d1', 'F', 1D), ('d1', 'G', 3D), ('d2', 'F', 2D) AS t(dep, fun, emp)""")
    effects = spark.sql(f"""SELECT 1L AS scenario_id, name AS project_name, 'A' AS div, fun AS sub_job_family_2, hc, hc > 0 AS has_staff,
        {months("10D AS hour_#, per_head AS per_head_#")}
        FROM VALUES ('p', 'F', 2D, 2D), ('p', 'G', 4D, 0D), ('q', 'F', 1D, 0D) AS t(name, fun, per_head, hc)""")
    staff = spark.sql(f"""SELECT 1L AS scenario_id, 'p' AS project_name, 'A' AS div, 'd2' AS deptid,
        'F' AS sub_job_family_2, 2D AS hc, 1L AS passes, {months("5D AS att_emp_#, 1 AS seen_#")}""")
    tables = spread.settle_together(scenarios=scenarios, departments=departments, both=both, effects=effects, staff=staff)
    by_department = what_if.project_what_if_department(*tables)
    by_function = what_if.project_what_if_function(scenarios, functions, effects)
    tree = by_department._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: re.search("[A-Za-z]", line).start()
    listed = next(i for i, line in enumerate(tree) if "Union" in line)
    above, at = [], depth(tree[listed])
    for line in reversed(tree[:listed]):
        if depth(line) < at:
            above.append(line)
            at = depth(line)
    assert any("Aggregate" in line for line in above) and not any("hashpartitioning" in line for line in above)
    answers = lambda df: {(r.scenario_id, r.Title): (r.hc, r.a_1, r.a_3) for r in df.collect()}
    plain = {(i, d): (0, 1, 1) for i in (0, 2) for d in ("d1", "d2")}
    assert answers(by_department) == plain | {(1, "d1"): (0, 2.5, 2.5), (1, "d2"): (2, 1, 1)}
    assert answers(by_function) == {(i, f): (0, 1, 1) for i in (0, 2) for f in "FG"} | {
        (1, "F"): (2, 1.5, 1.5), (1, "G"): (0, 2, 2),
    }
