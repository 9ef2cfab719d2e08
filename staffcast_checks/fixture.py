"""The driver tables seen as the tables of the planning data model (see FIXTURES.md).

Every mapping uses all rows of its tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffcast import schemas
from staffcast.functions import calendar, codes
from staffcast.operators.projects import parse_project_lines

EMPLOYEE_CODES = ("HW", "RF", "OP", "PV", "E4", "ME")
PLAN_CODES = ("HW", "RF", "OP", "PV", "E4", "ME", "AR")
LIFE_BEFORE = dt.date(2001, 7, 1)
LIST_START = dt.date(2001, 10, 10)


# Schemas of the driver tables that are read.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"elt(int({index} % {len(values)}) + 1, {', '.join(repr(v) for v in values)})"


def last_month(spark: SparkSession, sf_dir: str) -> Column:
    """The last month of the fact, as a scalar subquery on the line items."""
    items = table(spark, sf_dir, "lineitem")
    return items.agg(F.trunc(F.max("l_shipdate"), "MM")).scalar()


def first_month(spark: SparkSession, sf_dir: str) -> Column:
    """The first month of the fact, likewise."""
    items = table(spark, sf_dir, "lineitem")
    return items.agg(F.trunc(F.min("l_shipdate"), "MM")).scalar()


def recent_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact of the report months only, cut on the shipping date as the files hold it."""
    first = F.add_months(last_month(spark, sf_dir), 1 - calendar.REPORT_MONTHS)
    return utilization(spark, sf_dir, since=first)


def utilization(
    spark: SparkSession, sf_dir: str, units: bool = True, since: Column | None = None
) -> DataFrame:
    """One fact row per line item: a supplier is an employee, a part is a project.

    Some employees are missing, some departments missing or blank, some hours missing.
    Without ``units`` the division and department are left out, and with them the join
    to the suppliers. The left join keeps every row and lets Spark drop it from queries
    that only look for the first or last month.
    """
    leaving = "(l_returnflag = 'R' AND l_linenumber = 7)"
    unit = """CASE l_suppkey % 17 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN ''
              ELSE n_name END"""
    function = _pick(EMPLOYEE_CODES, "l_suppkey")
    days = {f"C{i}_day": f"double(l_partkey % 50 + {10 * i})" for i in range(7)}
    days["C6_day"] = f"CASE WHEN NOT {leaving} THEN {days['C6_day']} END"
    columns = {
        "date": "trunc(l_shipdate, 'MM')",
        "emplid": "CASE WHEN l_suppkey % 19 <> 5 THEN string(l_suppkey) END",
        "sub_job_family": function,
        "sub_job_family_2": codes.planning_function(function),
        "project_code": "concat('P', l_partkey)",
        "project_start_stage":
            "concat('C', if(l_partkey % 10 = 3, l_linenumber % 2, l_partkey % 7))",
        "stage": "l_linestatus",
        "pmcs_bu_start_dt": "add_months(DATE '1994-07-01', int(l_partkey % 24))",
        **days,
        "execute_hour": "double(100 * (l_partkey % 90))",
        "execute_month": "double(1 + l_partkey % 36)",
        "execute_day": "double(20 * (1 + l_partkey % 36) + l_linenumber)",
        "total_hour": "CASE WHEN (l_orderkey + l_linenumber) % 499 <> 3 THEN l_quantity END",
        "attendance": "l_quantity + l_linenumber",
        "termination_n": f"bigint(if({leaving}, 1, 0))",
        "utilization_rate_by_div_func": "l_quantity / (l_quantity + l_linenumber)",
        "utilization_rate_by_dep": "l_quantity / (l_quantity + l_linenumber + 1)",
        "div": "r_name",
        "deptid": unit,
    }
    items = table(spark, sf_dir, "lineitem")
    if since is not None:
        items = items.where(F.col("l_shipdate") >= since.cast("timestamp_ntz"))
    names = schemas.UTILIZATION.names
    if units:
        for name, key, other in (
            ("supplier", "l_suppkey", "s_suppkey"),
            ("nation", "s_nationkey", "n_nationkey"),
            ("region", "n_regionkey", "r_regionkey"),
        ):
            lookup = table(spark, sf_dir, name)
            items = items.join(lookup, F.col(key) == F.col(other), "left")
    else:
        names = [n for n in names if n not in ("div", "deptid")]
    return items.selectExpr(*[f"{columns[n]} AS {n}" for n in names])


def _with_region(rows: DataFrame, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Name of the region whose key is in column ``region``."""
    regions = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("region"), F.col("r_name").alias(name)
    )
    return rows.join(regions, "region", "left")


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario per customer."""
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS scenario_id",
        "int(c_custkey % 5) AS region",
        "concat('U', c_custkey % 100) AS user_id",
    )
    return _with_region(rows, spark, sf_dir, "division").select(*schemas.SCENARIOS.names)


def plan_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One planned project per order, as raw request text.

    The scenario is the customer. A fifth of the rows share one model project; some name
    no, an unknown, or a too early one; every fourth customer plans no project.
    """
    part = "floor(2 * o_orderkey / 15)"
    block = f"({part} - {part} % 24)"
    start = "date_add(DATE '2001-08-15', int(o_orderkey % 120))"
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS scenario_id",
        "int(o_custkey % 5) AS region",
        """CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 2 = 0 THEN ''
                WHEN o_custkey % 4 = 0 THEN NULL
                WHEN o_orderkey % 40 = 0 THEN ' '
                ELSE concat('N', o_orderkey) END AS project_code""",
        "CASE WHEN o_orderkey % 25 <> 24 THEN concat('NP', o_orderkey % 4) END AS project_name",
        f"""CASE WHEN o_orderkey % 55 = 3 THEN ''
                 WHEN o_orderkey % 5 = 0 THEN 'P30'
                 WHEN o_orderkey % 90 = 1 THEN concat('P', {block} + {part} % 6)
                 WHEN o_orderkey % 130 = 2 THEN concat('PX', o_orderkey)
                 ELSE concat('P', {block} + 6 + {part} % 18) END AS project_code_old""",
        "CAST(NULL AS STRING) AS project_name_old",
        """CASE WHEN o_orderkey % 15 = 0 THEN '0' WHEN o_orderkey % 15 = 7 THEN ''
                WHEN o_orderkey % 15 <> 8 THEN string(bigint(floor(o_totalprice / 100)))
                END AS execute_hour""",
        """CASE WHEN o_orderkey % 31 = 0 THEN '0' WHEN o_orderkey % 31 = 5 THEN ''
                ELSE string(1 + o_orderkey % 36) END AS execute_month""",
        f"""CASE WHEN o_orderkey % 77 = 5 THEN ''
                 WHEN o_orderkey % 2 = 0
                     THEN concat_ws('/', year({start}), month({start}), day({start}))
                 ELSE string({start}) END AS start_date""",
    )
    return _with_region(rows, spark, sf_dir, "division").select(
        *schemas.PLAN_PROJECTS_RAW.names
    )


def plan_headcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One head count row per order, as raw request text.

    Some are blank or zero, belong to another division, to an unknown department or to
    no project.
    """
    region = "((o_custkey % 5 + if(o_orderkey % 17 = 0, 1, 0)) % 5)"
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS scenario_id",
        f"int({region}) AS region",
        """CASE WHEN o_orderkey % 33 = 4 THEN '' WHEN o_orderkey % 10 = 9 THEN '0'
                ELSE string(1 + o_orderkey % 3) END AS HC""",
        f"""CASE WHEN o_orderkey % 29 = 0 THEN 'NATION_X'
                 ELSE concat('NATION_', {region} + 5 * (o_orderkey % 5)) END AS deptid""",
        "concat('N', o_orderkey % 3) AS project_code",
        """CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE concat('NP', o_orderkey % 5) END
                AS project_name""",
        f"{_pick(PLAN_CODES, 'o_orderkey')} AS sub_job_family",
    )
    return _with_region(rows, spark, sf_dir, "div").select(*schemas.PLAN_HEADCOUNT_RAW.names)


def project_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved projects: one per order, of a thousand users."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('N', o_orderkey) AS project_code",
        "concat('NP', o_orderkey % 4) AS project_name",
        "CASE WHEN o_orderkey % 15 <> 8 THEN double(floor(o_totalprice / 100)) END AS execute_hour",
        "double(o_orderkey % 36) AS execute_month",
        "o_orderpriority AS project_type",
        "string(o_orderdate) AS save_time",
        "lpad(string(o_custkey % 1000), 3, '0') AS user_id",
        "concat('P', o_orderkey % 50) AS project_code_old",
        "CAST(NULL AS STRING) AS project_name_old",
    )


def project_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("concat('P', p_partkey) AS project_code")


def project_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project list lines, one per part; some hold a code only, some a bad number."""
    return table(spark, sf_dir, "part").selectExpr(
        """CASE WHEN p_partkey % 20 = 0 THEN concat('P', p_partkey, ',')
                WHEN p_partkey % 20 = 7 THEN concat('P', p_partkey, ',', p_name, ',many,3')
                ELSE concat('P', p_partkey, ',', p_name, ',', p_retailprice, ',', p_size)
                END AS value"""
    )


def listed_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed project list with a scenario and a division for every line."""
    lines = parse_project_lines(project_lines(spark, sf_dir)).selectExpr(
        "*",
        "bigint(substring(project_code, 2)) AS scenario_id",
        "int(bigint(substring(project_code, 2)) % 5) AS region",
        "'001' AS user_id",
    )
    return _with_region(lines, spark, sf_dir, "division")


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order as JSON text; some are broken, some lack division or user."""
    project = """concat(', "data_Prj": [{"project_code": "N', o_orderkey,
        '", "project_name": "NP", "project_code_old": "',
        if(o_orderkey % 40 = 0, 'PX', concat('P', 6 + o_orderkey % 18)),
        '", "execute_hour": 500, "execute_month": "", "start_date": "2001/9/15"}]')"""
    staff = """concat(', "data_HC": [{"HC": ', o_orderkey % 3, ', "div": "', r_name,
        '", "deptid": "NATION_', r_regionkey + 5 * (o_orderkey % 5),
        '", "project_code": "", "project_name": "NP", "sub_job_family": "HW"}]')"""
    regions = table(spark, sf_dir, "region")
    orders = table(spark, sf_dir, "orders").withColumn("region", F.expr("int(o_custkey % 5)"))
    return orders.join(regions, F.col("region") == F.col("r_regionkey"), "left").selectExpr(
        f"""CASE o_orderkey % 50
            WHEN 1 THEN concat('{{"division": "', r_name, '", ')
            WHEN 2 THEN concat('{{"user": "R', o_orderkey, '"}}')
            WHEN 3 THEN concat('{{"division": "', r_name, '"}}')
            ELSE concat('{{"division": "', r_name, '", "user": "R', o_orderkey, '"',
                if(o_orderkey % 3 = 0, {project}, ''), if(o_orderkey % 4 = 0, {staff}, ''), '}}')
            END AS value"""
    )


def no_headcount(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.PLAN_HEADCOUNT_RAW)
