"""Unit rates of a fact that grows: every load is read once and kept as partial states.

A store is a folder with three tables, each written by load: ``numbers`` gives employees the
numbers that their bitmaps use, ``states`` holds partial sums and bitmaps by month, and
``loads`` names the loads that are complete. A load that failed is not read, and is replaced
when it is repeated.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staffcast.operators import rates
from staffcast.operators.spread import exists, settle

_NUMBERS = "emplid string, number bigint"
_UNIT = ("div", "deptid", "sub_job_family_2")


def _loads(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete loads; there are as many as months or days of loading."""
    if not exists(spark, f"{path}/loads"):
        return []
    return sorted(r["load"] for r in spark.read.schema("load string").parquet(f"{path}/loads").collect())


def _table(spark: SparkSession, path: str, columns: str, loads: list[str]) -> DataFrame:
    """The rows of the named loads; folders of other loads are not listed into the scan."""
    table = spark.read.schema(f"{columns}, load string").parquet(path)
    return table.where(F.col("load").isin(loads)).drop("load")


def employee_numbers(fact: DataFrame, known: DataFrame | None, first: int) -> DataFrame:
    """Numbers from ``first`` for the employees that are not known: (emplid, number).

    Employees of one unit get neighbouring numbers, so that the bitmaps of a unit are few. Units are
    numbered one by one from their sizes; no task sees all employees.
    """
    home = F.struct(*_UNIT)
    new = fact.where("emplid IS NOT NULL").groupBy("emplid").agg(F.min(home).alias("home"))
    if known is not None:
        new = new.join(known, "emplid", "left_anti")
    new = settle(new.select("emplid", "home"), "new_employees")
    sizes = new.groupBy("home").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(W.orderBy("home").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("home", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("home").orderBy("emplid"))
    return new.withColumn("place", place).join(offsets, new["home"].eqNullSafe(offsets["home"])).select(
        "emplid", (F.col("before") + F.col("place") + (first - 1)).alias("number")
    )


def add_load(fact: DataFrame, path: str, load: str) -> None:
    """Add the rows of one load, such as a new month or late rows of an old one.

    ``fact`` holds these rows only; nothing else of the fact is read, and the states
    of earlier loads stay as they are. A complete load is not added twice.
    """
    spark = fact.sparkSession
    done = _loads(spark, path)
    if load in done:
        return
    known = _table(spark, f"{path}/numbers", _NUMBERS, done) if done else None
    first = 1 if known is None else (known.agg(F.max("number")).first()[0] or 0) + 1
    numbers = employee_numbers(fact, known, first)
    numbers.write.mode("overwrite").parquet(f"{path}/numbers/load={load}")
    numbers = _table(spark, f"{path}/numbers", _NUMBERS, [*done, load])
    states = rates.unit_states(fact, numbers)
    states.write.mode("overwrite").partitionBy("date").parquet(f"{path}/states/load={load}")
    spark.range(1).select(F.lit(load).alias("load")).coalesce(1).write.mode("append").parquet(f"{path}/loads")


def states_of(spark: SparkSession, path: str) -> DataFrame:
    """The states of all complete loads, partitioned by date."""
    loads = _loads(spark, path)
    if not loads:
        raise ValueError(f"no complete load in {path}")
    return _table(spark, f"{path}/states", rates.STATE_COLUMNS, loads)


def rates_of_store(spark: SparkSession, path: str, end: dt.date | Column | None = None) -> DataFrame:
    """The unit rates of all complete loads, as ``rates.unit_rates`` gives them from the fact."""
    return rates.rates_of_states(states_of(spark, path), end)
