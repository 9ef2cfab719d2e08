"""A store of partial states against the rates of the whole fact."""

from __future__ import annotations

import data
import pytest
from pyspark.sql import functions as F

from staffcast.operators import rates
from staffcast.plans import monthly


def rounded(df):
    columns = sorted(df.columns)
    return sorted(
        str([round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns]) for r in df.collect()
    )


def company(spark, seed):
    rows = data.random_company(seed)
    rows += [{**rows[i], "emplid": None} for i in range(0, 60, 7)]
    rows += [{**rows[i], "deptid": None, "emplid": "only here"} for i in range(3, 60, 9)]
    rows += [{**rows[i], "sub_job_family_2": None} for i in range(5, 60, 11)]
    return data.fact(spark, rows)


def test_months_added_one_by_one_equal_the_whole_fact(spark, tmp_path):
    fact = company(spark, 1).cache()
    path = str(tmp_path / "store")
    for month in data.MONTHS[-3:]:
        monthly.add_load(fact.where(F.col("date") == month), path, f"{month:%Y-%m}")
        seen = fact.where((F.col("date") >= data.MONTHS[-3]) & (F.col("date") <= month))
        assert rounded(monthly.rates_of_store(spark, path)) == rounded(rates.unit_rates(seen))
    fact.unpersist()


def test_late_rows_of_a_month_and_loads_without_rows(spark, tmp_path):
    fact = company(spark, 3).where(F.col("date") >= data.MONTHS[-3]).cache()
    path = str(tmp_path / "store")
    parts = F.crc32(F.concat("project_code", F.lit("/"), F.coalesce("emplid", F.lit("")))) % 3
    for part in range(3):
        monthly.add_load(fact.where(parts == part), path, str(part))
    monthly.add_load(fact.limit(0), path, "none")
    assert rounded(monthly.rates_of_store(spark, path)) == rounded(rates.unit_rates(fact))
    fact.unpersist()


def test_a_new_month_reads_and_writes_that_month_only(spark, tmp_path):
    """Earlier files of the fact may be gone and earlier states are not written again."""
    fact = company(spark, 4)
    path, source = str(tmp_path / "store"), tmp_path / "fact"
    old, new = data.MONTHS[-2:]
    for month in (old, new):
        fact.where(F.col("date") == month).write.parquet(f"{source}/{month}")
    monthly.add_load(spark.read.parquet(f"{source}/{old}"), path, "old")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("part-*") if "loads" not in str(p)}
    for file in (source / str(old)).glob("*"):
        file.unlink()
    monthly.add_load(spark.read.parquet(f"{source}/{new}"), path, "new")
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("part-*") if "loads" not in str(p)}
    assert before.items() <= after.items()
    assert {p.parent.name for p in after.keys() - before.keys()} == {f"date={new}", "load=new"}
    whole = rates.unit_rates(fact.where(F.col("date") >= old))
    assert rounded(monthly.rates_of_store(spark, path)) == rounded(whole)


def test_a_failed_load_is_not_read_and_can_be_repeated(spark, tmp_path, monkeypatch):
    fact = company(spark, 5)
    path = str(tmp_path / "store")
    old, new = (fact.where(F.col("date") == month) for month in data.MONTHS[-2:])
    monthly.add_load(old, path, "1")
    with monkeypatch.context() as broken:
        broken.setattr(rates, "unit_states", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            monthly.add_load(new, path, "2")
    assert rounded(monthly.rates_of_store(spark, path)) == rounded(rates.unit_rates(old))
    for _ in range(2):  # the second time it is complete and not added again
        monthly.add_load(new, path, "2")
    both = rates.unit_rates(fact.where(F.col("date") >= data.MONTHS[-2]))
    assert rounded(monthly.rates_of_store(spark, path)) == rounded(both)


def test_employee_numbers_are_dense_and_near_by_unit(spark):
    fact = company(spark, 6)
    first = {r.emplid: r.number for r in monthly.employee_numbers(fact, None, 5).collect()}
    known = spark.createDataFrame(list(first.items())[:4], "emplid string, number bigint")
    rest = monthly.employee_numbers(fact, known, 1).collect()
    assert sorted(first.values()) == list(range(5, 5 + len(first)))
    assert {r.emplid for r in rest} == set(first) - {r.emplid for r in known.collect()}
    homes = fact.where("emplid IS NOT NULL").groupBy("emplid").agg(F.min(F.struct("div", "deptid", "sub_job_family_2")).alias("h"))
    order = [r.h for r in sorted(homes.collect(), key=lambda r: first[r.emplid])]
    assert len({i for i in range(len(order)) if i == 0 or order[i] != order[i - 1]}) == len(set(order))
