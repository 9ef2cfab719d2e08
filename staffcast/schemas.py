"""Declared schemas of the tables. No schema is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _D, _L, _DATE = T.StringType(), T.DoubleType(), T.LongType(), T.DateType()

STAGE_DAYS = tuple(f"C{i}_day" for i in range(7))

UTILIZATION = _struct(
    ("date", _DATE),
    ("div", _S),
    ("deptid", _S),
    ("emplid", _S),
    ("sub_job_family", _S),
    ("sub_job_family_2", _S),
    ("project_code", _S),
    ("project_start_stage", _S),
    ("stage", _S),
    ("pmcs_bu_start_dt", _DATE),
    *[(name, _D) for name in STAGE_DAYS],
    ("execute_hour", _D),
    ("execute_month", _D),
    ("execute_day", _D),
    ("total_hour", _D),
    ("attendance", _D),
    ("termination_n", _L),
    ("utilization_rate_by_div_func", _D),
    ("utilization_rate_by_dep", _D),
)

SCENARIOS = _struct(("scenario_id", _L), ("division", _S), ("user_id", _S))

# Request rows as they arrive: numbers and dates are text, and blank text means missing.
PLAN_PROJECTS_RAW = _struct(
    ("scenario_id", _L),
    ("division", _S),
    ("project_code", _S),
    ("project_name", _S),
    ("project_code_old", _S),
    ("project_name_old", _S),
    ("execute_hour", _S),
    ("execute_month", _S),
    ("start_date", _S),
)

PLAN_HEADCOUNT_RAW = _struct(
    ("scenario_id", _L),
    ("HC", _S),
    ("div", _S),
    ("deptid", _S),
    ("project_code", _S),
    ("project_name", _S),
    ("sub_job_family", _S),
)

# Columns of the sample files, in file order; older spellings are mapped when read.
PROJECT_FILE = _struct(
    ("project_code", _S),
    ("project_name", _S),
    ("project_code_old", _S),
    ("other_project_name", _S),
    ("execute_hour", _S),
    ("execute_month", _S),
)
HEADCOUNT_FILE = _struct(
    ("HC", _S),
    ("Serial", _S),
    ("div", _S),
    ("deptid", _S),
    ("project_code", _S),
    ("project_name", _S),
    ("sub_job_family", _S),
    ("savetime", _S),
    ("UserId", _S),
)

_REQUEST_PROJECT = _struct(*[(f.name, _S) for f in PLAN_PROJECTS_RAW.fields[2:]])
_REQUEST_HEADCOUNT = _struct(
    *[(f.name, _S) for f in PLAN_HEADCOUNT_RAW.fields[1:]],
    ("save_time", _S),
    ("user_id", _S),
)

REQUEST = _struct(
    ("division", _S),
    ("user", _S),
    ("data_Prj", T.ArrayType(_REQUEST_PROJECT)),
    ("data_HC", T.ArrayType(_REQUEST_HEADCOUNT)),
)

PROJECT_INFO = _struct(
    ("project_code", _S),
    ("project_name", _S),
    ("execute_hour", _D),
    ("execute_month", _D),
    ("project_type", _S),
    ("save_time", _S),
    ("user_id", _S),
    ("project_code_old", _S),
    ("project_name_old", _S),
)

REJECT_LOG = _struct(
    ("user_input", _S),
    ("error_msg", _S),
    ("save_time", T.TimestampType()),
    ("user_id", _S),
)

REPORT_COLUMNS = (
    "scenario_id", "Div", "Type", "Title", "b_1", "b_2", "b_3", "hc", "a_1", "a_2", "a_3",
)
