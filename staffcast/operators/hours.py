"""Hours that a new project brings, taken from the opening months of an old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staffcast.functions import calendar, numeric

OPENING_MONTHS = 3


def month_sums(fact: DataFrame) -> DataFrame:
    """Hours of every project by function and month; a missing function is the blank one."""
    hours = numeric.strict_sum("total_hour")
    return (
        fact.fillna("", ["sub_job_family_2"])
        .groupBy("project_code", "sub_job_family_2", "date")
        .agg(F.expr(f"{hours} AS total_hour_pro_func"))
    )


def opening_hours(fact: DataFrame) -> DataFrame:
    """Hours of every project and function in its first three active months.

    Gaps between active months are skipped. All divisions count. The months are summed
    before they are numbered, so a window sees months, never employees.
    """
    active = W.partitionBy("project_code", "sub_job_family_2").orderBy("date")
    return (
        month_sums(fact)
        .withColumn("n", F.row_number().over(active))
        .where(f"n <= {OPENING_MONTHS}")
        .drop("date")
    )


def project_hours(opening: DataFrame, ratios: DataFrame, end: Column) -> DataFrame:
    """Hours of each new project by function and outlook month.

    The n-th active month of the old project becomes the n-th outlook month, scaled by
    the size and duration of the new project.
    """
    models = opening.withColumnRenamed("project_code", "project_code_old").withColumn(
        "month_no", F.expr(f"n + {calendar.REPORT_MONTHS - OPENING_MONTHS}")
    ).withColumn("date", calendar.month_date(F.col("month_no"), end)).drop("n")
    add_hour = numeric.safe_div("total_hour_pro_func * hr_ratio", "mon_ratio")
    return ratios.join(models, "project_code_old").withColumn("add_hour", F.expr(add_hour))


def prorate_start(hours: DataFrame) -> DataFrame:
    """Hours reduced to the part of each month after the start of the project."""
    return hours.withColumn(
        "start_mth_pct", F.expr(calendar.start_share("date", "start_date"))
    ).withColumn("add_hour_adj", F.expr("add_hour * start_mth_pct"))


def opening_sheet(opening: DataFrame) -> DataFrame:
    """Opening hours with the three months side by side: one row per project and function.

    The rows of a project and function are together already, so nothing is shuffled.
    """
    return opening.groupBy("project_code", "sub_job_family_2").agg(
        F.max("n").alias("months"),
        *[
            F.expr(f"max(CASE WHEN n = {n} THEN total_hour_pro_func END) AS opening_{n}")
            for n in range(1, OPENING_MONTHS + 1)
        ],
    )


def opening_rows(sheet: DataFrame) -> DataFrame:
    """The opening sheet with its months below each other again: the rows of ``opening_hours``."""
    listed = F.array(*[
        F.struct(F.col(f"opening_{n}").alias("total_hour_pro_func"), F.lit(n).alias("n"))
        for n in range(1, OPENING_MONTHS + 1)
    ])
    return sheet.select(
        "project_code", "sub_job_family_2", F.inline(F.slice(listed, 1, F.col("months")))
    )


def project_hours(opening: DataFrame, ratios: DataFrame, end: Column) -> DataFrame:
    """Hours of each new project by function and outlook month.

    The n-th active month of the old project becomes the n-th outlook month, scaled by
    the size and duration of the new project.
    """
    models = opening.withColumnRenamed("project_code", "project_code_old").withColumn(
        "month_no", F.expr(f"n + {calendar.REPORT_MONTHS - OPENING_MONTHS}")
    ).withColumn("date", calendar.month_date(F.col("month_no"), end)).drop("n")
    add_hour = numeric.safe_div("total_hour_pro_func * hr_ratio", "mon_ratio")
    return ratios.join(models, "project_code_old").withColumn("add_hour", F.expr(add_hour))


def prorate_start(hours: DataFrame) -> DataFrame:
    """Hours reduced to the part of each month after the start of the project."""
    return hours.withColumn(
        "start_mth_pct", F.expr(calendar.start_share("date", "start_date"))
    ).withColumn("add_hour_adj", F.expr("add_hour * start_mth_pct"))


def opening_sheet(opening: DataFrame) -> DataFrame:
    """Opening hours with the three months side by side: one row per project and function.

    The rows of a project and function are together already, so nothing is shuffled.
    """
    return opening.groupBy("project_code", "sub_job_family_2").agg(*_side_by_side())


def _side_by_side() -> list[Column]:
    return [
        F.max("n").alias("months"),
        *[
            F.expr(f"max(CASE WHEN n = {n} THEN total_hour_pro_func END) AS opening_{n}")
            for n in range(1, OPENING_MONTHS + 1)
        ],
    ]


def opening_rows(sheet: DataFrame) -> DataFrame:
    """The opening sheet with its months below each other again: the rows of ``opening_hours``."""
    listed = F.array(*[
        F.struct(F.col(f"opening_{n}").alias("total_hour_pro_func"), F.lit(n).alias("n"))
        for n in range(1, OPENING_MONTHS + 1)
    ])
    return sheet.select(
        "project_code", "sub_job_family_2", F.inline(F.slice(listed, 1, F.col("months")))
    )


def project_grains(
    fact: DataFrame, started: dt.date | Column | None = None, codes: list[str] | None = None
) -> DataFrame:
    """Models and opening sheet of all projects, from one scan of the fact at two grains.

    The rows are summed by project and start stage, and by project, function and month, in
    one aggregation; neither sum has the columns of the other, and neither is written.
    One row per project that started inside the fact (``is_model``: effort and number of start
    stages), and one per project and function (the opening months side by side).
    ``codes`` are the projects wanted, all without: the scan is filtered by them, so files and
    row groups of other projects are passed over where the fact is sorted by project.
    """
    first = calendar.opening_date(fact, started)
    if codes is not None:
        fact = fact.where(F.col("project_code").isin(codes))
    keys = ["project_code", "project_start_stage", "sub_job_family_2", "date"]
    by_stage, by_month = keys[:2], [keys[0], *keys[2:]]
    efforts = ("execute_hour", "execute_month")
    sums = (
        fact.fillna("", ["sub_job_family_2"])
        .select(
            *keys, "total_hour",
            *[F.when(F.col("pmcs_bu_start_dt") >= first, F.col(c)).alias(c) for c in efforts],
            (F.col("pmcs_bu_start_dt") >= first).cast("bigint").alias("started"),
        )
        .groupingSets([[F.col(k) for k in by_stage], [F.col(k) for k in by_month]], *map(F.col, keys))
        .agg(
            F.expr("grouping(date) = 1 AS is_model"),
            F.expr("count(1) AS rows"),
            F.expr("sum(started) AS started"),
            *[F.expr(f"sum({c}) AS sum_{c}") for c in efforts],
            *[F.expr(f"count({c}) AS n_{c}") for c in efforts],
            F.expr("sum(total_hour) AS sum_total_hour"),
            F.expr("count(total_hour) AS n_total_hour"),
        )
        .where("NOT is_model OR started > 0")
        .withColumn("total_hour_pro_func", F.expr("CASE WHEN n_total_hour = rows THEN sum_total_hour END"))
    )
    months = W.partitionBy("project_code", "is_model", "sub_job_family_2").orderBy("date")
    numbered = sums.withColumn("n", F.row_number().over(months)).where(
        f"is_model OR n <= {OPENING_MONTHS}"
    )
    return numbered.groupBy("project_code", "is_model", "sub_job_family_2").agg(
        *[
            F.expr(f"""CASE WHEN sum(n_{c}) = sum(started) THEN sum(sum_{c}) / sum(started) END
                AS {c.replace('execute', 'old')}""")
            for c in efforts
        ],
        F.count(F.lit(1)).alias("stage_rows"),
        *_side_by_side(),
    )


def plan_factors(ratios: DataFrame, end: Column) -> DataFrame:
    """What the opening hours of the old project are multiplied with, for each month.

    Scaling, start share and passes only depend on the plan row, so they are worked out
    before the row is multiplied by the functions of the old project.
    """
    months = range(1, OPENING_MONTHS + 1)
    scale = numeric.safe_div("hr_ratio", "mon_ratio")
    return (
        ratios.withColumns({
            f"month_{n}": F.add_months(end, n - OPENING_MONTHS) for n in months
        })
        .selectExpr(
            "scenario_id", "project_name", "div", "project_code_old",
            *[
                f"{scale} * {calendar.start_share(f'month_{n}', 'start_date')} * stage_rows "
                f"AS factor_{n}"
                for n in months
            ],
        )
    )


def added_hours(sheet: DataFrame, factors: DataFrame) -> DataFrame:
    """Added hours of every plan row by function, the outlook months side by side."""
    models = sheet.withColumnRenamed("project_code", "project_code_old")
    return factors.join(models, "project_code_old").selectExpr(
        "scenario_id", "project_name", "div", "sub_job_family_2", "months",
        *[
            f"coalesce(opening_{n} * factor_{n}, 0D) AS hour_{n}"
            for n in range(1, OPENING_MONTHS + 1)
        ],
    )


def project_passes(ratios: DataFrame) -> DataFrame:
    """New projects of a scenario and how often their head count is added."""
    return ratios.groupBy("scenario_id", "project_name", "div").agg(
        F.max("stage_rows").alias("passes")
    )


def month_hours(added: DataFrame, end: Column) -> DataFrame:
    """Added hours by scenario, project and function over all its old projects, as a map by date.

    The months stay side by side until the sums are made. A month that none of the old
    projects has worked in is not in the map.
    """
    months = range(1, OPENING_MONTHS + 1)
    summed = added.groupBy("scenario_id", "project_name", "div", "sub_job_family_2").agg(
        F.max("months").alias("months"), *[F.sum(f"hour_{n}").alias(f"hour_{n}") for n in months]
    )
    listed = F.array(*[
        F.struct(F.add_months(end, n - OPENING_MONTHS).alias("date"), F.col(f"hour_{n}").alias("hour"))
        for n in months
    ])
    by_date = F.map_from_entries(F.slice(listed, 1, F.col("months")))
    return summed.select(
        "scenario_id", "project_name", "div", "sub_job_family_2", by_date.alias("hours")
    )
