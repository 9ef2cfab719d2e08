"""Readers. Every reader declares its schema; connection settings come from the caller."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from staffcast import schemas
from staffcast.functions import calendar, numeric
from staffcast.operators.projects import parse_project_lines


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet table; a fact is best written partitioned by ``date``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def as_utilization(table: DataFrame) -> DataFrame:
    """A source table with the declared columns and types of the fact.

    Dates may arrive as text, numbers as decimals or text, and missing numbers as NaN or
    blank; columns that are already typed are passed on as they are, so that filters on
    them still reach the scan.
    """
    found = dict(table.dtypes)

    def typed(name: str, kind: str) -> str:
        if kind == "date" and found[name] == "string":
            return calendar.parse_day(name)
        if kind == "double" and found[name] == "string":
            return numeric.parse_number(name)
        if kind == "double":
            return f"nanvl(double({name}), CAST(NULL AS DOUBLE))"
        return name if found[name] == kind else f"CAST({name} AS {kind})"

    return table.selectExpr(*[
        f"{typed(field.name, field.dataType.simpleString())} AS {field.name}"
        for field in schemas.UTILIZATION.fields
    ])


def read_utilization(spark: SparkSession, path: str) -> DataFrame:
    return as_utilization(read_table(spark, path, schemas.UTILIZATION))


def date_bounds_plan(spark: SparkSession, path: str, column: str = "date") -> DataFrame:
    """First and last date of a Parquet table without reading any column.

    Where the table is partitioned by the date, the names of its folders tell; else Spark takes the
    minimum and maximum of every file from its footer. The settings that this needs are those of a
    session of its own, so other reads stay as they are.
    """
    own = spark.newSession()
    if column in partition_columns(spark, path):
        own.conf.set("spark.sql.optimizer.metadataOnly", "true")
    else:
        own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        own.conf.set("spark.sql.sources.useV1SourceList", "")
    return own.read.parquet(path).agg(F.min(column).alias("first"), F.max(column).alias("last"))


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Columns that the folders of a Parquet table hold, and not its files."""
    table = spark.read.parquet(path)
    any_file = table.select("_metadata.file_path").first()
    if any_file is None:
        return []
    held = set(spark.read.parquet(any_file[0]).columns)
    return [c for c in table.columns if c not in held]


def date_bounds(spark: SparkSession, path: str, column: str = "date") -> tuple[dt.date, dt.date]:
    """First and last date of a Parquet table, for ``start`` and ``end`` of the reports."""
    row = date_bounds_plan(spark, path, column).first()
    return row["first"], row["last"]


def read_jdbc(
    spark: SparkSession,
    options: dict[str, str],
    table: str,
    partition_column: str,
    bounds: tuple[str, str],
    partitions: int,
) -> DataFrame:
    """Table of a database, read in parallel ranges of a column such as ``date``.

    ``options`` carries url, driver and credentials; nothing is stored here. Filters and
    columns are pushed into the database query by Spark.
    """
    return spark.read.format("jdbc").options(**options).options(
        dbtable=table,
        partitionColumn=partition_column,
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=str(partitions),
    ).load()


def read_projects_csv(spark: SparkSession, path: str) -> DataFrame:
    """Planned projects of a file with a header; the older name column is mapped.

    The file has no start date: it is missing until the caller adds it.
    """
    table = spark.read.csv(path, header=True, schema=schemas.PROJECT_FILE)
    return table.withColumnRenamed("other_project_name", "project_name_old").withColumn(
        "start_date", F.lit(None).cast("string")
    )


def read_headcount_csv(spark: SparkSession, path: str) -> DataFrame:
    """Planned head count of a file with a header, without the columns about saving."""
    table = spark.read.csv(path, header=True, schema=schemas.HEADCOUNT_FILE)
    return table.drop("Serial", "savetime", "UserId")


def read_project_list(spark: SparkSession, path: str) -> DataFrame:
    """Project lines ``code,name,hours,months`` or ``code,`` of a text file."""
    return parse_project_lines(spark.read.text(path))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests, one JSON object per line, as ``parse_requests`` gives them."""
    return parse_requests(spark.read.text(path))


def parse_requests(lines: DataFrame) -> DataFrame:
    """Requests from a text column ``value``; none is left out.

    ``text`` is the request as it arrived and ``problem`` why it cannot be answered, if so.
    ``scenario_id`` identifies a request by its content: equal requests have equal answers.
    """
    fields = StructType([*schemas.REQUEST.fields, StructField("broken", StringType())])
    read = F.from_json("value", fields, {"columnNameOfCorruptRecord": "broken"})
    filled = "trim(coalesce(request.{}, '')) <> ''"
    problem = F.expr(
        "CASE WHEN request IS NULL OR request.broken IS NOT NULL THEN 'Not a JSON request' "
        f"WHEN NOT {filled.format('division')} THEN 'No division' "
        f"WHEN NOT {filled.format('user')} THEN 'No user' END"
    )
    return (
        lines.where("trim(value) <> ''")
        .withColumn("request", read)
        .select(
            F.sha2("value", 256).alias("scenario_id"), F.col("value").alias("text"),
            problem.alias("problem"), *[f"request.{n}" for n in schemas.REQUEST.names],
        )
    )


def numbered_requests(requests: DataFrame) -> DataFrame:
    """The distinct requests without problem, with a number as ``scenario_id``; to be settled.

    The key of a request, which no table compresses, becomes ``request_id``: it stays here, and
    what is worked out about a request goes by its number. Equal requests are found by their
    text alone, which is parsed where it arrives, so nothing but texts is exchanged.
    """
    lines = requests.select(F.col("text").alias("value")).distinct()
    return (
        parse_requests(lines).where("problem IS NULL").drop("problem", "text")
        .withColumnRenamed("scenario_id", "request_id")
        .withColumn("scenario_id", F.monotonically_increasing_id())
    )


def split_requests(
    requests: DataFrame, numbered: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scenario, planned project and planned head count tables of the requests without problem.

    With ``numbered``, the requests are settled ``numbered_requests``, and scenarios keep their key.
    """
    if numbered:
        keyed, key = requests, ["request_id"]
    else:
        keyed, key = requests.where("problem IS NULL").dropDuplicates(["scenario_id"]), []
    scenarios = keyed.select("scenario_id", "division", F.col("user").alias("user_id"), *key)
    projects = keyed.select("scenario_id", "division", F.inline("data_Prj"))
    headcount = keyed.select("scenario_id", F.inline("data_HC")).drop("save_time", "user_id")
    return scenarios, projects, headcount


def scenario_rows(
    spark: SparkSession, division: str, user: str, projects: list[dict], headcount: list[dict]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of one scenario given as literal rows, as a script holds them."""

    def text(rows: list[dict], schema: StructType) -> list[tuple]:
        return [
            tuple(None if row.get(n) is None else str(row[n]) for n in schema.names)
            for row in rows
        ]

    fields = schemas.REQUEST["data_Prj"].dataType.elementType
    heads = schemas.REQUEST["data_HC"].dataType.elementType
    one = [("0", None, division, user, text(projects, fields), text(headcount, heads))]
    return split_requests(spark.createDataFrame(one, StructType([
        StructField("scenario_id", StringType()), StructField("problem", StringType()),
        *schemas.REQUEST.fields,
    ])))
