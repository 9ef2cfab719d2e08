"""Writers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffcast.operators.projects import purge_user
from staffcast.plans.records import as_records
from staffcast.sources.readers import partition_columns


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """CSV with a header, as many files as the table has parts."""
    df.write.mode("overwrite").csv(path, header=True)


def write_records(df: DataFrame, path: str) -> None:
    """JSON records, one per line."""
    as_records(df).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_log_jdbc(rows: DataFrame, options: dict[str, str], table: str) -> None:
    rows.write.format("jdbc").options(**options).option("dbtable", table).mode("append").save()


def purge_user_table(table: DataFrame, user_id, target: str) -> None:
    """Write the table without one user's rows to a new place, which then replaces it."""
    purge_user(table, user_id).write.mode("errorifexists").parquet(target)


#: Files that one job of a purge writes anew.
PURGED_AT_ONCE = 1000


def purge_user_files(spark: SparkSession, path: str, user_id) -> list[str]:
    """Take one user's rows out of a Parquet table in place; gives the files that held some.

    Only these files are read whole, written anew and replaced; the others stay untouched. The
    filter finds them by the statistics of their row groups where the table is sorted by
    user. The new files are complete in a hidden folder of the table before an old one goes;
    a purge that was broken off is finished by the next one.
    """
    _finish_purges(spark, path)
    table = spark.read.parquet(path)
    held = table.where(F.col("user_id") == user_id).select(F.col("_metadata.file_path").alias("file"))
    purged = [r["file"] for r in held.distinct().collect()]
    folders = partition_columns(spark, path)
    for start in range(0, len(purged), PURGED_AT_ONCE):
        files = purged[start:start + PURGED_AT_ONCE]
        staged = f"{path}/_purge-{uuid.uuid4().hex}"
        rows = spark.read.option("basePath", path).schema(table.schema).parquet(*files)
        kept = purge_user(rows, user_id)
        writer = kept.repartition(*folders).write.partitionBy(*folders) if folders else kept.write
        writer.parquet(f"{staged}/new")
        old = spark.createDataFrame([(f,) for f in files], "file string")
        old.coalesce(1).write.parquet(f"{staged}/old")
        _finish_purges(spark, path)
    return purged


def _finish_purges(spark: SparkSession, path: str) -> None:
    """Replace old files by the new ones of every complete purge, and forget incomplete ones.

    Old files go first, so a reader sees rows at most once; every step can be repeated.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(conf)
    for purge in [s.getPath() for s in files.listStatus(at(path)) if s.getPath().getName().startswith("_purge-")]:
        if files.exists(at(purge, "old/_SUCCESS")):
            for row in spark.read.parquet(at(purge, "old").toString()).collect():
                files.delete(at(row["file"]), False)
            new = at(purge, "new")
            for file in list(_data_files(files, new)):
                folder = file.getParent().toString().removeprefix(files.makeQualified(new).toString())
                target = at(f"{path}{folder}")
                files.mkdirs(target)
                files.rename(file, at(target, file.getName()))
        files.delete(purge, True)


def _data_files(files, folder) -> Iterator:
    found = files.listFiles(folder, True)
    while found.hasNext():
        file = found.next().getPath()
        if file.getName().startswith("part-"):
            yield file
