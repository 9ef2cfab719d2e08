"""Intermediate tables that several later steps read, and steps that run side by side.

Joins are left to Spark. The smaller side of a join with a hot key is settled first, so
both sides are plain exchanges: at run time Spark broadcasts the small one, or splits the
partitions of the hot key into as many tasks as their size asks for.
"""

from __future__ import annotations

import atexit
import contextvars
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)
_SEEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the session names for checkpoints.

    Where none is named, a folder in the warehouse, which all executors share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/settled"


def place(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application.

    The tables of an application lie in one folder, which is removed when its driver ends; see
    ``scratch`` for an earlier end.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/staffcast/{spark.sparkContext.applicationId}"
    if folder not in _SEEN:
        _SEEN.add(folder)
        atexit.register(_remove_at_end, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if (written := _SCRATCH.get()) is not None:
        written.append(path)
    return path


def settle(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    The work behind it is done once, its lineage is cut, it survives lost executors, and
    later joins are planned with its true size. ``compression`` is the one of the session
    where none is given.
    """
    path = place(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        _remove(spark, [folder])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are settled inside the block when it ends.

    What reads them has to be written within the block.
    """
    written: list[str] = []
    outer = _SCRATCH.set(written)
    try:
        yield
    finally:
        _SCRATCH.reset(outer)
        _remove(spark, written)


def at_once(spark: SparkSession, *steps: Callable[[], T]) -> list[T]:
    """Run steps that do not depend on each other at the same time.

    Each step submits its own Spark jobs; small jobs then fill the executors that the
    large ones leave idle.
    """
    carry = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(contextvars.copy_context().run, carry(step)) for step in steps]
        return [step.result() for step in running]


def settle_together(**tables: DataFrame) -> list[DataFrame]:
    """Settle tables that do not depend on each other, at the same time."""
    spark = next(iter(tables.values())).sparkSession
    return at_once(spark, *[partial(settle, df, name) for name, df in tables.items()])
