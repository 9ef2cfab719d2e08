"""Scores a folder of requests as files arrive.

Each micro-batch of JSON requests is answered by one batch job against the same unit
rates and project history. Answers and refusals are written per batch number, so a batch
that is repeated after a failure replaces its own output; what a batch settled is removed
when it is written. Every request is in the answers or, with its whole text, in the refusals.

A request that comes again, in the same batch or a later one, is not worked out again: the
query remembers the digests of the texts it has seen, and the first answer stands. Digests are
forgotten after a given time, so the state does not grow without bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from staffcast.operators.spread import scratch, settle
from staffcast.plans import records, report
from staffcast.sources.readers import parse_requests, split_requests


def score_request_folder(
    spark: SparkSession,
    fact: DataFrame,
    requests: str,
    answers: str,
    refusals: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    remembered: str = "30 days",
) -> StreamingQuery:
    """Start the query over what the folder holds now, and stop when it is answered."""
    units, history = report.prepare_units(fact), report.prepare_history(fact)

    def answer(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            asked = settle(parse_requests(batch), "requests")
            scored, refused = report.answer_requests(asked, units, history)
            scored.write.mode("overwrite").parquet(f"{answers}/batch={number}")
            refused.write.mode("overwrite").parquet(f"{refusals}/batch={number}")

    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(requests)
    first = (
        stream.withColumns({"seen": F.current_timestamp(), "digest": F.sha2("value", 256)})
        .withWatermark("seen", remembered)
        .dropDuplicatesWithinWatermark(["digest"])
        .select("value")
    )
    return (
        first.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
