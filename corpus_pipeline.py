"""From raw documents to training shards, stage by stage.

Each stage gets the documents that the one before it kept, written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffcast.llm import decontaminate, mixing, near_copies, quality, sharding
from staffcast.llm.common import settle, table

#: No SQL can train the classifier or hash the shingles.
ORACLE_SQL = None


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the highest grade is high enough."""
    model = quality.fit_ratings(docs, quality.ratings_of(table(spark, sf_dir, "labels")))
    return quality.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans they share with benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order.

    Documents without an id or with one id draw each for itself.
    """
    # Columns named like those of the operator are kept under another name meanwhile.
    kept = {c: f"_kept_{c}" if c in mixing.ADDED else c for c in docs.columns}
    drawn_by = "_drawn_by"
    while drawn_by in kept.values():
        drawn_by += "_"
    drawn = mixing.told_apart(docs.withColumnsRenamed(kept), drawn_by)
    mixed = mixing.mixed(drawn, key=drawn_by)
    return mixed.select(*[F.col(f"`{own}`").alias(c) for c, own in kept.items()])


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, shards nearly equal in bytes."""
    return sharding.shard_rows(docs, sharding.text_bytes("text"), ["doc_id"])


STAGES = [
    ("quality classifier", select_quality),
    ("near copies", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
