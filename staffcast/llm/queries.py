"""The queries of the operators over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffcast.llm import (
    audit,
    chat,
    decontaminate,
    language,
    language_model,
    main_text,
    mixing,
    near_copies,
    quality,
    search,
    sharding,
    variants,
    warc,
)
from staffcast.llm.common import held_out, table


def op1_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from its archive, in the merged capture history.

    The pages have no capture times; a page is taken as captured at its id in seconds.
    """
    pages = table(spark, sf_dir, "pages")
    at = F.timestamp_seconds(F.coalesce("page_id", F.lit(0)))
    history = warc.capture_history(pages, captured=at)
    return history.select(
        F.col("key").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
        "url_key",
        "capture_rank",
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in windows of benchmark items."""
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), listed=False
    )
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from two thirds of them."""
    training = ~held_out("doc_id", 3, 1)
    found = language.identify(table(spark, sf_dir, "documents"), training)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "lang_pred", "score")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the conversations as read back from the template."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok")
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        hard.alias("text"),
    )
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    records = rows.unionByName(added).select("conv_id", "turn", record.alias("record"))
    turns = chat.canonical_turns(records, "record", ["conv_id", "turn"])
    return chat.read_back(chat.segments(turns), "conv_id", ["turn", "part"])


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document, learned from six sevenths of them."""
    found = language_model.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2))
    return found.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of each document and whether it is selected."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_ratings(docs, quality.ratings_of(table(spark, sf_dir, "labels")))
    return quality.graded(docs, model, ["doc_id"]).select(
        "doc_id",
        F.round("expected_grade", 6).alias("expected_grade"),
        F.round("tail", 6).alias("good_probability"),
        (F.col("tail") >= quality.KEEP_AT).alias("selected"),
    )


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = near_copies.near_copies(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        near_copies.hex_fingerprint(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, repeated to the target weights of their sources and shuffled.

    Documents without an id or with a shared one draw each for itself.
    """
    docs = mixing.told_apart(table(spark, sf_dir, "documents"), "drawn_by")
    found = mixing.mixed(docs, key="drawn_by").withColumn("rate", F.round("rate", 6))
    return found.drop("drawn_by")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every twentieth one."""
    found = search.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, shards nearly equal in bytes."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.text_bytes("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    placed = sharding.shard_rows(docs, F.col("size"), ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the frequent word that each is a variant of.

    One in 31 runs of a document, chosen by a hash of id and run, loses a letter first.
    """
    runs = variants.letter_runs(table(spark, sf_dir, "documents"), variants.MIN_LENGTH)
    own = F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), "run")
    drawn = runs.withColumn("h", F.crc32(own)).withColumn("at", F.expr("int(h % length(run))"))
    cut = F.expr("concat(left(run, at), substr(run, at + 2))")
    words = drawn.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return variants.variants(variants.word_counts(words))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at every step of their 120 orders, by language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_captures, op2_decontamination, op3_language, op4_chat, op5_language_model,
        op6_quality, op7_near_copies, op8_mixing, op9_nearest, op10_sharding,
        op11_variants, op12_filter_audit, op13_main_text,
    )
}
