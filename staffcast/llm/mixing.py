"""Mixing sources to target weights by Poisson replication.

A source with target weight ``w`` of all weights and ``b`` of all ``B`` bytes gets the mean
repetition rate ``r = w / sum(w) * B / b``. Each document is repeated as often as a Poisson
distribution of that mean says at a point that a hash of seed and document gives, found by
inverting the distribution; the copies are put in the order of another hash.

A rate above ``PIECE_RATE`` is split into several equal ones whose counts add up, which is
the same distribution, so any rate is exact and none is cut. Everything is DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffcast.llm.common import settle

SEED = 17
#: The weight of a source is its bytes to this power, unless weights are given.
ALPHA = 0.5
PIECE_RATE = 8
#: Values of a piece whose distribution is tabled: for mean 8 the rest is below 1e-30.
VALUES = 64
HEX_DIGITS = 13
#: Columns that the operator adds; document columns of these names give way.
ADDED = ("copies", "copy", "rate", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts, joined by slashes."""
    text = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws("/", *text)), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**HEX_DIGITS))


def source_rates(docs: DataFrame, source: str, text: str, weights: DataFrame | None) -> DataFrame:
    """(source, rate, pieces, cdf): one row per source, null a source of its own.

    ``weights`` has the columns source and weight; a source not in it has weight 0. Without
    it weights follow the bytes to the power ``ALPHA``. A source without bytes has rate 1.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0))
    bytes_ = docs.groupBy(F.col(f"`{source}`").alias("_source")).agg(F.sum(size).alias("_bytes"))
    if weights is None:
        weighted = bytes_.withColumn("_weight", F.pow("_bytes", F.lit(ALPHA)))
    else:
        given = weights.select(F.col("source").alias("_given"), F.col("weight").alias("_weight"))
        weighted = bytes_.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left").select(
            "_source", "_bytes", F.coalesce("_weight", F.lit(0)).cast("double").alias("_weight")
        )
    weighted = settle(weighted, "weights")
    all_bytes, all_weights = weighted.where("_bytes > 0").agg(
        F.sum("_bytes"), F.sum(F.round("_weight", 6))
    ).first()
    share = F.round("_weight", 6) / F.lit(float(all_weights or 1))
    rate = F.when(F.col("_bytes") == 0, 1.0).otherwise(share * F.lit(float(all_bytes or 0)) / F.col("_bytes"))
    rated = weighted.select("_source", F.round(rate, 9).alias("_rate"))
    pieces = rated.withColumn("_pieces", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PIECE_RATE)).cast("int"))
    mean = F.col("_rate") / F.col("_pieces")
    term = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    filled = F.aggregate(
        F.sequence(F.lit(1), F.lit(VALUES - 1)), term,
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            F.array_append(a["cdf"], F.element_at(a["cdf"], -1) + a["p"] * mean / k).alias("cdf"),
        ),
    )
    return pieces.withColumn("_cdf", filled["cdf"])


def told_apart(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows with a column ``name`` to draw by, another for every row.

    It is the key where only one row has it. Rows without a key or with a shared one add a
    digest of source and text and their number among the rows equal in all three. Numbers
    are counted within the partitions of the settled rows and go on from one to the next,
    so no task gets all of many equal rows.
    """
    if name in docs.columns:
        raise ValueError(f"the documents have a column {name}")
    own, part = F.col(f"`{key}`").cast("string"), F.shiftright("_place", 33)
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in (key, source, text)]
    digest = F.md5(F.concat_ws("/", *[F.length(p).cast("string") for p in parts], *parts))
    placed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept"),
        F.monotonically_increasing_id().alias("_place"), own.alias("_own"), digest.alias("_digest"),
    )
    placed = settle(placed, "places")
    shared = placed.where("_own IS NOT NULL").groupBy("_own").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = placed.select("_place", "_own", "_digest")
    rows = rows.where("_own IS NULL").union(rows.join(shared, "_own", "left_semi").select(*rows.columns))
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy("_digest", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_digest").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_digest", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_digest", "_part").orderBy("_place")) - 1
    numbered = rows.withColumn("_nth", nth).join(counts, ["_digest", "_part"]).select(
        F.col("_place").alias("_at"), (F.col("_before") + F.col("_nth")).alias("_number")
    )
    # Settled, so that where few rows need a number the texts are not shuffled to get it.
    numbered = settle(numbered, "numbers")
    apart = F.concat_ws("/", F.coalesce("_own", F.lit("null")), "_digest", F.col("_number").cast("string"))
    drawn = F.when(F.col("_number").isNull(), F.col("_own")).otherwise(apart)
    joined = placed.join(numbered, F.col("_place") == F.col("_at"), "left")
    return joined.select("_kept.*", drawn.alias(name))


def replicated(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    weights: DataFrame | None = None, seed: int = SEED,
) -> DataFrame:
    """Every document as often as drawn, with ``copies``, ``copy`` (from 0), ``rate`` and ``shuffle_key``.

    Rows with one key draw alike, also all rows without a key, whatever their texts;
    ``told_apart`` makes a key that every row has for itself. Null sources form one source, null texts have no
    bytes. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ADDED]
    rates = settle(source_rates(docs, source, text, weights), "rates")
    # The documents are one column meanwhile, so their names cannot clash with others.
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_kept"),
        F.col(f"`{key}`").alias("_own"), F.col(f"`{source}`").alias("_from"),
    )
    joined = held.join(rates, F.col("_from").eqNullSafe(F.col("_source")), "left")
    points = F.transform(
        F.sequence(F.lit(0), F.col("_pieces") - 1), lambda i: uniform(F.lit(seed), F.col("_own"), i)
    )
    drawn = F.aggregate(
        points, F.lit(0), lambda n, u: n + F.size(F.filter("_cdf", lambda c: c <= u))
    )
    counted = joined.withColumn("copies", drawn).where("copies > 0")
    copies = counted.select(
        "_kept", "_own", "copies", F.col("_rate").alias("rate"),
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
    )
    shuffle_key = uniform(F.lit(seed), F.lit("order"), F.col("_own"), F.col("copy"))
    return copies.select("_kept.*", "copies", "rate", "copy", shuffle_key.alias("shuffle_key"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The replicated documents in the order of their shuffle keys, over all partitions."""
    key = options.get("key", "doc_id")
    return replicated(docs, **options).orderBy("shuffle_key", key, "copy")
