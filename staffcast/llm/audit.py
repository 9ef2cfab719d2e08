"""How filters of documents interact: what each removes in every order they may run in.

Every document is reduced to the set of filters it fails. Orders are paths through the
lattice of sets of filters that have run: a filter is an edge, and what it removes there
depends on the edge alone, not on the order in which the filters before it ran. Paths
that reach and leave an edge are counted forwards and backwards, which gives the weight of
the edge in the sum over all orders (the Shapley value); the steps of every single order are
read from the same edges.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staffcast.llm.common import settle

SPACES = " \t\n\x0b\f\r"
MOST_FILTERS = 7


def document_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text: short, repetitive, loud, with symbols."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.split(trimmed, f"[{SPACES}]+")
    some = trimmed != ""
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": ~some | (F.size(words) < 200),
        "B": some & (100 * F.size(F.array_distinct(words)) < 50 * F.size(words)),
        "C": 100 * upper > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """Number of orders that reach every set of filters, and that lead on from it to the end."""
    states = 1 << filters
    reaching, leaving = [0] * states, [0] * states
    reaching[0] = leaving[-1] = 1
    for before in range(states):
        for bit in (1 << f for f in range(filters)):
            if not before & bit:
                reaching[before | bit] += reaching[before]
    for before in reversed(range(states)):
        for bit in (1 << f for f in range(filters)):
            if not before & bit:
                leaving[before] += leaving[before | bit]
    return reaching, leaving


def _edges(names: str) -> Column:
    """The edges of the lattice with the number of orders that pass each, as an array."""
    reaching, leaving = path_counts(len(names))
    rows = [
        {"before": before, "bit": 1 << f, "filter": name, "orders": reaching[before] * leaving[before | 1 << f]}
        for before in range(1 << len(names))
        for f, name in enumerate(names)
        if not before >> f & 1
    ]
    kind = "array<struct<before:int,bit:int,filter:string,orders:bigint>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _steps(spark: SparkSession, names: str) -> DataFrame:
    """The edge that every order passes at every step."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, start=1):
            rows.append([before, 1 << f, "".join(names[i] for i in order), step])
            before |= 1 << f
    text = F.lit(json.dumps([dict(zip(("before", "bit", "filter_order", "step"), r)) for r in rows]))
    kind = "array<struct<before:int,bit:int,filter_order:string,step:int>>"
    return spark.range(1).select(F.inline(F.from_json(text, kind)))


def failures(
    docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column], copies: str | None,
    key: str = "doc_id", text: str = "text", part: str = "lang",
) -> DataFrame:
    """Number of documents by part and set of failed filters: (part, fails, n, good, toxic).

    ``conditions`` are failures by the text alone, on a column ``text`` that is never null;
    bit i of ``fails`` is the i-th of them, and the last is ``copies``, the filter that a text
    fails which a document of a smaller key has as well. ``good`` and ``toxic`` count
    the documents that some label of their key calls so. Null texts and parts are empty ones.
    A document without a key has no labels, fails ``copies`` never, and makes no other fail it.

    Only the document of the smallest key of each text passes ``copies``, so the texts need not
    be joined: all documents are counted as failing, and the first of each text is moved.
    """
    spark = docs.sparkSession
    bits = F.lit(0)
    for i, failed in enumerate(conditions.values()):
        bits = bits + F.when(failed, 1 << i).otherwise(0)
    rows = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("fails"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("mark")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    # Rows without a key match no label; a mark of their own keeps them from one task.
    own = F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string"))
    marked = rows.withColumn("mark", F.coalesce(F.col("id").cast("string"), own)).join(marks, "mark", "left")
    seen = settle(
        marked.groupBy(
            "digest", "id", "part", "fails",
            F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
        ).agg(F.count(F.lit(1)).alias("n")),
        "audited_texts",
    )
    kinds = ["part", "fails", "good", "toxic"]
    bit = 1 << len(conditions)
    if copies is None:
        moved = spark.createDataFrame([], seen.select(*kinds, "n").schema)
        counted = seen.select(*kinds, "n")
    else:
        first = (
            seen.where("id IS NOT NULL")
            .groupBy("digest", *kinds)
            .agg(F.min(F.struct("id", "n")).alias("first"))
            .withColumn("least", F.min("first.id").over(W.partitionBy("digest")))
            .where("first.id = least")
            .select(*kinds, F.col("first.n").alias("n"))
        )
        counted = seen.select(
            "part",
            F.when(F.col("id").isNotNull(), F.col("fails") + bit).otherwise(F.col("fails")).alias("fails"),
            "good", "toxic", "n",
        )
        moved = first.unionByName(first.withColumns({"fails": F.col("fails") + bit, "n": -F.col("n")}))
    return (
        counted.unionByName(moved)
        .groupBy("part", "fails")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("good")).alias("good"),
            F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        )
    )


def edge_counts(tally: DataFrame, names: str) -> DataFrame:
    """What every filter does on every edge of the lattice, by part.

    ``before`` is the set of filters that ran before, ``shapley`` what the filter removes
    summed over all orders.
    """
    edges = tally.select("part", "fails", "n", "good", "toxic", F.inline(_edges(names)))
    fails, before, bit = F.col("fails"), F.col("before"), F.col("bit")
    failed, gone = fails.bitwiseAND(bit) != 0, fails.bitwiseAND(before) != 0

    def total(of: str, where: Column, name: str) -> Column:
        return F.sum(F.when(where, F.col(of)).otherwise(0)).alias(name)

    counts = edges.groupBy("part", "before", "bit", "filter", "orders").agg(
        total("n", ~failed & ~gone, "kept"),
        total("n", failed & ~gone, "removed"),
        total("n", failed & gone, "redundant"),
        total("n", fails == bit, "unique_fails"),
        total("good", failed & ~gone, "good_lost"),
        total("toxic", failed & ~gone, "toxic_lost"),
    )
    weighted = F.sum(F.col("removed") * F.col("orders"))
    return counts.withColumn("shapley", weighted.over(W.partitionBy("part", "bit")))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(
    docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column] | None = None,
    copies: str | None = "E", key: str = "doc_id", text: str = "text", part: str = "lang",
) -> DataFrame:
    """One row per part, order of all filters and step, with the counts of the filter at that step.

    The filters are named by one letter each, seven at most. Parts come from the documents;
    without documents there are no rows. See ``failures`` for missing values and repeated
    keys. All other columns of the documents, whatever their names, play no part.
    """
    conditions = document_filters(F.col("text")) if conditions is None else conditions
    names = "".join(conditions) + (copies or "")
    if len(names) > MOST_FILTERS or len(names) != len(conditions) + (copies is not None):
        raise ValueError(f"filters have one letter each, {MOST_FILTERS} at most: {names}")
    tally = failures(docs, labels, conditions, copies, key, text, part)
    # The table of steps only depends on the number of filters: 600 rows for five.
    steps = F.broadcast(_steps(docs.sparkSession, names))
    return edge_counts(tally, names).join(steps, ["before", "bit"]).select(
        "part", "filter_order", "step", *COUNTS
    )
