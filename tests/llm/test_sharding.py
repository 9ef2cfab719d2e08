from __future__ import annotations

import hashlib
from collections import Counter

from cases import awkward, empty
from pyspark.sql import functions as F

from staffcast.llm import sharding
from staffcast.llm.sharding import shard_rows, text_bytes


def number_of(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def brute(rows, shards):
    """Shard by bytes before each row in the order of the keys; rows are (key text, size)."""
    order = sorted(rows, key=lambda r: number_of(r[0]))
    total, before, out, slots = sum(s for _, s in rows), 0, {}, Counter()
    for key, size in order:
        shard = shards * before // total
        out[key] = (shard, slots[shard])
        slots[shard] += 1
        before += size
    return out


def test_equals_brute_force(spark):
    rows = [(i, 1 + (i * 7919) % 97) for i in range(997)]
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint").repartition(5)
    got = {str(r.doc_id): (r.shard, r.slot) for r in shard_rows(df, F.col("size"), ["doc_id"], 7).collect()}
    assert got == brute([(str(i), s) for i, s in rows], 7)


def test_tolerance_is_kept_and_needs_fewer_digits(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(10).cast("bigint").alias("size"))
    got = shard_rows(df, F.col("size"), ["doc_id"], 4, tolerance=0.02).groupBy("shard").agg(F.sum("size").alias("n"))
    sizes = {r.shard: r.n for r in got.collect()}
    assert sorted(sizes) == [0, 1, 2, 3]
    assert all(abs(n - 50_000) <= 2 * 0.02 * 50_000 for n in sizes.values())


def test_equal_rows_are_spread(spark):
    df = spark.range(900).select(F.lit(5).alias("doc_id"), F.lit(3).cast("bigint").alias("size")).repartition(4)
    got = shard_rows(df, F.col("size"), ["doc_id"], 3).collect()
    assert Counter(r.shard for r in got) == {0: 300, 1: 300, 2: 300}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(300)) for s in range(3))


def test_more_shards_than_rows(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(1).cast("bigint").alias("size"))
    got = shard_rows(df, F.col("size"), ["doc_id"], 8).collect()
    assert len(got) == 3 and all(0 <= r.shard < 8 and r.slot == 0 for r in got)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = shard_rows(docs, text_bytes("text"), ["doc_id"], 2)
    assert [c for c in got.columns if c not in ("shard", "slot")] == [c for c in docs.columns if c not in ("shard", "slot")]
    rows = got.collect()
    assert len(rows) == docs.count()
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert shard_rows(empty(spark), text_bytes("text"), ["doc_id"]).collect() == []


def test_a_hot_key_is_numbered_in_pieces(spark, monkeypatch):
    """A third of the rows without a key, a third with one: no piece holds all of a key."""
    monkeypatch.setattr(sharding, "PIECE_ROWS", 64)
    df = spark.range(0, 12_000, 1, 16).selectExpr(
        "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE id END AS doc_id", "id % 7 + 1 AS size"
    )
    numbered = {}
    kind = type(df)
    with_column = kind.withColumn

    def seen(self, name, column):
        out = with_column(self, name, column)
        if name == "_no":
            numbered["rows"] = out.groupBy("shard", "_piece").count().agg(F.max("count")).first()[0]
        return out

    monkeypatch.setattr(kind, "withColumn", seen)
    rows = shard_rows(df, F.col("size"), ["doc_id"], 5).collect()
    assert numbered["rows"] <= 12_000 / 16
    assert len(rows) == 12_000
    by_shard = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(5)}
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 7
    # Slots follow the order of the keys within a shard.
    for s in range(5):
        order = [number_of("null" if r.doc_id is None else str(r.doc_id)) for r in sorted(rows, key=lambda r: r.slot) if r.shard == s]
        assert order == sorted(order)


def test_clashing_columns_come_through(spark):
    docs = awkward(spark)
    got = shard_rows(docs, text_bytes("text"), ["doc_id"], 2)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    assert Counter(map(tuple, got.select(names).collect())) == Counter(map(tuple, docs.select(names).collect()))
