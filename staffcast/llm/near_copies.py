"""Near copies by SimHash, found with tables of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to a fixed set of references. By
the triangle inequality the distances of two fingerprints to one reference differ by at
most their own distance, so a pair whose largest coordinate difference is above the limit
is discarded before its bits are compared.

Two kinds of references are used. *Near* references differ from one base fingerprint in a
single bit; whether such a reference is nearer than the base tells that bit. Their
distances, taken by blocks, form the join keys: with at most ``limit`` differing bits in
``limit + 4`` blocks, at least four blocks have equal distances, and the pair meets under
a key of four blocks. *Far* references are random fingerprints; their distances are the
coordinates that discard pairs. Survivors are verified bit by bit.

Pairs are formed between distinct fingerprints only, and every pair under the first key
it shares, so copies are never expanded and no group is emitted as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffcast.llm.common import lower_words, settle, utf8

SHINGLE_WORDS = 3
LIMIT = 2
#: XXH64 seed of the shingles.
SEED = 42
BITS = 64
#: Blocks whose distances are equal under one join key.
SAME_BLOCKS = 4
FAR_REFERENCES = 12
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a text: bit set where over half of the shingle hashes have it set."""
    ones, count = np.zeros(BITS, np.int64), 0
    tail: list[bytes] = []
    for words in lower_words(text):
        words = tail + words
        tail = words[len(words) - min(len(words), shingle - 1):] if shingle > 1 else []
        if len(words) < shingle:
            tail = words
            continue
        runs = zip(*(words[i:] for i in range(shingle)), strict=False)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)),
            np.uint64, len(words) - shingle + 1,
        )
        count += len(hashes)
        for i in range(0, len(hashes), CHUNK):
            part = hashes[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not count:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp): the fingerprint of every text as a signed 64-bit number; null texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t, shingle) for t in utf8(batch.column(1))), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"]
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(run, f"key {kind}, fp bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def reference_fingerprints(far: int = FAR_REFERENCES) -> tuple[int, list[int], list[int]]:
    """The base, the near references (base with one bit turned) and the far ones."""
    random = Random(20)
    base = random.getrandbits(BITS)
    return base, [base ^ (1 << b) for b in range(BITS)], [random.getrandbits(BITS) for _ in range(far)]


def _distance(fp: Column, reference: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(reference))))


def pivot_table(distinct: DataFrame, limit: int) -> DataFrame:
    """The fingerprints with block keys from near and coordinates from far references."""
    base, near, far = reference_fingerprints()
    fp, blocks = F.col("fp"), limit + SAME_BLOCKS
    to_base = _distance(fp, base)
    keys = []
    for block in range(blocks):
        bits = range(block * BITS // blocks, (block + 1) * BITS // blocks)
        nearer = [
            F.when(_distance(fp, near[b]) < to_base, F.lit(1 << i)).otherwise(F.lit(0))
            for i, b in enumerate(bits)
        ]
        keys.append(reduce(lambda a, b: a + b, nearer).cast("bigint").alias(f"b{block}"))
    coordinates = [_distance(fp, r).cast("smallint").alias(f"d{i}") for i, r in enumerate(far)]
    return distinct.select("fp", *keys, *coordinates)


def linked(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most ``limit`` bits."""
    blocks = limit + SAME_BLOCKS
    choices = list(combinations(range(blocks), SAME_BLOCKS))
    width = BITS // blocks + 1
    pivots = settle(pivot_table(distinct, limit), "pivots")
    # The blocks of a choice side by side; four blocks of eleven bits fit one number.
    packed = [
        reduce(lambda a, b: F.shiftleft(a, width).bitwiseOR(b), [F.col(f"b{i}") for i in choice])
        for choice in choices
    ]
    far = [f"d{i}" for i in range(FAR_REFERENCES)]
    keyed = pivots.select("fp", *far, F.posexplode(F.array(*packed)).alias("choice", "block_key"))
    left = keyed.select(*[F.col(c).alias(f"l_{c}") for c in keyed.columns])
    right = keyed.select(*[F.col(c).alias(f"r_{c}") for c in keyed.columns])
    bits = F.col("l_fp").bitwiseXOR(F.col("r_fp"))
    within = [F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) <= limit for c in far]
    # Only the first choice whose blocks are all equal reports the pair.
    masks = []
    for choice in choices:
        mask = sum(
            ((1 << ((b + 1) * BITS // blocks)) - (1 << (b * BITS // blocks))) for b in choice
        )
        masks.append(F.lit(_signed(mask)))
    first = reduce(
        lambda rest, i: F.when(bits.bitwiseAND(masks[i]) == 0, F.lit(i)).otherwise(rest),
        reversed(range(len(choices))), F.lit(-1),
    )
    condition = [
        F.col("l_choice") == F.col("r_choice"),
        F.col("l_block_key") == F.col("r_block_key"),
        F.col("l_fp") < F.col("r_fp"),
        *within,
        F.bit_count(bits) <= limit,
        F.col("l_choice") == first,
    ]
    pairs = left.join(right, reduce(lambda a, b: a & b, condition))
    return pairs.select(F.col("l_fp").alias("a"), F.col("r_fp").alias("b"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the pairs is connected with.

    Every round passes the smallest known label along the edges, to the node that was the
    label so far, and then jumps to the label of the label. Labels only sink, so their sum
    tells when a round changed nothing.
    """
    edges = settle(
        pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).toDF("node", "other"),
        "edges",
    )
    labels = settle(
        edges.groupBy("node").agg(F.min("other").alias("other"))
        .select("node", F.least("node", "other").alias("root")), "labels",
    )
    total = F.sum(F.col("root").cast("decimal(38,0)"))
    before, now = None, labels.agg(total).first()[0]
    while now != before:
        passed = edges.join(labels.toDF("other", "near"), "other").groupBy("node").agg(
            F.min("near").alias("near")
        )
        offers = labels.join(passed, "node").select("node", "root", F.least("root", "near").alias("low"))
        offers = settle(offers, "offers")
        sunk = (
            offers.select("node", "low").union(offers.select("root", "low"))
            .groupBy("node").agg(F.min("low").alias("root"))
        )
        sunk = settle(sunk, "sunk")
        jumped = sunk.join(sunk.toDF("root", "next"), "root").select("node", F.col("next").alias("root"))
        labels = settle(jumped, "labels")
        before, now = now, labels.agg(total).first()[0]
    return labels


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE_WORDS, limit: int = LIMIT,
) -> DataFrame:
    """One row per document: (key, fp, component), component the smallest key reachable.

    Null and wordless texts have fingerprint 0 and are linked like any other; repeated
    rows stay. A null key is never the smallest unless a component has no other; the
    component is then null. An empty table gives an empty result.
    """
    marked = settle(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = settle(marked.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    pairs = settle(linked(distinct.select("fp"), limit), "links")
    roots = components(pairs)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = settle(rooted, "rooted")
    least = settle(rooted.groupBy("root").agg(F.min("least").alias("component")), "least")
    named = settle(rooted.select("fp", "root").join(least, "root").select("fp", "component"), "named")
    return marked.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: a row whose key is the component.

    Of rows with that key the first by text and the other columns stays, of equal rows one.
    Documents without a key cannot be named, and stay.

    The texts are filtered by the keys of what goes, which are fewer than the documents;
    only the rows of keys that occur more than once are grouped.
    """
    found = near_copies(docs, key, text)
    own = F.col(f"`{key}`")
    marked = found.where(own.isNotNull()).groupBy(own.alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(own.eqNullSafe(F.col("component"))).alias("_kept")
    )
    other = settle(marked.where("_n > 1 OR NOT _kept"), "copies")
    # The documents are one column meanwhile, so their names cannot clash with others.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), own.alias("_own"))
    single = held.join(other.select("_key"), F.col("_own") == F.col("_key"), "left_anti")
    again = other.where("_n > 1 AND _kept").select("_key")
    firsts = held.join(again, F.col("_own") == F.col("_key"), "left_semi").groupBy("_own").agg(
        F.min_by("_row", F.struct(F.col("_row").getField(text), F.col("_row"))).alias("_row")
    )
    return single.select("_row.*").unionByName(firsts.select("_row.*"))
