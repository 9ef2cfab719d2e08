from __future__ import annotations

import random
from collections import Counter

import xxhash
from cases import LONG, awkward, empty
from conftest import SMALL
from pyspark.sql import functions as F

from staffcast.llm import near_copies
from staffcast.llm.queries import QUERIES


def plain_fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64(p, seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def plain_components(fingerprints, limit):
    """Component of each (id, fingerprint) by comparing all pairs."""
    parent = list(range(len(fingerprints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j][1]).bit_count() <= limit:
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(fingerprints):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(fingerprints))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    marks = [(d.doc_id, plain_fingerprint(d.text)) for d in docs]
    parts = plain_components(marks, 2)
    expected = {k: (f"{fp:016x}", c) for (k, fp), c in zip(marks, parts, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_near_copies"](spark, SMALL).collect()}
    assert got == expected


def test_links_equal_all_pairs(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(30)]
    marks = set(base)
    for b in base[:12]:
        for _ in range(60):
            x = b
            for bit in draw.sample(range(64), draw.randint(1, 4)):
                x ^= 1 << bit
            marks.add(x)
    marks = sorted(near_copies._signed(m) for m in marks)
    df = spark.createDataFrame([(m,) for m in marks], "fp bigint")
    got = Counter((r.a, r.b) for r in near_copies.linked(df).collect())
    expected = {
        (a, b) for i, a in enumerate(marks) for b in marks[i + 1:]
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    }
    assert set(got) == expected
    assert max(got.values()) == 1  # every pair under one key only


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    roots = {r.node: r.root for r in near_copies.components(pairs).collect()}
    assert roots == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    marks = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    expected = Counter(
        (k, f"{fp:016x}", c) for (k, fp), c in zip(marks, plain_components(marks, 2), strict=True)
    )
    found = near_copies.near_copies(docs).select("doc_id", near_copies.hex_fingerprint(F.col("fp")).alias("h"), "component")
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert near_copies.near_copies(empty(spark)).collect() == []


def test_a_text_in_pieces_has_one_fingerprint(monkeypatch):
    text = ("one two three four five six seven eight nine ten " * 50).encode()
    whole = near_copies.fingerprint(text)
    monkeypatch.setattr(near_copies, "lower_words", lambda t: ([w] for w in t.split()))
    assert near_copies.fingerprint(text) == whole == plain_fingerprint(text.decode())
    assert near_copies.fingerprint(b"two words") == plain_fingerprint("two words")


def test_one_of_each_keeps_one_document(spark):
    docs = awkward(spark)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    named = Counter(r.doc_id for r in kept.collect() if r.doc_id is not None)
    # 7 differs from 1 in capitals only; 3 and the null texts have no words like 2.
    assert named == {1: 1, 2: 1, 4: 1, 5: 1, 6: 1, 8: 1}
    assert near_copies.one_of_each(empty(spark)).count() == 0
    assert LONG in {r.text for r in kept.collect()}
