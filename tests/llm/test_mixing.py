from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from cases import awkward, empty

from staffcast.llm import mixing


def uniform(*parts):
    digits = hashlib.md5("/".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:13]
    return int(digits, 16) / 16**13


def plain_count(rate, key, seed=mixing.SEED):
    """Poisson count by summing chances until they pass the point."""
    pieces = max(1, math.ceil(rate / mixing.PIECE_RATE))
    mean, total = rate / pieces, 0
    for i in range(pieces):
        u, p, k = uniform(seed, key, i), math.exp(-mean), 0
        below = p
        while below <= u:
            k += 1
            p *= mean / k
            below += p
        total += k
    return total


def test_weights_and_counts(spark):
    rows = [(i, "x" * (1 + i % 5), f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("s0", 6.0), ("s1", 1.0)], "source string, weight double")
    got = mixing.mixed(docs, weights=weights).collect()
    size = {s: sum(len(t) for _, t, x in rows if x == s) for s in ("s0", "s1", "s2")}
    rates = {"s0": 6 / 7 * sum(size.values()) / size["s0"], "s1": 1 / 7 * sum(size.values()) / size["s1"], "s2": 0}
    expected = Counter({i: plain_count(round(rates[s], 9), i) for i, _, s in rows})
    assert Counter(r.doc_id for r in got) == +expected
    assert all(r.rate == pytest.approx(rates[r.source], abs=1e-8) for r in got)
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    bytes_ = Counter()
    for r in got:
        bytes_[r.source] += len(r.text)
    assert bytes_["s0"] / sum(bytes_.values()) == pytest.approx(6 / 7, abs=0.02)


def test_a_high_rate_is_not_cut(spark):
    rows = [(0, "x", "small")] + [(i, "y" * 100, "large") for i in range(1, 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("small", 1.0), ("large", 99.0)], "source string, weight double")
    small = [r for r in mixing.mixed(docs, weights=weights).collect() if r.source == "small"]
    rate = round(0.01 * 19_901, 9)
    assert len(small) == plain_count(rate, 0) and abs(len(small) - rate) < 5 * rate**0.5
    assert sorted(r["copy"] for r in small) == list(range(len(small)))


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.mixed(docs).collect()
    rates = {r.source: r.rate for r in got}
    expected = Counter()
    for r in docs.collect():
        if r.source in rates:
            expected[r.doc_id, r.text] += plain_count(rates[r.source], r.doc_id)
    assert Counter((r.doc_id, r.text) for r in got) == +expected
    assert None in rates
    assert mixing.mixed(empty(spark)).collect() == []
