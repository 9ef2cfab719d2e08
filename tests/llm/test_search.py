from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from staffcast.llm import search
from staffcast.llm.queries import QUERIES


def brute(rows, queries, count):
    out = {}
    for q, v in rows:
        if q in queries:
            found = sorted((-float(np.sum(np.array(v) * np.array(w))), i) for i, w in rows if i != q)
            out[q] = [i for _, i in found[:count]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append(r[2])
    return out


def test_recall_and_scores(spark):
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    vectors = dict(rows)
    expected = brute(rows, {i for i in vectors if i % 20 == 0}, 20)
    got = QUERIES["op9_nearest"](spark, SMALL)
    near = found(got)
    assert sorted(near) == sorted(expected) and all(len(x) == min(20, len(rows) - 1) for x in near.values())
    assert np.mean([len(set(near[q]) & set(expected[q])) / 20 for q in expected]) >= 0.9
    for r in got.collect():
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)


@pytest.mark.parametrize("n", [8_000, 16_000, 32_000])
def test_few_vectors_are_verified(n, capsys):
    """Recall and the share of verified vectors, for random vectors of one length."""
    draw = np.random.default_rng(n)
    vectors = draw.normal(size=(n, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    part = search.Part.build([np.array([i]) for i in range(n)], vectors, 1.0)
    hits = []
    for q in range(0, n, n // 50):
        got = {i for i, _ in part.nearest(q, vectors[q], 20)}
        products = vectors @ vectors[q]
        products[q] = -2
        hits.append(len(got & set(np.argsort(-products)[:20].tolist())) / 20)
    share = part.verified / (len(hits) * n)
    with capsys.disabled():
        print(f"[{n} vectors: recall {np.mean(hits):.3f}, verified {share:.3f}]", end=" ")
    assert np.mean(hits) >= 0.95 and share < 0.42


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string, part int, v string")


def test_parts_and_blocks_find_the_same(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).tolist(), "x", 1, "y") for i in range(400)]
    monkeypatch.setattr(search, "THRESHOLD", 0.0)
    monkeypatch.setattr(search, "PART_ROWS", 90)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    got = found(search.nearest(frame(spark, rows), F.col("id") % 20 == 0, count=5))
    single = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows]
    assert got == brute(single, {i for i, *_ in rows if i % 20 == 0}, 5)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None),
        (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (20, [-1.0, 0.5]), (40, None), (60, [0.0, 0.0]),
        (None, [1.0, 0.0]), (80, [1.0, 2.0, 3.0]), (100, [1e-30, 0.0]), (9, []), (20, [-1.0, 0.5]),
    ]
    got = found(search.nearest(frame(spark, [(*r, "x", 1, "y") for r in rows]), F.col("id") % 20 == 0, count=3))
    # Equal products go by id; vectors of another length are apart and find nothing.
    assert got == {0: [1, 2, 3], 20: [100, 0, 1], 100: [0, 1, 2]}
    assert search.nearest(frame(spark, []), F.col("id") % 20 == 0).collect() == []


def test_many_equal_vectors(spark):
    rows = [(i, [0.5, 0.5, 0.1], "x", 1, "y") for i in range(3000)] + [(5000, [0.1, 0.2, 0.9], "x", 1, "y")]
    got = found(search.nearest(frame(spark, rows), F.col("id") % 1000 == 0, count=4))
    assert got[0] == [1, 2, 3, 4] and got[1000] == [0, 1, 2, 3] and got[5000] == [0, 1, 2, 3]


def test_a_third_of_equal_rows_hides_no_neighbour(spark):
    """Equal or nearly equal vectors that cross early do not end the search."""
    draw = np.random.default_rng(4)

    def beside(v, product, n):
        other = draw.normal(size=(n, 32))
        other -= np.outer(other @ v, v)
        return product * v + np.sqrt(1 - product**2) * other / np.linalg.norm(other, axis=1)[:, None]

    group = np.eye(32)[0]
    queries = beside(group, 0.5, 20)
    near = np.concatenate([beside(q, 0.55, 20) for q in queries])
    rest = draw.normal(size=(2400, 32))
    rest *= draw.uniform(0.3, 1, size=(2400, 1)) / np.linalg.norm(rest, axis=1)[:, None]
    for noise in (0.0, 1e-3):
        copies = group + noise * draw.normal(size=(1600, 32))
        rows = [(i, v.tolist(), "x", 1, "y") for i, v in enumerate([*queries, *copies, *near, *rest])]
        got = found(search.nearest(frame(spark, rows), F.col("id") < 20))
        single = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows]
        expected = brute(single, set(range(20)), 20)
        assert np.mean([len(set(got[q]) & set(expected[q])) / 20 for q in expected]) > 0.99


def test_ids_of_equal_vectors(spark):
    rows = [(i, [1.0, float(i % 3)], "x", 1, "y") for i in range(200)]
    got = found(search.nearest(frame(spark, rows), F.col("id").isin(5, 198), count=70))
    twos, ones = (list(range(k, 200, 3)) for k in (2, 1))
    assert got[5] == [*[i for i in twos if i != 5], *ones][:70]
    assert got[198] == list(range(70))
