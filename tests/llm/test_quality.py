from __future__ import annotations

import math

import numpy as np
import pytest
from cases import awkward, empty
from conftest import SMALL

from staffcast.llm import quality
from staffcast.llm.queries import QUERIES


def made(n, seed=1):
    """Texts of three grades: insults, filler, plain words."""
    draw = np.random.default_rng(seed)
    texts, grades = [], []
    for _ in range(n):
        grade = int(draw.integers(0, 3))
        words = [f"word{draw.integers(0, 60)}" for _ in range(int(draw.integers(20, 200)))]
        if grade == 0:
            words[int(draw.integers(0, len(words)))] = "horrid"
        if grade == 1:
            words = words[:10] + ["again"] * 12 + words[10:]
        texts.append(" ".join(words))
        grades.append(grade)
    return texts, np.array(grades)


def chance_of_grades(model, score):
    low = [1 / (1 + math.exp(score - t)) for t in model.thresholds]
    edges = [0.0, *low, 1.0]
    return [b - a for a, b in zip(edges, edges[1:], strict=False)]


def test_grades_of_unseen_texts():
    texts, grades = made(1200)
    found = [quality.features(t.encode()) for t in texts]
    model = quality.fit(found[:800], grades[:800], 3)
    assert np.all(np.diff(model.thresholds) > 0)
    scores = quality.score_texts((t.encode() for t in texts), model)
    guess = [int(np.argmax(chance_of_grades(model, s))) for s in scores[800:]]
    assert np.mean(guess == grades[800:]) > 0.98
    tails = model.tails(scores)
    for s, row in zip(scores[:50], tails, strict=False):
        chances = chance_of_grades(model, s)
        assert row == pytest.approx([sum(chances[1:]), chances[2]])
        assert row.sum() == pytest.approx(sum(i * c for i, c in enumerate(chances)))


def test_fit_raises_the_likelihood_of_a_small_table(monkeypatch):
    texts, grades = made(60, 2)
    found = [quality.features(t.encode()) for t in texts]

    def loss(rounds):
        monkeypatch.setattr(quality, "ROUNDS", rounds)
        model = quality.fit(found, grades, 3)
        scores = quality.score_texts((t.encode() for t in texts), model)
        return -sum(math.log(chance_of_grades(model, s)[g]) for s, g in zip(scores, grades, strict=True))

    assert loss(60) < loss(5) < loss(0)


def test_query_equals_plain_scoring(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit_ratings(docs, quality.ratings_of(spark.read.parquet(f"{SMALL}/labels.parquet")))
    got = {r.doc_id: r for r in QUERIES["op6_quality"](spark, SMALL).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        found = quality.features((r.text or "").encode())
        score = sum(float(model.weights[b]) for b in found) / max(1, len(found)) ** quality.LENGTH_POWER
        chances = chance_of_grades(model, score)
        assert got[r.doc_id].good_probability == pytest.approx(chances[2], abs=2e-5)
        assert got[r.doc_id].expected_grade == pytest.approx(chances[1] + 2 * chances[2], abs=2e-5)
        assert got[r.doc_id].selected == (got[r.doc_id].good_probability >= 0.5)


def test_features_of_pieces_are_those_of_the_whole(monkeypatch):
    text = b"a b b b c dddddddd e " * 40
    whole = quality.features(text).tolist()
    monkeypatch.setattr(quality, "lower_words", lambda t: ([w] for w in t.split()))
    assert quality.features(text).tolist() == whole


def test_awkward_rows(spark):
    docs = awkward(spark)
    ratings = spark.createDataFrame(
        [(1, 2), (1, 0), (5, 2), (None, 1), (3, None), (99, 1), (4, 9)], "doc_id bigint, grade int"
    )
    model = quality.fit_ratings(docs, ratings)
    got = quality.graded(docs, model, ["doc_id", "score"], at_least=1)
    assert got.columns == ["doc_id", "score", "expected_grade", "tail"]
    assert got.count() == docs.count()
    kept = quality.accepted(docs, model, keep_at=0.0)
    assert kept.schema == docs.schema and kept.count() == docs.count()
    none = quality.fit_ratings(docs, ratings.where("false"))
    assert not none.weights.any() and quality.graded(empty(spark), none, ["doc_id"]).collect() == []
    assert quality.fit_ratings(empty(spark), ratings).weights.any() == np.False_
    marks = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 1), (5, None, 0), (6, 1, None), (7, None, 1)],
        "doc_id int, quality int, toxic int",
    )
    assert [r.grade for r in quality.ratings_of(marks).orderBy("doc_id").collect()] == [2, 1, 0, 0, None, None, 0]


def test_nothing_learned_drops_nothing(spark):
    docs = awkward(spark)
    for ratings in ([], [(1, None), (None, 2)], [(99, 0), (98, 2)]):
        model = quality.fit_ratings(docs, spark.createDataFrame(ratings, "doc_id bigint, grade int"))
        kept = quality.accepted(docs, model)
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))
        assert {(r.expected_grade, r.tail) for r in quality.graded(docs, model, ["doc_id"]).collect()} == {(2.0, 1.0)}
