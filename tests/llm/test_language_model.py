from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from cases import awkward, empty
from conftest import SMALL
from pyspark.sql import functions as F

from staffcast.llm import language_model as lm
from staffcast.llm.queries import QUERIES


def tokens(text):
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [*lowered.split(), b""]


def plain_base(rows, learned):
    """(tokens, known, training tokens, base score) of each text."""
    counts = Counter(t for text, own in zip(rows, learned, strict=True) if own for t in tokens(text))
    n = sum(counts.values())
    space = n + len(counts) + 1
    out = []
    for text in rows:
        own = tokens(text)
        out.append((len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / space) for t in own)))
    return out


@pytest.mark.parametrize("head", [1 << 18, 300])
def test_base_scores_equal_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    learned = [crc32(str(d.doc_id).encode()) % 7 != 2 for d in docs]
    expected = plain_base([d.text for d in docs], learned)
    got = {r.doc_id: r for r in QUERIES["op5_language_model"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d, own, (n, known, total, base) in zip(docs, learned, expected, strict=True):
        r = got[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not own, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_a_distribution(spark):
    """The chances of all tokens after one context, seen and unseen, add up to one."""
    texts = ["a b c a b", "b a c d", "x yy zz a b c", "ab cb db"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    counts = lm.count_tokens(docs, "text")
    vocabulary, _ = lm.read_vocabulary(counts)
    found = {bytes(r.token): r.n for r in counts.collect()}
    assert vocabulary.tokens == sum(found.values()) == 18 + 4 and vocabulary.distinct == len(found)
    inside = np.zeros(lm.CLASSES)
    for token, n in found.items():
        c = vocabulary.classes[vocabulary.numbers[token]]
        inside[c] += n / (vocabulary.totals[c] + vocabulary.unseen[c])
    inside += vocabulary.unseen / np.maximum(vocabulary.totals + vocabulary.unseen, 1e-300)
    used = (vocabulary.totals + vocabulary.unseen) > 0
    assert inside[used] == pytest.approx(1)
    draw = np.random.default_rng(1)
    weights = [draw.normal(size=lm.CLASSES).astype(np.float32)] + [draw.normal(size=(b, lm.CLASSES)).astype(np.float32) for b in lm.BUCKETS]
    buckets = lm.features([np.arange(9)], vocabulary.before)
    scores = np.exp([lm.class_scores(buckets, weights, np.full(9, c)) for c in range(lm.CLASSES)]).T
    assert scores.sum(axis=1) == pytest.approx(1, abs=1e-5)
    for i in range(9):
        plain = weights[0] + sum(w[b[i]] for w, b in zip(weights[1:], buckets, strict=True))
        assert scores[i] == pytest.approx(np.exp(plain) / np.exp(plain).sum(), rel=1e-4)


def test_training_lowers_the_loss_and_averages_by_use(spark):
    symbols = [np.tile(np.arange(8), 50) for _ in range(4)]
    buckets, classes = lm.features(symbols, 100), np.concatenate(symbols)
    start = [np.zeros(lm.CLASSES, np.float32)] + [np.zeros((b, lm.CLASSES), np.float32) for b in lm.BUCKETS]
    learner = lm.Learner(start)
    for _ in range(20):
        learner.learn(buckets, classes)
    loss = -lm.class_scores(buckets, learner.weights, classes).mean()
    assert loss < 0.2 < math.log(lm.CLASSES)
    two = [{"block": b, "used": u, "change": c} for b, u, c in learner.changes()]
    moved = lm._moved(start, two)
    for new, own in zip(moved, learner.weights, strict=True):
        assert new == pytest.approx(own, abs=1e-3)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    learned = [r.doc_id is not None and r.doc_id != 8 for r in rows]
    expected = plain_base([r.text for r in rows], learned)
    got = lm.score(docs, F.coalesce(F.col("doc_id") != 8, F.lit(False))).collect()
    seen = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert seen == Counter((r.doc_id, n, k, t, round(b, 6)) for r, (n, k, t, b) in zip(rows, expected, strict=True))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    nothing = lm.score(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)
    assert lm.score(empty(spark), F.lit(True)).collect() == []


def test_tokens_outside_the_head_are_contexts(spark, monkeypatch):
    """The head only saves work: the scores are the same without most of its tokens."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(100).coalesce(1).cache()
    found = []
    for head in (1 << 18, 100):
        monkeypatch.setattr(lm, "HEAD", head)
        found.append({r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") % 3 != 0).collect()})
    assert found[0] == pytest.approx(found[1], rel=1e-6)
    vocabulary = lm.Vocabulary({}, np.zeros(1, np.int64), *[np.zeros(0)] * 4, 0, 0)
    [(symbols, marks, others)] = vocabulary.symbols([b"aing bing"])
    assert symbols[0] == symbols[1] and marks[0] != marks[1] and others == [b"aing", b"bing", b""]


def test_decisions_in_a_class_are_a_distribution(spark, monkeypatch):
    """After any context the leaves of a class have chances that add up to one, shares in a leaf too."""
    monkeypatch.setattr(lm, "LEARNED", 40)
    draw = np.random.default_rng(2)
    texts = [" ".join(f"{chr(97 + i % 3)}{i}" for i in draw.geometric(0.02, 300)) for _ in range(4)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    counts = lm.count_tokens(docs, "text")
    vocabulary, _ = lm.read_vocabulary(counts)
    weights = draw.normal(size=(1 << lm.INSIDE_BITS, 1)).astype(np.float32)
    inside = lm._token_scores(vocabulary)[2]
    learned = shared = 0
    for group in range(lm.SUFFIX_CLASSES):
        c = lm.OWN_CLASSES + group
        own = {t: i for t, i in vocabulary.numbers.items() if vocabulary.classes[i] == c}
        leaves = np.array(sorted({1 + group, *(int(vocabulary.leaves[i]) for i in own.values())}))
        buckets = [np.full(len(leaves), 7) for _ in lm.BUCKETS]
        scores = lm.inside_scores(buckets, leaves, vocabulary, weights)
        assert np.exp(scores).sum() == pytest.approx(1, abs=1e-4)
        # Without weights the chance of every token is its counted share.
        counted = dict(zip(leaves, lm.inside_scores(buckets, leaves, vocabulary, weights * 0), strict=True))
        total = vocabulary.totals[c] + vocabulary.unseen[c]
        for i in own.values():
            share = counted[vocabulary.leaves[i]] / math.log(10) + inside[i]
            assert share == pytest.approx(math.log10(vocabulary.counts[i] / total), abs=1e-4)
        rest = [i for i in own.values() if vocabulary.leaves[i] == 1 + group]
        assert 10 ** inside[rest].sum(initial=0) <= 1
        in_rest = sum(10 ** inside[i] for i in rest) + vocabulary.unseen[c] / vocabulary.rest[group]
        assert in_rest == pytest.approx(1)
        learned, shared = learned + len(leaves) - 1, shared + len(rest)
    assert 20 < learned <= 40 < shared


def test_the_token_in_its_class_is_learned_from_its_context(spark):
    """Two tokens of one class and one count: the one that follows the context is the likelier."""
    filler = " ".join(f"w{i}x w{i}x w{i}x" for i in range(40))
    docs = spark.createDataFrame([(0, f"{filler} pp kaab zz qq kbab zz pp kaab zz qq kbab zz")], "doc_id int, text string")
    vocabulary, _ = lm.read_vocabulary(lm.count_tokens(docs, "text"))
    [(symbols, marks, _)] = vocabulary.symbols([b"pp kaab zz qq kbab zz"])
    buckets, classes = lm.features([marks], vocabulary.before), vocabulary.classes[symbols]
    assert classes[1] == classes[4] >= lm.OWN_CLASSES and symbols[1] != symbols[4]
    leaves = vocabulary.leaves[symbols]
    start = [np.zeros(lm.CLASSES, np.float32)] + [np.zeros((b, lm.CLASSES), np.float32) for b in lm.BUCKETS]
    learner = lm.Learner([*start, np.zeros((1 << lm.INSIDE_BITS, 1), np.float32)])
    other = leaves[[0, 4, 2, 3, 1, 5, 6]]
    before = lm.inside_scores(buckets, leaves, vocabulary, learner.weights[-1])
    assert before == pytest.approx(lm.inside_scores(buckets, other, vocabulary, learner.weights[-1]))
    for _ in range(1000):
        learner.learn(buckets, classes, leaves, vocabulary)
    right, wrong = (lm.inside_scores(buckets, x, vocabulary, learner.weights[-1]) for x in (leaves, other))
    assert all(right[[1, 4]] > math.log(0.9)) and all(wrong[[1, 4]] < math.log(0.1))
    # The changes of one task move the common weights to its own.
    moved = lm._moved(learner.start, [{"block": b, "used": u, "change": c} for b, u, c in learner.changes()])
    assert all(new == pytest.approx(own, abs=1e-3) for new, own in zip(moved, learner.weights, strict=True))
