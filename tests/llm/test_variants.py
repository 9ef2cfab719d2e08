from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from cases import awkward, empty
from pyspark.sql import functions as F

from staffcast.llm import variants
from staffcast.llm.queries import op11_variants


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def plain_pairs(words):
    return sorted(p for u, v in combinations(sorted(words), 2) if one_edit(u, v) for p in ((u, v), (v, u)))


def plain(counts, ratio=variants.RATIO):
    near = {w: [] for w in counts}
    for u, v in plain_pairs(counts):
        near[u].append(v)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def words_of(seed, n, letters, lengths):
    draw = random.Random(seed)
    return sorted({"".join(draw.choices(letters, k=draw.choice(lengths))) for _ in range(n)})


def test_acceptor_numbers_its_words_and_is_minimal():
    words = words_of(1, 300, "abé", (1, 2, 3, 4, 5))
    made = variants.Acceptor(words)

    def place(word):
        state, at = made.start, 0
        for letter in word:
            state, before = made.arcs[state][letter]
            at += before
        return at if made.final[state] else None

    assert [place(w) for w in words] == list(range(len(words)))
    rights = set()

    def right(state):
        return frozenset({""} if made.final[state] else ()) | {
            a + w for a, (to, _) in made.arcs[state].items() for w in right(to)
        }

    for state in range(len(made.arcs)):
        rights.add(right(state))
    assert len(rights) == len(made.arcs)


@pytest.mark.parametrize("bound", [1, 3, variants.BOUND])
def test_pairs_are_all_pairs_whatever_the_bound(spark, bound):
    words = words_of(2, 500, "ab", (1, 2, 5, 7, 8, 9)) + ["é" * 7, "é" * 8, "aaaaaaaé", "𐐷bcdefg", "𐐷bcdefgh"]
    rows = [(w, i) for i, w in enumerate(sorted(set(words)))]
    got = variants.near_words(spark.createDataFrame(rows, "word string, n bigint"), bound)
    number = dict(rows)
    pairs = sorted((r.word, r.near) for r in got.collect())
    assert pairs == plain_pairs(words)
    assert all(r.near_n == number[r.near] for r in got.collect())


def test_forms_and_roots(spark):
    counts = {w: 1 + (i * i) % 7 for i, w in enumerate(words_of(3, 300, "abc", (7, 8)))}
    counts |= {"xxxxxxx": 2, "xxxxxxy": 20, "xxxxxyy": 200, "xxxxyyy": 2000, "xxxyyyy": 2000, "xxxxxyyy": 19_999, "zzzzzzz": 5}
    got = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
    assert {tuple(r) for r in got.collect()} == plain(counts)
    assert {r.root for r in got.where("word = 'xxxxxxx'").collect()} == {"xxxxxyyy"}


def test_long_words(spark):
    words = ["a" * 6000, "a" * 6001, "a" * 3000 + "b" + "a" * 3000, "b" + "a" * 5999]
    got = variants.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint"))
    assert sorted((r.word, r.near) for r in got.collect()) == plain_pairs(words)


def test_a_hot_half(spark):
    """A third of the words share their first half; groups above the bound are dealt out again."""
    words = ["commonhalf" + w for w in words_of(4, 400, "abcd", (8, 9, 10))] + words_of(5, 800, "abcdefgh", (7, 8))
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    got = variants.near_words(rows, bound=40)
    assert sorted((r.word, r.near) for r in got.collect()) == plain_pairs(words)


def plain_counts(docs):
    """The query's words counted run by run: rows of (key, text)."""
    counts = Counter()
    for key, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_query_counts_and_awkward_documents(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    rows += [(i, f"Without WITHOUT withou ÀÉÎÕÜßÿ x{'abcdefgh'[: i % 8]}qrstuv" + " numbered" * 40) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {c: F.lit("x") for c in ("word", "n", "key", "run", "hashed", "h", "at", "near", "root")}
    )
    monkeypatch.setattr("staffcast.llm.queries.table", lambda *_: docs)
    got = {tuple(r) for r in op11_variants(spark, "").collect()}
    assert got == plain(plain_counts(rows))
    assert any(form is not None for _, form, *_ in got)
    monkeypatch.setattr("staffcast.llm.queries.table", lambda *_: empty(spark))
    assert op11_variants(spark, "").count() == 0
