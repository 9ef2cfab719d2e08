"""The whole pipeline against plain loops, and each stage on awkward documents."""

from __future__ import annotations

from collections import Counter

from cases import awkward, empty
from conftest import SMALL
from test_decontaminate import WORD, lowered, words
from test_mixing import plain_count
from test_near_copies import plain_components, plain_fingerprint
from test_sharding import number_of

import corpus_pipeline
from pyspark.sql import functions as F
from staffcast.llm import mixing, quality


def plain_cut(text, items, window=10, coverage=0.5):
    """The text without hit windows, again and again, or nothing when much of it is hit."""
    whole = len(words(text))
    while True:
        w, hit = words(text), set()
        for v in map(words, items):
            width = min(window, len(v))
            for j in range(len(v) - width + 1 if width else 0):
                for i in range(len(w) - width + 1):
                    if w[i:i + width] == v[j:j + width]:
                        hit.update(range(i, i + width))
        if not hit:
            return text
        if len(w) - len(hit) < (1 - coverage) * whole:
            return None
        places, out, at = list(WORD.finditer(lowered(text))), "", 0
        for i, m in enumerate(places):
            if i in hit:
                if i - 1 not in hit:
                    out += text[at:m.start()]
                at = m.end()
        text = out + text[at:]


def test_run_equals_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit_ratings(docs, quality.ratings_of(spark.read.parquet(f"{SMALL}/labels.parquet")))
    rows = [r.asDict() for r in docs.collect()]
    scores = quality.score_texts(((r["text"] or "").encode() for r in rows), model)
    rows = [r for r, t in zip(rows, model.tails(scores)[:, -1], strict=True) if t >= quality.KEEP_AT]
    parts = plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in rows], 2)
    rows = [r for r, c in zip(rows, parts, strict=True) if r["doc_id"] == c]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    cut = [(r, plain_cut(r["text"], items)) for r in rows]
    assert any(t != r["text"] for r, t in cut)
    rows = [{**r, "text": t, "n_chars": r["n_chars"] if t == r["text"] else len(t)} for r, t in cut if t is not None]
    size = Counter()
    for r in rows:
        size[r["source"]] += len(r["text"].encode())
    weight = {s: round(b**mixing.ALPHA, 6) for s, b in size.items()}
    rate = {s: round(weight[s] / sum(weight.values()) * sum(size.values()) / b, 9) for s, b in size.items()}
    rows = [r for r in rows for _ in range(plain_count(rate[r["source"]], r["doc_id"]))]
    rows.sort(key=lambda r: number_of(str(r["doc_id"])))
    total, before, slots, expected = sum(len(r["text"].encode()) + 1 for r in rows), 0, Counter(), Counter()
    for r in rows:
        shard = 8 * before // total
        expected[r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], shard, slots[shard]] += 1
        slots[shard] += 1
        before += len(r["text"].encode()) + 1
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == [*docs.columns, "shard", "slot"]
    names = ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == expected


def plain_stage(name, rows, names, model):
    """The rows that a stage gives for the awkward documents, the mixing aside; items of the benchmark are in none."""
    text, key = names.index("text"), names.index("doc_id")
    if name == "quality classifier":
        scores = quality.score_texts(((r[text] or "").encode() for r in rows), model)
        return [r for r, t in zip(rows, model.tails(scores)[:, -1], strict=True) if t >= quality.KEEP_AT]
    if name == "near copies":
        own = [r for r in rows if r[key] is not None]
        parts = plain_components([(r[key], plain_fingerprint(r[text])) for r in rows if r[key] is not None], 2)
        firsts = {}
        for r, c in zip(own, parts, strict=True):
            if r[key] == c:
                firsts[c] = r
        return [r for r in rows if r[key] is None] + list(firsts.values())
    return rows


def test_stages_take_awkward_documents(spark):
    labels = quality.ratings_of(spark.read.parquet(f"{SMALL}/labels.parquet"))
    for make in (awkward, empty):
        docs = make(spark)
        model = quality.fit_ratings(docs, labels)
        rows = [tuple(r) for r in docs.collect()]
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, SMALL)
            names = [c for c in docs.columns if c not in ("shard", "slot")] if name == "sharding" else docs.columns
            found = Counter(map(tuple, got.select([f"`{c}`" for c in names]).collect()))
            expected = Counter(tuple(r[docs.columns.index(c)] for c in names) for r in plain_stage(name, rows, docs.columns, model))
            if name == "mixing":
                drawn = mixing.told_apart(docs, "drawn here").collect()
                rates = {r.source: r["rate here"] for r in mixing.source_rates(docs, "source", "text", None).select(
                    F.col("_source").alias("source"), F.col("_rate").alias("rate here")).collect()}
                expected = Counter()
                for r in drawn:
                    expected[tuple(r)[:-1]] += plain_count(rates[r["source"]], r["drawn here"])
                expected = +expected
            assert found == expected, name
            if name != "sharding":
                assert got.columns == docs.columns


def test_stages_are_the_named_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near copies", "decontamination", "mixing", "sharding"
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_stage_keeps_all_without_known_ratings(spark):
    """None of the awkward documents is rated here, so none may go."""
    docs = awkward(spark).where("doc_id IS NULL OR doc_id < 0")
    got = corpus_pipeline.select_quality(spark, docs, SMALL)
    assert docs.count() and Counter(map(tuple, got.collect())) == Counter(map(tuple, docs.collect()))


def test_mixing_draws_for_each_row(spark):
    """A third without id, a third of one id and text: neither is kept or dropped as a whole."""
    rows = [(None if i % 3 == 0 else -1 if i % 3 == 1 else i, "same" if i % 3 == 1 else f"text {i % 999}", f"s{i % 2}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = corpus_pipeline.mix_sources(spark, docs, SMALL).collect()
    for own in (None, -1):
        assert 1800 < sum(r.doc_id == own for r in got) < 2200
    drawn = mixing.told_apart(docs, "d").collect()
    assert len({r.d for r in drawn}) == len(rows)
    assert all(r.d == str(r.doc_id) for r in drawn if r.doc_id not in (None, -1))
