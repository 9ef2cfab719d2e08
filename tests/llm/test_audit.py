from __future__ import annotations

import re
from itertools import permutations
from math import factorial

from cases import awkward, empty
from pyspark.sql import functions as F

from staffcast.llm import audit

LABELS = "doc_id bigint, quality int, toxic int"


def plain(rows, labels):
    """Every order run on its own: rows of (key, text, part)."""
    marked = {}
    for key, quality, toxic in labels:
        good, bad = marked.get(key, (False, False))
        marked[key] = (good or quality == 1, bad or toxic == 1)

    def fails(key, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": bool(set(text) & set("#$%&*|")),
            "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows),
        }
        return {name for name, failed in out.items() if failed}

    docs = [(p or "", fails(k, t or ""), marked.get(k, (False, False)) if k is not None else (False, False)) for k, t, p in rows]
    out = {}
    for part in {p for p, _, _ in docs}:
        own = [(f, g) for p, f, g in docs if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, start=1):
                lost = [(f, g) for f, g in left if name in f]
                left = [(f, g) for f, g in left if name not in f]
                shapley[name] += len(lost)
                all_failing = sum(name in f for f, _ in own)
                out[part, "".join(order), step] = [
                    len(left), len(lost), all_failing - len(lost), sum(f == {name} for f, _ in own),
                    sum(g[0] for _, g in lost), sum(g[1] for _, g in lost),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def by_step(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in audit.COUNTS] for r in df.collect()}


def test_paths_are_factorials():
    reaching, leaving = audit.path_counts(5)
    for state in range(32):
        size = state.bit_count()
        assert (reaching[state], leaving[state]) == (factorial(size), factorial(5 - size))


def test_every_order_run_on_its_own(spark):
    long, loud = " ".join(f"w{i}" for i in range(250)), "LOUD " * 30
    texts = [long, loud, "a $ b", "", None, long + " *", "same " * 300, "x\x1cy z w", " \t\x0b"]
    rows = [(i % 31 if i % 7 else None, texts[i * i % len(texts)], ("en", "de", None, "")[i % 4]) for i in range(90)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 40, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = by_step(audit.audit(docs, spark.createDataFrame(labels, LABELS)))
    assert got == plain(rows, labels)


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumns({c: F.lit(1) for c in ("part", "fails", "id", "mark", "n", "good", "toxic", "bit")})
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, None, None)], LABELS)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert by_step(audit.audit(docs, labels)) == plain(rows, [(1, 1, None), (1, 0, 1)])
    assert by_step(audit.audit(docs, labels.limit(0))) == plain(rows, [])
    assert audit.audit(empty(spark), labels).count() == 0


def test_own_conditions_without_copies(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb")], "doc_id int, text string").withColumn("lang", F.lit("x"))
    found = audit.audit(
        docs, spark.createDataFrame([], LABELS), {"L": F.length("text") > 1, "S": F.col("text") == "a"}, copies=None
    )
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in found.collect()}
    assert got == {("LS", 1): (2, 1, 2), ("LS", 2): (0, 2, 4), ("SL", 1): (1, 2, 4), ("SL", 2): (0, 1, 2)}
