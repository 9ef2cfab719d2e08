from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

from cases import LONG, awkward, empty

from staffcast.llm import decontaminate
from staffcast.llm.decontaminate import Automaton, contamination, cut_spans, items_of, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lowered(text))


def plain(text, items, window=10):
    """(words, hit words, item ids) by comparing every window with every place."""
    w, hit, names = words(text), set(), set()
    for key, item in items:
        v = words(item)
        width = min(window, len(v))
        if not width:
            continue
        for j in range(len(v) - width + 1):
            for i in range(len(w) - width + 1):
                if w[i:i + width] == v[j:j + width]:
                    hit.update(range(i, i + width))
                    names.add(key)
    return len(w), len(hit), sorted(names)


def test_random_texts_equal_brute_force():
    draw = random.Random(1)
    for trial in range(150):
        letters = "abcd"[: draw.randint(1, 4)]
        make = lambda n: " ".join(draw.choice(letters) for _ in range(n))  # noqa: E731, B023
        items = [(str(i), make(draw.randint(0, 9))) for i in range(draw.randint(0, 5))]
        texts = [make(draw.randint(0, 40)) for _ in range(8)]
        window = draw.randint(1, 5)
        automata = [Automaton([(k, t.encode()) for k, t in part], window) for part in (items[::2], items[1::2])]
        got = [(n, int(m.sum()), items_of(s, automata)) for n, m, s in scan([t.encode() for t in texts], automata)]
        assert got == [plain(t, items, window) for t in texts], trial


def test_cutting_leaves_no_window():
    draw = random.Random(2)
    for _ in range(80):
        make = lambda n: " ".join(draw.choice("abc") for _ in range(n))
        items = [("1", make(6))]
        automata = [Automaton([(k, t.encode()) for k, t in items], 4)]
        text = make(60)
        rest = cut_spans(text.encode(), automata, 1.0)
        assert rest is not None and plain(rest.decode(), items, 4)[1] == 0
        if not plain(text, items, 4)[1]:
            assert rest.decode() == text


def frame(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


ITEM = "one two three four five six seven eight nine ten eleven"


def test_awkward_rows(spark):
    items = [(1, "the cat sat on the mat and looked at the dog"), (2, None), (3, ""), (4, "漢字"), (None, "ipsum lorem")]
    docs = awkward(spark)
    named = [("" if k is None else str(k), t) for k, t in items if t is not None]
    plain_long = (80_000, 79_998, [""])
    expected = sorted(
        (r.doc_id is None, r.doc_id or 0, *(plain_long if r.text == LONG else plain(r.text, named)))
        for r in docs.select("doc_id", "text").collect()
    )
    got = contamination(docs, frame(spark, items)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in got) == expected
    assert contamination(empty(spark), frame(spark, items)).collect() == []
    assert all(r.n_hit == 0 for r in contamination(docs, frame(spark, [])).collect())


def test_many_items_of_one_passage(spark):
    """Documents do not carry the items: the task keeps numbers of item sets."""
    items = [(i, f"{ITEM} {i} x{i % 7} y") for i in range(400)] + [(1000 + i, f"other{i} " * 12) for i in range(9)]
    rows = [(i, f"so {ITEM} {i % 500} x{i % 7} y or other{i % 9} " + f"other{i % 9} " * 11) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = [t.encode() for _, t in rows]
    automata = [Automaton([(str(k), t.encode()) for k, t in items])]
    assert len(automata[0].sets) < 900
    tracemalloc.start()
    found = list(scan(texts, automata))
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    assert max(len(items_of(sets, automata)) for _, _, sets in found) == 401
    got = {r.doc_id: r for r in contamination(docs, frame(spark, items), listed=False).collect()}
    for i in (0, 7, 399, 450, 2999):
        n, hit, names = plain(rows[i][1], [(str(k), t) for k, t in items])
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        assert got[i][1:] == (n, hit, len(names), digest)


def test_many_automata_find_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(14))) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id bigint, text string")
    one = {tuple(map(str, r)) for r in contamination(docs, frame(spark, items)).collect()}
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 100)
    assert {tuple(map(str, r)) for r in contamination(docs, frame(spark, items)).collect()} == one


def test_spans_go_and_clean_documents_stay(spark):
    clean = "a text, with its  own\nspaces. " * 5
    rows = [(1, f"{clean}{ITEM} {clean}", 1), (2, clean, 7), (3, f"so {ITEM}", 2), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, frame(spark, [(1, ITEM)])).collect()}
    assert sorted(got) == [1, 2, 4]  # nearly all of document 3 is hit
    assert got[1].text == f"{clean} {clean}" and got[1].n_chars == len(got[1].text)
    assert got[2].text == clean and got[2].n_chars == 7 and got[4].text is None
