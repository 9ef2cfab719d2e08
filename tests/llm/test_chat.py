from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import functions as F

from staffcast.llm import chat

RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"},
                   {"role": "assistant", "content": "a"}], "id": 3}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"output": "done", "instruction": "do"}, [("user", "do"), ("assistant", "done")]),
    ({"prompt": "q", "completion": "a", "source": "x"}, [("user", "q"), ("assistant", "a")]),
    ({"question": "q", "response": 7, "system_prompt": "s"}, [("system", "s"), ("user", "q"), ("assistant", "7")]),
    ({"role": "tool", "text": "t"}, [("tool", "t")]),
]


def test_layouts_become_turns(spark):
    unknown = [json.dumps({"a": {"b": [1, 2]}}), "{broken", "[1]", "", None, json.dumps({"messages": []})]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)] + [(100 + i, u) for i, u in enumerate(unknown)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, record string, role string")
    got = {}
    for r in chat.canonical_turns(df.select("id", "record"), "record", ["id"]).orderBy("id", "part").collect():
        got.setdefault(r.id, []).append((r.role, r.text))
    assert got == {
        **{i: turns for i, (_, turns) in enumerate(RECORDS)},
        **{100 + i: [(None, u or "")] for i, u in enumerate(unknown)},
    }
    assert chat.canonical_turns(df.where("false"), "record", ["id"]).collect() == []


def test_fingerprints_tell_layouts_apart():
    assert len(chat.REGISTRY) == len(chat.MAPPINGS)
    paths = chat.field_paths({"b": [{"c": 1}, {"d": None}], "a": {"e": 2}, "id": 5})
    assert paths == {"b[].c", "b[].d", "a.e"}
    assert chat.fingerprint(paths) == hashlib.sha256(b"a.e\nb[].c\nb[].d").hexdigest()[:16]


def test_any_text_comes_back(spark):
    draw = random.Random(6)
    pieces = ["\\", "<turn ", "</turn>", "<", ">", "\n", "user>", "turn", "é", "\U0001F600", "", " ", "/turn>", "\\<turn "]
    rows = [(i // 5, i % 5, draw.choice(["user", "assistant", "a>b\\", ""]),
             "".join(draw.choice(pieces) for _ in range(draw.randint(0, 12)))) for i in range(600)]
    df = spark.createDataFrame(rows, "conv bigint, turn int, role string, text string")
    segments = chat.segments(df)
    for r in segments.collect():
        assert chat.read_segment(r.formatted) == (r.role, r.text)
        if r.role == "assistant":
            assert chat.unescaped(r.formatted[r.loss_from:r.loss_to]) == r.text
        else:
            assert r.loss_from is None
    whole = "".join(r.formatted for r in segments.where("conv = 3").orderBy("turn").collect())
    assert [(chat.unescaped(a), chat.unescaped(b)) for a, b in chat.SEGMENT.findall(whole)] == [r[2:] for r in rows if r[0] == 3]
    got = {r.conv: r for r in chat.read_back(segments, "conv", ["turn"]).collect()}
    assert len(got) == 120
    for conv, r in got.items():
        own = [x for x in rows if x[0] == conv]
        learned = "".join(t for _, _, role, t in own if role == "assistant")
        assert r.n_turns == 5 and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_nulls_ties_and_one_long_conversation(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", None)] + [(1, i // 2, "user", str(i)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "conv bigint, turn int, role string, text string")
    got = {r.conv: r for r in chat.read_back(chat.segments(df), "conv", ["turn"]).collect()}
    assert sorted(got, key=str) == [1, None] and got[1].n_turns == 30_000 and got[None].n_turns == 2
    assert got[None].loss_chars == 0
    order = sorted(rows[2:], key=lambda r: (r[1], r[3] + "</turn>"))
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"user\n{t}\n" for *_, t in order).encode()).hexdigest()
    assert chat.read_back(chat.segments(df.where(F.lit(False))), "conv", ["turn"]).collect() == []
