from __future__ import annotations

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from staffcast.llm import warc

SCHEMA = "page_id bigint, url string, html string, key string, type int, record string"
HARD = 'a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n'


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def history(spark, rows, **options):
    at = F.timestamp_seconds(F.coalesce("page_id", F.lit(0)))
    return warc.capture_history(pages(spark, rows), captured=at, **options).orderBy("capture_rank").collect()


ROWS = [
    (5, "http://b.example.org/x?q=1#top", HARD), (3, "https://Sub.A.example.com:8080/y", None),
    (9, "http://b.example.org/x?q=1", HARD), (1, None, ""), (4, "no url\r\nat all", "é漢字\U0001F600"),
    (7, "http://b.example.org", HARD + " "), (8, "", "z" * 300_000), (None, "http://n.org/", HARD),
]


def test_awkward_pages_come_back(spark):
    got = {r.key: r for r in history(spark, ROWS)}
    assert len(got) == len(ROWS)
    for key, _, html in ROWS:
        assert (got[key].bytes, got[key].digest) == (len((html or "").encode()), digest(html))
    kinds = {k: (r.type, r.refers_to) for k, r in got.items()}
    assert kinds == {
        5: ("response", None), 9: ("revisit", 5), None: ("revisit", 5), 1: ("response", None),
        3: ("revisit", 1), 4: ("response", None), 7: ("response", None), 8: ("response", None),
    }
    assert got[5].uri == ROWS[0][1] and got[1].uri is None and got[4].uri == "no url%0D%0Aat all"
    assert got[3].url_key == "com,example,a,sub)/y" and got[7].url_key == "org,example,b)/"
    assert got[9].url_key == got[5].url_key == "org,example,b)/x?q=1"


def test_repeated_and_missing_pages(spark):
    got = history(spark, [(1, "http://a.b/", "t"), (1, "http://a.b/", "t"), (2, "http://a.b/", "t")])
    assert [(r.key, r.type, r.refers_to) for r in got] == [
        (1, "response", None), (1, "response", None), (2, "revisit", 1)
    ]
    assert history(spark, []) == []
    few = history(spark, [(1, "http://a.b/", "t"), (2, "http://a.b/", "t")], least=2)
    assert [r.type for r in few] == ["response", "response"]


def test_history_is_in_order_over_many_runs_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 100)
    draw = random.Random(4)
    # One URL has half of all captures.
    rows = [(i, "http://hot.org/" if i % 2 else f"http://h{draw.randint(0, 9)}.org/{draw.randint(0, 50)}", str(i % 700))
            for i in range(1500)]
    draw.shuffle(rows)
    got = history(spark, rows)
    assert [r.capture_rank for r in got] == list(range(1500))
    assert len({r.run for r in got}) > 20 and len({r.range for r in got}) > 10
    expected = sorted((warc.url_key(u), i) for i, u, _ in rows)
    assert [(r.url_key, r.key) for r in got] == expected
    assert all((r.type == "response") == (r.key < 700) and (r.refers_to in (None, r.key % 700)) for r in got)


def test_loser_tree_merges(spark):
    draw = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(draw.randint(0, 30) for _ in range(draw.randint(0, 20))) for _ in range(k)]
        merged = [runs[r][i] for r, i in warc.LoserTree(runs)]
        assert merged == sorted(x for r in runs for x in r)


def test_damage_is_noticed(spark, tmp_path):
    import gzip

    path = str(tmp_path / "archives")
    warc.write_archives(pages(spark, [(1, "http://a.b/", "some text")]), path)
    name = next(p for p in (tmp_path / "archives").iterdir() if p.name.endswith(".gz"))
    content = gzip.decompress(name.read_bytes())
    assert [h["WARC-Type"] for _, h, _, _ in warc.parse(gzip.compress(content))] == ["response"]
    # Two members in one file are read as one archive.
    two = gzip.compress(content) + gzip.compress(content)
    assert [o for o, *_ in warc.parse(two)] == [0, len(content)]
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(content[:-1])))
    name.write_bytes(gzip.compress(content.replace(b"some text", b"SOME text")))
    (tmp_path / "archives" / f".{name.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, path, "bigint").collect()
