"""Awkward documents that every operator has to take."""

from __future__ import annotations

LONG = "lorem ipsum " * 40_000
#: Names that operators use for their own columns.
CLASHING = (
    "_key", "_row", "_size", "_offset", "_piece", "_prefix", "_large", "_no", "_source", "_from", "_rate", "_cdf",
    "_pieces", "_own", "_digest", "_place", "_number", "_at", "_kept", "_drawn_by", "_doc", "_n", "copy", "rate", "id",
    "part", "fails", "n", "component_id", "shuffle_key", "named", "hashed", "word",
)
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, slot string, "
    "fp string, component string, items string, copies string, score string, training string, key string, row string, "
    + ", ".join(f"{c} string" for c in CLASHING)
)


def awkward(spark, copies: int = 3):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    texts = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a"),
        (2, None, "en", "a"),
        (3, "", "de", "b"),
        (4, LONG, None, "b"),
        (5, "der Hund sah die Katze an und lief dann weg", "de", None),
        (None, "a text without any number for itself", "en", "a"),
        (None, None, None, None),
        (6, "123 456 !!! ... 789", "fr", "c"),
        (7, "THE cat SAT on the mat and looked at the dog", "en", "c"),
        (8, "éèê ñ ß 漢字", "fr", "c"),
    ]
    rows = [(i, t, la, s, len(t) if t else None, 1, "x", "y", "z", "w", "v", "u", "t", "k", "r", *CLASHING) for i, t, la, s in texts]
    return spark.createDataFrame(rows * copies, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
