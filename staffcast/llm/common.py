"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staffcast.operators.spread import settle

__all__ = ["settle", "table", "utf8", "lower_words", "cut_points", "held_out", "literal_table"]

#: A-Z to a-z on UTF-8 bytes; all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as bytes, null as no bytes."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def lower_words(text: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Lists of the whitespace-parted words of a text, A-Z lower-cased.

    A very long text is cut between words into pieces of about ``size`` bytes, so that
    only one piece is held as words at a time.
    """
    for piece in cut_points(text, size, b" \t\n\r\x0b\x0c"):
        yield piece.translate(LOWER).split()


def cut_points(text: bytes, size: int, gaps: bytes) -> Iterator[bytes]:
    """Pieces of a text of about ``size`` bytes, cut only at one of the bytes ``gaps``."""
    start, is_gap = 0, frozenset(gaps)
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end] not in is_gap:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether CRC-32 of a key as text leaves ``part`` when divided by ``parts``; null counts as ''."""
    return F.expr(f"crc32(coalesce(cast(`{key}` AS string), '')) % {parts} = {part}")


def literal_table(
    spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence[int]]
) -> DataFrame:
    """A small table of whole numbers, made by Spark from one literal."""
    text = F.lit("[" + ",".join(f"[{','.join(map(str, row))}]" for row in rows) + "]")
    parsed = spark.range(1).select(F.explode(F.from_json(text, "array<array<bigint>>")).alias("r"))
    return parsed.select(*[F.col("r")[i].alias(name) for i, name in enumerate(columns)])


def run_starts(keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
