"""Balanced shards by histogram sort: exact byte counts below refined probes, one exchange.

The rows get a sort key of two whole numbers: 60 bits of an MD5 of the key columns, and
the number of the row as it was settled, which parts rows that are equal in all key
columns. A splitter is the first key with at least ``i / shards`` of all bytes below it.
It is found digit by digit: each round counts the bytes below every candidate boundary
inside the still open intervals, over all partitions, and keeps the interval that holds
the wanted amount, until an edge is within the tolerance. Then all rows move once.
Everything is DataFrame functions.

Null texts count as empty, null key columns as the word null. Equal rows may fall into
different shards; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffcast.llm.common import literal_table, settle

KEY_BITS = 60
ROW_BITS = 60
DIGIT_BITS = 12
#: Rows of a shard are numbered in pieces of about so many rows. A piece of more than ``HOT_TIMES``
#: as many holds a key that very many rows share, and is cut by key and settled partition.
PIECE_ROWS = 1 << 16
HOT_TIMES = 4


@dataclass(frozen=True)
class Splitter:
    """Search for the first sort key with at least ``target`` bytes below it.

    ``key`` and ``row`` are the digits found so far, ``below`` the bytes under them.
    """

    target: int
    depth: int = 0
    key: int = 0
    row: int = 0
    below: int = 0
    done: bool = False

    @property
    def bound(self) -> tuple[int, int]:
        """The boundary: all rows from it on belong to later shards."""
        shift = max(0, KEY_BITS - self.depth * DIGIT_BITS)
        rest = KEY_BITS + ROW_BITS - max(KEY_BITS, self.depth * DIGIT_BITS)
        return self.key << shift, self.row << rest


def text_bytes(text: str) -> Column:
    """UTF-8 bytes of a text column plus one, one for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def sort_key(columns: list[str]) -> Column:
    """60 bits of the MD5 of some columns, joined by slashes."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws("/", *parts)), 1, KEY_BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint")


def _prefix(depth: int) -> tuple[Column, Column]:
    """The first ``depth`` digits of the sort key, as the parts from key and row."""
    in_key = min(depth * DIGIT_BITS, KEY_BITS)
    in_row = depth * DIGIT_BITS - in_key
    key = F.shiftright("_key", KEY_BITS - in_key)
    return key, F.shiftright("_row", ROW_BITS - in_row) if in_row else F.lit(0).cast("bigint")


def _counted(sizes: DataFrame, depth: int, open_: list[Splitter]) -> dict[tuple[int, int], list]:
    """Bytes by next digit inside each open interval, in order.

    At most one row for each open splitter and digit comes to the driver.
    """
    spark = sizes.sparkSession
    key, row = _prefix(depth)
    wanted = literal_table(spark, ["_pk", "_pr"], sorted({(s.key, s.row) for s in open_}))
    inside = sizes if depth == 0 else sizes.withColumns({"_pk": key, "_pr": row}).join(
        F.broadcast(wanted), ["_pk", "_pr"], "left_semi"
    )
    next_key, next_row = _prefix(depth + 1)
    found = inside.groupBy(next_key.alias("k"), next_row.alias("r")).agg(
        F.sum("_size").alias("n"),
        F.count(F.lit(1)).alias("rows"),
        F.max("_key").alias("last_key"),
        F.max("_row").alias("last_row"),
    )
    by_prefix: dict[tuple[int, int], list] = {}
    in_key = (depth + 1) * DIGIT_BITS <= KEY_BITS
    for x in sorted(tuple(x) for x in found.collect()):
        parent = (x[0] >> DIGIT_BITS, x[1]) if in_key else (x[0], x[1] >> DIGIT_BITS)
        by_prefix.setdefault(parent, []).append(x)
    return by_prefix


def _step(splitter: Splitter, counts: list, tolerance: int) -> Splitter:
    """The interval among the counted ones that holds the target, or an edge near enough."""
    below, deeper = splitter.below, splitter.depth + 1
    for k, r, n, rows, last_key, last_row in counts:
        here = replace(splitter, depth=deeper, key=k, row=r, below=below)
        if below >= splitter.target - tolerance:
            return replace(here, done=True)
        if below + n > splitter.target:
            if rows > 1:
                return here
            # One row holds the target: the boundary lies behind it.
            full = (KEY_BITS + ROW_BITS) // DIGIT_BITS
            return replace(here, depth=full, key=last_key, row=last_row + 1, done=True)
        below += n
    # All of the interval is below the target: the boundary is its upper edge.
    k, r = counts[-1][:2]
    k, r = (k + 1, r) if deeper * DIGIT_BITS <= KEY_BITS else (k, r + 1)
    return replace(splitter, depth=deeper, key=k, row=r, below=below, done=True)


def find_splitters(sizes: DataFrame, shards: int, total: int, tolerance: float) -> list[Splitter]:
    """Boundaries between the shards, each within ``tolerance`` of a shard's bytes.

    With no tolerance they are exact: a row belongs to shard ``floor(shards * b / total)``
    where ``b`` is the number of bytes of all rows before it.
    """
    allowed = int(tolerance * total / shards)
    splitters = [Splitter(-(-i * total // shards)) for i in range(1, shards)]
    for depth in range((KEY_BITS + ROW_BITS) // DIGIT_BITS):
        open_ = [s for s in splitters if not s.done]
        if not open_:
            break
        counts = _counted(sizes, depth, open_)
        splitters = [
            s if s.done else _step(s, counts[s.key, s.row], allowed) for s in splitters
        ]
    return splitters


def _shard_of(bounds: list[tuple[int, int]], low: int = 0) -> Column:
    """Number of boundaries at or below a row, by halving the list of boundaries."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    key, row = bounds[mid]
    above = (F.col("_key") > key) | ((F.col("_key") == key) & (F.col("_row") >= row))
    return F.when(above, _shard_of(bounds[mid + 1:], low + mid + 1)).otherwise(
        _shard_of(bounds[:mid], low)
    )


def shard_rows(
    rows: DataFrame,
    size: Column,
    key_columns: list[str],
    shards: int = 8,
    tolerance: float = 0.0,
) -> DataFrame:
    """The rows with columns ``shard`` and ``slot``, shards nearly equal in summed ``size``.

    A shard is a range of the sort key; ``slot`` numbers its rows from 0 in the order of
    the key. The numbering works on pieces of a shard, so no task gets a whole shard, nor
    all rows of one key. Rows are settled once, since rows equal in all key columns are told apart
    by their place. Columns of the rows named ``shard`` or ``slot`` are replaced; all others come
    through whatever their names.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    # Partition and place of a row: 24 bits and 36 bits.
    place = F.monotonically_increasing_id()
    parts = F.shiftleft(F.shiftright(place, 33), 36) + place.bitwiseAND((1 << 33) - 1)
    placed = settle(
        rows.select(
            F.struct(*[F.col(f"`{c}`") for c in names]).alias("_kept"),
            sort_key(key_columns).alias("_key"), size.alias("_size"), parts.alias("_row"),
        ),
        "placed",
    )
    sizes = placed.select("_key", "_row", "_size")
    count, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    bounds = [s.bound for s in find_splitters(sizes, shards, total, tolerance)] if count else []
    bits = min(KEY_BITS, max(0, (count // PIECE_ROWS).bit_length() + 3))
    prefix = F.shiftright("_key", KEY_BITS - bits)
    large = settle(
        sizes.groupBy(prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > HOT_TIMES * PIECE_ROWS).select("_prefix", F.lit(True).alias("_large")),
        "large_pieces",
    )

    def in_pieces(keyed: DataFrame) -> DataFrame:
        """The rows with shard and piece; pieces are ranges in the order of the sort key."""
        marked = keyed.withColumn("_prefix", prefix).join(large, "_prefix", "left")
        cut = [
            F.when(F.col("_large"), value).otherwise(0).alias(name)
            for name, value in (("key", F.col("_key")), ("part", F.shiftright("_row", 36)))
        ]
        return marked.withColumns({"shard": _shard_of(bounds), "_piece": F.struct("_prefix", *cut)})

    counted = in_pieces(sizes).groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counted.select(
        "shard", "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    in_piece = Window.partitionBy("shard", "_piece").orderBy("_key", "_row")
    numbered = in_pieces(placed).withColumn("_no", F.row_number().over(in_piece) - 1)
    slot = (F.col("_offset") + F.col("_no")).alias("slot")
    return numbered.join(offsets, ["shard", "_piece"]).select("_kept.*", "shard", slot)
