"""Nearest neighbours by collision counting over sorted projections.

Vectors are projected on random directions; every direction keeps one sorted array of its
projections. A window around the query's own projection in each array holds the vectors
that collide with the query there. Windows are widened by virtual rehashing: the first ones are
of one width, and the vectors that collide most often in them are verified with their exact
products. The distance of the last one wanted then tells how wide the windows have to be, and
every vector that collides there in at least ``THRESHOLD`` of the arrays is verified.

At ``WIDEN`` times a distance, the chance that a vector at that distance collides is
0.823, and 0.72 for one that lies at a right angle where the twentieth of some ten thousand random
vectors lies. The threshold is between the two: a vector as near as the last one wanted is missed
with a chance of about 0.5 %, nearer ones with less, and most others are not verified.

The largest inner product is the smallest distance once every vector gets one more
component that brings all to one length, and queries get a zero there.

Equal vectors are searched as one, with the smallest of their ids. Distinct vectors are
dealt to parts by a hash of their smallest id, queries to blocks; one task has the arrays
of one part and searches them for the queries of one block. The best of all parts are
merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffcast.llm.common import settle

NEAREST = 20
PROJECTIONS = 192
#: Arrays and half width of the first windows, in standard deviations of the projections, and how
#: many vectors are verified after them, as a multiple of those wanted.
FIRST_PROJECTIONS, FIRST_WIDTH, FIRST_TIMES = 64, 1.2, 30
#: Half width of the last windows, as a multiple of the distance of the last vector wanted.
WIDEN = 1.35
#: Part of the projections in which a vector must collide there to be verified.
THRESHOLD = 0.755
PART_ROWS = 1 << 14
QUERY_BLOCK = 1 << 13
SEED = 5


@dataclass
class Part:
    """The distinct vectors of one part with their sorted projections and smallest ids.

    ``values`` are the sorted arrays, ``ranks`` the places of the vectors in them: a vector is in
    a window if its place lies between those where the window starts and ends.
    """

    ids: list[np.ndarray]
    vectors: np.ndarray
    longest: float
    directions: np.ndarray
    ranks: np.ndarray
    values: np.ndarray
    lift: np.ndarray
    verified: int = 0

    @classmethod
    def build(cls, ids: list[np.ndarray], vectors: np.ndarray, longest: float) -> Part:
        scaled = vectors / (longest or 1.0)
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
        random = np.random.default_rng(SEED)
        directions = random.normal(size=(PROJECTIONS, vectors.shape[1] + 1))
        values = directions @ np.c_[scaled, rest].T
        n = len(ids)
        ranks = np.empty(values.shape, np.uint16 if n < 1 << 16 else np.uint32)
        for row, own in zip(values, ranks):
            own[np.argsort(row, kind="stable")] = np.arange(n, dtype=ranks.dtype)
        values.sort(axis=1)
        # All arrays in one, each lifted above the one before it, for a search in a single call.
        lift = 2 * (np.abs(directions).sum(axis=1).max() + 1) * np.arange(PROJECTIONS)
        return cls(ids, vectors, longest or 1.0, directions, ranks, (values + lift[:, None]).ravel(), lift)

    def collisions(self, own: np.ndarray, width: float, arrays: int = PROJECTIONS) -> np.ndarray:
        """In how many windows of this half width around the query each vector lies."""
        n = len(self.ids)
        own, starts = own[:arrays], np.arange(arrays) * n
        low = np.clip(np.searchsorted(self.values, own - width) - starts, 0, n)
        sizes = np.clip(np.searchsorted(self.values, own + width, "right") - starts, 0, n) - low
        counts = np.zeros(n, np.uint8 if arrays < 256 else np.uint16)
        place, inside = np.empty(n, self.ranks.dtype), np.empty(n, bool)
        for ranks, first, size in zip(self.ranks, low.astype(place.dtype), sizes.astype(place.dtype)):
            # Places below the first one wrap around to very large ones.
            np.subtract(ranks, first, out=place)
            np.less(place, size, out=inside)
            np.add(counts, inside.view(np.uint8), out=counts)
        return counts

    def nearest(self, query_id: int, query: np.ndarray, count: int) -> list[tuple[int, float]]:
        """(id, product) of the best found, best first, without the query's own id."""
        n = len(self.ids)
        length = np.linalg.norm(query) or 1.0
        own = self.directions[:, :-1] @ (query / length) + self.lift
        # One more than wanted, since one may be the query itself.
        wanted = min(n, count + 1)
        first = min(n, FIRST_TIMES * wanted)
        found = np.arange(n)
        if first < n:
            often = self.collisions(own, FIRST_WIDTH, FIRST_PROJECTIONS)
            found = np.argpartition(often, n - first)[n - first:]
        products = self.vectors[found] @ query
        if first < n:
            worst = np.partition(products, first - wanted)[first - wanted]
            width = WIDEN * np.sqrt(max(0.0, 2 - 2 * worst / (length * self.longest)))
            crossed = self.collisions(own, width) >= THRESHOLD * PROJECTIONS
            crossed[found] = False
            new = np.flatnonzero(crossed)
            found, products = np.r_[found, new], np.r_[products, self.vectors[new] @ query]
        self.verified += len(found)
        edge = np.partition(products, len(found) - wanted)[len(found) - wanted]
        found = found[products >= edge - 1e-9 * (abs(edge) + length * self.longest)]
        # Row by row in one order, so that a product is the same in every part.
        scores = (self.vectors[found] * query).sum(axis=1)
        ids = np.concatenate([np.empty(0, np.int64), *[self.ids[i] for i in found]])
        products = np.repeat(scores, [len(self.ids[i]) for i in found])
        ids, products = ids[ids != query_id], products[ids != query_id]
        best = np.lexsort((ids, -products))[:count]
        return [(int(ids[i]), float(products[i])) for i in best]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part: doubles, with an id, finite, not zero."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & sound & F.exists(v, lambda x: x != 0))


def nearest(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", count: int = NEAREST
) -> DataFrame:
    """(query_id, rank, id, score): for each query the vectors of largest inner product.

    ``is_query`` is a condition on ``id``. Vectors are compared with those of their own
    length. Null, zero and non-finite vectors and rows without id take no part, of repeated
    ids the smallest vector does; ties go to the smaller id. A query with fewer vectors to
    find gets them all; one without any gets no row.
    """
    dim = F.size("v").alias("dim")
    rows = settle(usable(vectors, key, vector).groupBy(dim, "id").agg(F.min("v").alias("v")), "vectors")
    # Of equal vectors no more ids are wanted than the best and the query's own.
    smallest = F.row_number().over(Window.partitionBy("dim", "v").orderBy("id"))
    kept = rows.withColumn("nth", smallest).where(F.col("nth") <= count + 1)
    ids = F.array_sort(F.collect_list("id")).alias("ids")
    distinct = settle(kept.groupBy("dim", "v").agg(ids), "distinct")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    queries = rows.where(is_query)
    sized = distinct.groupBy("dim").agg(
        F.max(norm).alias("longest"),
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PART_ROWS)).cast("int").alias("parts"),
    )
    asked_here = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    sized = settle(sized.join(asked_here, "dim"), "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    asked = queries.join(sized, "dim").select("dim", every("parts").alias("part"), block.alias("block"), "id", "v")
    asked = settle(asked, "asked")
    part_of = F.pmod(F.xxhash64(F.col("ids")[0]), F.col("parts")).cast("int")
    members = distinct.join(sized, "dim").select(
        "dim", part_of.alias("part"), every("blocks").alias("block"), "ids", "v", "longest"
    )
    one_task = ["dim", "part", "block"]

    def search(key_, group, asked_):
        out: list[tuple[int, int, float]] = []
        if group.num_rows and asked_.num_rows:
            ids = [np.array(x, np.int64) for x in group.column("ids").to_pylist()]
            part = Part.build(ids, _matrix(group), group.column("longest")[0].as_py())
            for query_id, query in zip(asked_.column("id").to_pylist(), _matrix(asked_), strict=True):
                out += [(query_id, i, s) for i, s in part.nearest(query_id, query, count)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_id", "id", "score"])

    found = (
        members.groupBy(*one_task).cogroup(asked.groupBy(*one_task))
        .applyInArrow(search, "query_id bigint, id bigint, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "id", "score")


def _matrix(group: pa.Table) -> np.ndarray:
    flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(group.num_rows, -1)
