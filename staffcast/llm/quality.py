"""Quality grades by ordinal cumulative-link regression on hashed text.

Every document has one score, the sum of shared weights of its hashed features; ordered
thresholds part the scores into grades: ``P(grade > k) = sigmoid(score - threshold[k])``.
From these follow the expected grade and the tail probability that selects documents.

Features are the presence of word beginnings and endings, and how many words repeat the
word before them. Before the fit each feature is scaled by its log odds between lower and
higher grades, so that features without a lean stay small. Weights are shared by all grades.

The model is fitted on a bounded sample of rated documents, ``SAMPLE_ROWS`` at most, drawn
by a hash of the key; every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffcast.llm.common import lower_words, utf8

#: Rated documents that the model is fitted on, at most.
SAMPLE_ROWS = 4_000
BUCKETS = 1 << 18
#: Bytes of the beginnings and endings of words.
HEADS, TAILS = (4, 6), (2,)
#: The last buckets tell the share of repeated words: over 1/256, 1/128, up to 1/2.
SHARES = 8
#: Sampled documents that a feature must occur in.
LEAST_DOCS = 5
SMOOTHING = 0.5
ROUNDS = 120
RATE, MOMENTUM, THRESHOLD_RATE = 0.5, 0.9, 0.3
DECAY = 1e-4
#: Long texts have more features; scores are divided by this power of their number.
LENGTH_POWER = 0.25
KEEP_AT = 0.5


def features(text: bytes) -> np.ndarray:
    """Sorted distinct buckets of a text; an empty one has none."""
    sizes = [slice(k) for k in HEADS] + [slice(-k, None) for k in TAILS]
    seen: list[set[bytes]] = [set() for _ in sizes]
    words, repeats, last = 0, 0, b""
    for part in filter(None, lower_words(text)):
        for found, size in zip(seen, sizes, strict=True):
            found.update([w[size] for w in part])
        words += len(part)
        repeats += sum(map(bytes.__eq__, part, chain((last,), part)))
        last = part[-1]
    if not words:
        return np.empty(0, np.int64)
    hashed = [np.fromiter(map(crc32, s, repeat(i)), np.int64, len(s)) for i, s in enumerate(seen)]
    over = sum(repeats << k > words for k in range(1, SHARES + 1))
    shares = BUCKETS - SHARES + np.arange(over)
    return np.unique(np.r_[np.concatenate(hashed) % (BUCKETS - SHARES), shares])


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """Row for each score: probability of a grade above 0, above 1, and so on."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def _lean(flat: np.ndarray, grades: np.ndarray, rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Scale of each feature: its largest log odds between the grades below and above a cut."""
    docs, scale = np.bincount(flat, minlength=BUCKETS), np.zeros(BUCKETS)
    for cut in cuts:
        above = np.bincount(flat[grades[rows] >= cut], minlength=BUCKETS)
        n = np.sum(grades >= cut)
        up = (above + SMOOTHING) / (n + SMOOTHING)
        down = (docs - above + SMOOTHING) / (len(grades) - n + SMOOTHING)
        scale = np.maximum(scale, np.abs(np.log(up / down)))
    return np.where(docs >= LEAST_DOCS, scale, 0)


def fit(buckets: list[np.ndarray], grades: np.ndarray, grade_count: int) -> OrdinalModel:
    """Maximum likelihood of the grades with a small decay, over all rows in every round.

    The thresholds start at the shares of the grades and stay in order, since their gaps
    are fitted as logarithms. Without rows nothing speaks against a document: all weights
    are zero and every document has the best grade.
    """
    n, cuts = len(grades), np.arange(1, grade_count)
    if not n:
        return OrdinalModel(np.zeros(BUCKETS, np.float32), np.full(len(cuts), -np.inf))
    sizes = np.array([len(b) for b in buckets], np.int64)
    rows = np.repeat(np.arange(n), sizes)
    flat = np.concatenate([np.empty(0, np.int64), *buckets]).astype(np.int64)
    scale = _lean(flat, grades, rows, cuts)
    kept = scale[flat] > 0
    rows, flat = rows[kept], flat[kept]
    value = scale[flat] / np.maximum(sizes, 1)[rows] ** LENGTH_POWER
    above = np.array([(np.sum(grades >= c) + 1) / (n + 2) for c in cuts])
    start = np.log((1 - above) / above)
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    weights, speed, seen = np.zeros(BUCKETS), np.zeros(BUCKETS), np.full(len(cuts), 1e-8)
    at = np.arange(n)
    for _ in range(ROUNDS):
        thresholds = first + np.r_[0, np.cumsum(np.exp(gaps))]
        scores = np.bincount(rows, weights[flat] * value, n)
        # Chance to be at or below each threshold, with the ends 0 and 1.
        low = 1 / (1 + np.exp(np.clip(scores[:, None] - thresholds[None, :], -500, 500)))
        edge = np.c_[np.zeros(n), low, np.ones(n)]
        slope = edge * (1 - edge)
        pull = 1 / np.maximum(edge[at, grades + 1] - edge[at, grades], 1e-12) / n
        by_score = -pull * (slope[at, grades + 1] - slope[at, grades])
        by_edge = np.zeros((n, grade_count + 1))
        by_edge[at, grades + 1] += pull * slope[at, grades + 1]
        by_edge[at, grades] -= pull * slope[at, grades]
        gradient = np.bincount(flat, by_score[rows] * value, BUCKETS) - DECAY * weights
        speed = MOMENTUM * speed + gradient
        weights += RATE * speed
        on_cut = by_edge[:, 1:-1].sum(axis=0)
        on_step = np.r_[on_cut.sum(), np.exp(gaps) * np.cumsum(on_cut[::-1])[::-1][1:]]
        seen += on_step**2
        step = THRESHOLD_RATE * on_step / np.sqrt(seen)
        first, gaps = first + step[0], gaps + step[1:]
    thresholds = first + np.r_[0, np.cumsum(np.exp(gaps))]
    return OrdinalModel((weights * scale).astype(np.float32), thresholds)


def rated_sample(
    docs: DataFrame, ratings: DataFrame, key: str, text: str, grade: str, rows: int
) -> list[tuple[int, np.ndarray]]:
    """Grades and features of at most ``rows`` rated documents, first by a hash of the key.

    The features are taken by Spark; the driver gets a bounded number of numbers.
    """
    drawn = (
        ratings.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{grade}`").cast("int").alias("_grade"))
        .where("_key IS NOT NULL AND _grade IS NOT NULL")
        .groupBy("_key").agg(F.min("_grade").alias("_grade"))
        .orderBy(F.xxhash64("_key"), "_key").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype(np.int32).tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["g", "f"])

    # The rated keys are bounded by ``rows``, so they may be sent to every task.
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    joined = texts.join(F.broadcast(drawn), "_key").select("_grade", "_text", "_key")
    one_each = joined.groupBy("_key", "_grade").agg(F.min("_text").alias("_text"))
    found = one_each.select("_grade", "_text").mapInArrow(run, "g int, f binary")
    return [(r["g"], np.frombuffer(r["f"], np.int32)) for r in found.collect()]


def fit_ratings(
    docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text",
    grade: str = "grade", grade_count: int = 3, rows: int = SAMPLE_ROWS,
) -> OrdinalModel:
    """Model of the grades 0 to ``grade_count - 1``.

    Null keys, grades and texts are not learned from; of several ratings of one key the
    lowest counts. Without any usable rating all weights are zero, every document has the
    best grade for certain, and so all of them are selected.
    """
    sample = rated_sample(docs.where(F.col(f"`{text}`").isNotNull()), ratings, key, text, grade, rows)
    sample = [(g, f) for g, f in sample if 0 <= g < grade_count]
    sample.sort(key=lambda x: (x[0], x[1].tobytes()))
    return fit([f for _, f in sample], np.array([g for g, _ in sample], np.int64), grade_count)


def score_texts(texts: Iterator[bytes], model: OrdinalModel) -> np.ndarray:
    """The score of every text: the weights of its features over a power of their number."""
    def one(text: bytes) -> float:
        found = features(text)
        return float(model.weights[found].sum()) / max(len(found), 1) ** LENGTH_POWER

    return np.fromiter(map(one, texts), np.float64)


GRADED = "score double, expected_grade double, tail double"


def graded(
    docs: DataFrame, model: OrdinalModel, keep: list[str], text: str = "text", at_least: int | None = None
) -> DataFrame:
    """The columns ``keep`` with score, expected grade and the chance of grade ``at_least``.

    ``at_least`` is the highest grade unless given. A null or empty text has score 0. Kept
    columns of the same names as the new ones give way.
    """
    keep = [c for c in keep if c not in ("score", "expected_grade", "tail")]
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    cut = (at_least or len(model.thresholds)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = OrdinalModel(*sent.value)
        for batch in batches:
            scores = score_texts(utf8(batch.column(0)), model)
            tails = model.tails(scores)
            arrays = [*batch.columns[1:], scores, tails.sum(axis=1), tails[:, cut]]
            arrays = [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "score", "expected_grade", "tail"])

    kept = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *kept)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, {GRADED}")


def ratings_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 poor, 2 good. A null mark makes no rating."""
    grade = F.when(F.col("toxic") == 1, 0).when(
        F.col("toxic").isNotNull(), F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    )
    return labels.select("doc_id", grade.alias("grade"))


def accepted(
    docs: DataFrame, model: OrdinalModel, text: str = "text", keep_at: float = KEEP_AT
) -> DataFrame:
    """The documents whose chance of the highest grade is at least ``keep_at``, as they are."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = OrdinalModel(*sent.value)
        for batch in batches:
            tails = model.tails(score_texts(utf8(batch.column(at)), model))
            yield batch.filter(pa.array(tails[:, -1] >= keep_at))

    return docs.mapInArrow(run, docs.schema)
