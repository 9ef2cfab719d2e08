"""Log probabilities of texts from a hashed maximum-entropy model.

A token's probability is that of its class given the tokens before it, times that of the
token in its class given the same tokens. The class is a softmax over sums of hashed feature
weights: the last token, the last two, and the token before the last alone (a skip). Features are
hashed from the bytes of the tokens, so every token is a context of its own, however rare.

Inside a class the token is found by binary decisions down a Huffman tree, each a logistic model
of the same features, hashed together with the place in the tree, that starts from the counts.
The most frequent tokens, ``LEARNED`` at most, are leaves; all others of a class, and those seen
once, share one leaf, in which they have counted shares, and the unseen token that of tokens seen once.

Counts are taken over all training texts. The most frequent tokens, ``HEAD`` at most, are
sent to all tasks; all others are joined to their counts by Spark, exactly. The most
frequent few are classes of their own, the rest are classed by their last two bytes.

All weights are trained by distributed gradient updates over all training texts: in each of
``ROUNDS`` rounds every task takes the texts of that round in its partition in small
batches from the common weights, and the changes of all tasks are averaged, each bucket
weighted by its use.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffcast.llm.common import lower_words, settle, utf8

#: Tokens sent to all tasks with their counts, at most.
HEAD = 1 << 18
OWN_CLASSES = 8
SUFFIX_CLASSES = 8
CLASSES = OWN_CLASSES + SUFFIX_CLASSES
#: Buckets of each kind of feature: last token, last two, token before the last.
BUCKETS = (1 << 12, 1 << 13, 1 << 12)
#: Tokens that are leaves of the trees, at most.
LEARNED = 1 << 16
#: Bits of a hashed weight's number in the table of all decisions.
INSIDE_BITS = 18
ROUNDS = 2
RATE = 0.3
#: The same for the decisions inside a class, and what their Adagrad starts from.
INSIDE_RATE, INSIDE_START = 0.1, 1.0
BATCH_TOKENS = 1 << 14
#: Distinct tokens that a task counts before it passes them on.
COUNTED = 1 << 16
#: Bound of summed weights, so that their exponentials and the sums of these are finite.
FARTHEST = 60
#: The end of a text as a token; no word is empty.
END = b""
#: Buckets that travel together when changes are averaged.
BLOCK = 1 << 10
#: Steps of a doubling in which counts are told apart when the head is chosen.
STEPS = 16


def suffix_class(token: bytes) -> int:
    return crc32(token[-2:]) % SUFFIX_CLASSES


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(token, n) over all texts, with one end each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in utf8(batch.column(0)):
                counts[END] += 1
                for words in lower_words(value):
                    counts.update(words)
                if len(counts) >= COUNTED:
                    yield _counted(counts)
                    counts = Counter()
        if counts:
            yield _counted(counts)

    rows = docs.select(F.col(f"`{text}`").cast("string"))
    counted = rows.mapInArrow(run, "token binary, n bigint")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    arrays = [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["token", "n"])


@dataclass(frozen=True)
class Vocabulary:
    """The head tokens by number, their counts, and what the classes hold.

    Numbers from ``len(counts)`` on stand for the suffix classes of other tokens. ``marks``
    are the CRC-32 of the head tokens, from which features are hashed.
    """

    numbers: dict[bytes, int]
    marks: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    totals: np.ndarray
    unseen: np.ndarray
    tokens: int
    distinct: int
    #: Leaf of every symbol: 0 for a class of its own, then what is left of the suffix classes, then
    #: the learned tokens. The decisions of leaf i are those from ``starts[i]`` to ``starts[i + 1]``:
    #: the node, and 1 or -1 for the side. ``odds`` are the counted log odds of the nodes.
    leaves: np.ndarray | None = None
    starts: np.ndarray | None = None
    nodes: np.ndarray | None = None
    sides: np.ndarray | None = None
    odds: np.ndarray | None = None
    #: What the leaves of the suffix classes hold, with the unseen token.
    rest: np.ndarray | None = None

    @property
    def before(self) -> int:
        """The mark of the place before a text, which no token has."""
        return 1 << 32

    def symbols(self, texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Numbers and marks of a text's tokens and end, and its tokens outside the head in order."""
        head = len(self.counts)
        for text in texts:
            parts, marks, others = [], [], []
            for words in lower_words(text):
                ids = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))
                at = np.flatnonzero(ids < 0)
                found = self.marks[ids]
                if len(at):
                    rare = [words[i] for i in at.tolist()]
                    found[at] = np.fromiter(map(crc32, rare), np.int64, len(rare))
                    ids[at] = [head + suffix_class(w) for w in rare]
                    others += rare
                parts.append(ids)
                marks.append(found)
            end = self.numbers.get(END, -1)
            parts.append(np.array([end if end >= 0 else head + suffix_class(END)], np.int32))
            if end < 0:
                others.append(END)
            marks.append(np.array([crc32(END)], np.int64))
            yield np.concatenate(parts), np.concatenate(marks), others


def huffman(groups: list[list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``starts``, ``nodes``, ``sides`` and ``odds`` of a tree for each group of (leaf, what it holds).

    The leaves of all groups are numbered from 1, without gaps; leaf 0 has no decisions.
    """
    n_leaves = 1 + sum(map(len, groups))
    # Places below ``n_leaves`` are leaves, the others nodes.
    above, side = np.full(2 * n_leaves, -1, np.int64), np.zeros(2 * n_leaves, np.int8)
    odds = []
    for group in groups:
        heap = [(held, leaf) for leaf, held in group]
        heapq.heapify(heap)
        while len(heap) > 1:
            (less, a), (more, b) = heapq.heappop(heap), heapq.heappop(heap)
            node = n_leaves + len(odds)
            above[a], above[b], side[a], side[b] = node, node, -1, 1
            odds.append(math.log(more / less))
            heapq.heappush(heap, (less + more, node))
    at = own = np.arange(n_leaves)
    found = [(at[:0], at[:0], side[:0])]
    while len(own := own[above[at] >= 0]):
        at = at[above[at] >= 0]
        found.append((own, above[at] - n_leaves, side[at]))
        at = above[at]
    leaf, nodes, sides = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(leaf, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(leaf, minlength=n_leaves))]
    return starts, nodes[order].astype(np.uint32), sides[order], np.array(odds, np.float32)


def _least(sizes: list, most: int) -> int:
    """The count from which there are no more than ``most`` tokens."""
    least, held = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        held += r["tokens"]
        if held > most:
            break
        least = r["least"]
    return least


def read_vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary, and the count from which tokens are in its head."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("n"), F.min("n").alias("least")
    ).collect()
    learned_from = max(2, _least(sizes, LEARNED))
    least = min(_least(sizes, HEAD), learned_from)
    # The classes of their own are the most frequent tokens, however many share the next count.
    most = counts.orderBy(F.desc("n"), "token").limit(OWN_CLASSES)
    frequent = {bytes(r["token"]): r["n"] for r in [*most.collect(), *counts.where(F.col("n") >= least).collect()]}
    head = sorted(((n, t) for t, n in frequent.items()), key=lambda x: (-x[0], x[1]))
    numbers = {token: i for i, (_, token) in enumerate(head)}
    own = [t for _, t in head[:OWN_CLASSES]]
    classes = [own.index(t) if i < len(own) else OWN_CLASSES + suffix_class(t) for i, (_, t) in enumerate(head)]
    classes += [OWN_CLASSES + g for g in range(SUFFIX_CLASSES)]
    suffix = (F.crc32(F.substring("token", -2, 2)) % SUFFIX_CLASSES).cast("int")
    per_class = counts.groupBy(suffix.alias("g")).agg(
        F.sum("n").alias("n"), F.count(F.when(F.col("n") == 1, 1)).alias("once")
    ).collect()
    totals, unseen = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        totals[OWN_CLASSES + r["g"]], unseen[OWN_CLASSES + r["g"]] = r["n"], r["once"]
    for i, token in enumerate(own):
        totals[i] = head[i][0]
        totals[OWN_CLASSES + suffix_class(token)] -= head[i][0]
        unseen[OWN_CLASSES + suffix_class(token)] -= head[i][0] == 1
    # A class by suffix always leaves something to a token never seen.
    unseen[OWN_CLASSES:] += 1
    leaves, learned = np.array(classes) - OWN_CLASSES + 1, [[] for _ in range(SUFFIX_CLASSES)]
    leaves[:len(own)] = 0
    rest = (totals + unseen)[OWN_CLASSES:]
    for i, (n, _) in enumerate(head):
        if i >= OWN_CLASSES and n >= learned_from:
            group = leaves[i] - 1
            rest[group] -= n
            learned[group].append((1 + SUFFIX_CLASSES + i - OWN_CLASSES, n))
            leaves[i] = learned[group][-1][0]
    trees = huffman([[(1 + g, held), *learned[g]] for g, held in enumerate(rest)])
    vocabulary = Vocabulary(
        numbers, np.array([*(crc32(t) for _, t in head), 0], np.int64), np.array([n for n, _ in head], np.int64), np.array(classes, np.int64), totals, unseen,
        sum(r["n"] for r in sizes), sum(r["tokens"] for r in sizes),
        leaves, *trees, rest,
    )
    return vocabulary, least


def features(marks: list[np.ndarray], before: int) -> list[np.ndarray]:
    """Buckets of the three features for every token of the texts."""
    padded = [np.r_[np.int64(before), np.int64(before), m[:-1]] for m in marks]
    last = np.concatenate([p[1:] for p in padded]).astype(np.uint64)
    second = np.concatenate([p[:-1] for p in padded]).astype(np.uint64)
    mixed = (last, last * np.uint64(0x9E3779B97F4A7C15) + second, second + np.uint64(1 << 32))
    found = []
    for value, size in zip(mixed, BUCKETS, strict=True):
        hashed = (value * np.uint64(0xD6E8FEB86659FD93)) ^ (value >> np.uint64(29))
        hashed *= np.uint64(0xA0761D6478BD642F)
        found.append((hashed >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64))
    return found


def class_sums(buckets: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Summed feature weights of every class, a row for each token, none beyond ``FARTHEST``."""
    bias, *tables = weights
    sums = tables[0].take(buckets[0], axis=0)
    for table, at in zip(tables[1:], buckets[1:], strict=True):
        sums += table.take(at, axis=0)
    sums += bias
    return np.clip(sums, -FARTHEST, FARTHEST, out=sums)


def class_scores(buckets: list[np.ndarray], weights: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each token's own class."""
    sums = class_sums(buckets, weights)
    chosen = sums[np.arange(len(own)), own]
    return chosen - np.log(np.exp(sums, out=sums).sum(axis=1))


def decisions(
    buckets: list[np.ndarray], leaves: np.ndarray, vocabulary: Vocabulary
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Number of decisions of each token; of every decision its node, its side and its weights."""
    lengths = vocabulary.starts[leaves + 1] - vocabulary.starts[leaves]
    ends = np.cumsum(lengths)
    places = np.repeat(vocabulary.starts[leaves] - ends + lengths, lengths) + np.arange(ends[-1])
    nodes = vocabulary.nodes[places]
    marks = nodes * np.uint32(0x9E3779B1)
    slots = []
    for kind, bucket in enumerate(buckets):
        own = (bucket * len(BUCKETS) + kind + 1).astype(np.uint32) * np.uint32(0x85EBCA6B)
        mixed = np.repeat(own, lengths)
        mixed ^= marks
        mixed *= np.uint32(0xC2B2AE35)
        mixed >>= np.uint32(32 - INSIDE_BITS)
        slots.append(mixed.astype(np.int64))
    return lengths, nodes, vocabulary.sides[places], slots


def margins(nodes: np.ndarray, sides: np.ndarray, slots: list[np.ndarray], odds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of every decision for the side that was taken."""
    sums = odds[nodes]
    table = weights[:, 0]
    for at in slots:
        sums += table.take(at)
    sums *= sides
    return np.clip(sums, -FARTHEST, FARTHEST, out=sums)


def inside_scores(buckets: list[np.ndarray], leaves: np.ndarray, vocabulary: Vocabulary, weights: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each token's leaf in its class."""
    lengths, nodes, sides, slots = decisions(buckets, leaves, vocabulary)
    taken = margins(nodes, sides, slots, vocabulary.odds, weights)
    np.negative(taken, out=taken)
    np.exp(taken, out=taken)
    taken += 1
    np.log(taken, out=taken)
    return -np.bincount(np.repeat(np.arange(len(leaves)), lengths), taken, len(leaves))


class Learner:
    """Adagrad on the cross entropy of classes and of decisions in them, with the use of every bucket.

    The weights of the decisions, if any, are the last table.
    """

    def __init__(self, weights: list[np.ndarray]):
        self.start = weights
        self.weights = [w.copy() for w in weights]
        self.speed = [np.full_like(w, INSIDE_START if t > len(BUCKETS) else 1e-6) for t, w in enumerate(weights)]
        self.used = [np.zeros(len(w), np.float32) for w in weights[1:]]
        self.tokens = 0

    def learn(
        self, buckets: list[np.ndarray], classes: np.ndarray,
        leaves: np.ndarray | None = None, vocabulary: Vocabulary | None = None,
    ) -> None:
        """Steps over about ``BATCH_TOKENS`` tokens each."""
        bounds = np.linspace(0, len(classes), max(1, round(len(classes) / BATCH_TOKENS)) + 1).astype(int)
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            part = [b[first:last] for b in buckets]
            own = classes[first:last]
            error = class_sums(part, self.weights[:1 + len(BUCKETS)])
            np.exp(error, out=error)
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(own)), own] -= 1
            self._update(0, error.sum(axis=0))
            # Sums by bucket and class at once, over whole tables: quicker than the rows in use.
            flat, places = error.ravel().astype(np.float64), np.empty(error.shape, np.int64)
            for t, (at, used) in enumerate(zip(part, self.used[:len(BUCKETS)], strict=True)):
                np.add(at[:, None] * CLASSES, np.arange(CLASSES), out=places)
                gradient = np.bincount(places.ravel(), flat, len(used) * CLASSES).astype(np.float32)
                self._update(t + 1, gradient.reshape(-1, CLASSES))
                used += np.bincount(at, minlength=len(used)).astype(np.float32)
            self.tokens += len(own)
            if leaves is not None:
                self._decide(part, leaves[first:last], vocabulary)

    def _decide(self, buckets: list[np.ndarray], leaves: np.ndarray, vocabulary: Vocabulary) -> None:
        _, nodes, sides, slots = decisions(buckets, leaves, vocabulary)
        error = margins(nodes, sides, slots, vocabulary.odds, self.weights[-1])
        np.exp(error, out=error)
        error += 1
        np.divide(sides, error, out=error)
        gradient = -np.bincount(np.concatenate(slots), np.tile(error, len(slots)), len(self.weights[-1]))
        self._update(len(self.weights) - 1, gradient.astype(np.float32)[:, None])
        # The use of a decision's weight is what it has learned from, not how often it was asked.
        self.used[-1] = self.speed[-1][:, 0] - INSIDE_START

    def _update(self, table: int, gradient: np.ndarray) -> None:
        """A step of Adagrad; where the gradient is zero nothing changes."""
        speed = self.speed[table]
        speed += gradient * gradient
        gradient *= INSIDE_RATE if table > len(BUCKETS) else RATE
        gradient /= np.sqrt(speed)
        self.weights[table] -= gradient

    def changes(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, use, change times use): the bias is the block -1."""
        bias = (self.weights[0] - self.start[0]) * self.tokens
        yield -1, np.float32([self.tokens]).tobytes(), bias.astype(np.float32).tobytes()
        block = 0
        for new, old, used in zip(self.weights[1:], self.start[1:], self.used, strict=True):
            step = block_rows(new)
            for i in range(0, len(used), step):
                use = used[i:i + step]
                change = (new[i:i + step] - old[i:i + step]) * use[:, None]
                yield block, use.tobytes(), change.astype(np.float32).tobytes()
                block += 1


def block_rows(table: np.ndarray) -> int:
    return BLOCK * CLASSES // table.shape[1]


def _groups(
    texts: Iterable[bytes], vocabulary: Vocabulary
) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], list[list[bytes]]]]:
    """Symbols of several texts, together about ``BATCH_TOKENS`` tokens."""
    symbols, marks, others, held = [], [], [], 0
    for found, own, rare in vocabulary.symbols(texts):
        symbols.append(found)
        marks.append(own)
        others.append(rare)
        held += len(found)
        if held >= BATCH_TOKENS:
            yield symbols, marks, others
            symbols, marks, others, held = [], [], [], 0
    if symbols:
        yield symbols, marks, others


def train(docs: DataFrame, text: str, vocabulary_sent, weights: list[np.ndarray], turn: Column) -> list[np.ndarray]:
    """Weights after ``ROUNDS`` rounds; ``turn`` is the round of a text."""
    spark = docs.sparkSession
    schema = "block int, share int, used binary, change binary"

    def summed(key_, group):
        used, change = (
            sum(np.frombuffer(v.as_py(), np.float32).astype(np.float64) for v in group.column(c))
            for c in ("used", "change")
        )
        arrays = [
            pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([0], pa.int32()),
            pa.array([used.astype(np.float32).tobytes()], pa.binary()),
            pa.array([change.astype(np.float32).tobytes()], pa.binary()),
        ]
        return pa.table(arrays, ["block", "share", "used", "change"])

    for nth in range(ROUNDS):
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocabulary = Vocabulary(**vocabulary_sent.value)
            learner = Learner(sent.value)
            texts = (t for batch in batches for t in utf8(batch.column(0)))
            for symbols, marks, _ in _groups(texts, vocabulary):
                flat = np.concatenate(symbols)
                buckets = features(marks, vocabulary.before)
                learner.learn(buckets, vocabulary.classes[flat], vocabulary.leaves[flat], vocabulary)
            if learner.tokens:
                blocks, used, change = zip(*learner.changes(), strict=True)
                share = [TaskContext.get().partitionId() % SHARES] * len(blocks)
                arrays = [pa.array(blocks, pa.int32()), pa.array(share, pa.int32()),
                          pa.array(used, pa.binary()), pa.array(change, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "share", "used", "change"])

        rows = docs.where(turn == nth).select(F.col(f"`{text}`").cast("string"))
        changes = rows.mapInArrow(run, schema)
        # Twice, so that no task gets the changes of all others.
        for keys in (["block", "share"], ["block"]):
            changes = changes.groupBy(*keys).applyInArrow(summed, schema)
        weights = _moved(weights, changes.collect())
    return weights


#: Groups in which the changes of tasks are first summed.
SHARES = 64


def _moved(weights: list[np.ndarray], changes: list) -> list[np.ndarray]:
    """The weights after the mean changes; a bucket without use stays."""
    blocks = {r["block"]: (np.frombuffer(r["used"], np.float32), np.frombuffer(r["change"], np.float32)) for r in changes}
    if not blocks:
        return weights
    bias_used, bias = blocks.pop(-1)
    moved, block = [weights[0] + bias / bias_used[0]], 0
    for table in weights[1:]:
        new = table.copy()
        for i in range(0, len(table), step := block_rows(table)):
            used, change = blocks[block]
            new[i:i + step] += change.reshape(len(used), -1) / np.where(used > 0, used, 1)[:, None]
            block += 1
        moved.append(new)
    return moved


PART = "n_tokens bigint, known bigint, base double, model double, token binary, times bigint"


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, training, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Learns from the rows that ``training`` marks. A null text is an empty one and has its
    end as only token. Repeated rows repeat; without training texts nothing is known, and
    every token has the chance of an unseen one.
    """
    spark = docs.sparkSession
    value = F.col(f"`{text}`").cast("string")
    learned = docs.where(training)
    counts = settle(count_tokens(learned, text), "token_counts")
    vocabulary, least = read_vocabulary(counts)
    vocabulary_sent = spark.sparkContext.broadcast(vars(vocabulary))
    share = vocabulary.totals + vocabulary.unseen
    bias = np.log(share / share.sum(), where=share > 0, out=np.full(CLASSES, -30.0)).astype(np.float32)
    weights = [bias, *[np.zeros((b, CLASSES), np.float32) for b in BUCKETS]]
    weights.append(np.zeros((1 << INSIDE_BITS, 1), np.float32))
    turn = F.pmod(F.xxhash64(value), F.lit(ROUNDS))
    weights = train(learned, text, vocabulary_sent, weights, turn)
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = Vocabulary(**vocabulary_sent.value), sent.value
        tables = _token_scores(vocabulary)
        for batch in batches:
            done = 0
            for symbols, marks, others in _groups(utf8(batch.column(3)), vocabulary):
                rows = batch.slice(done, len(symbols)).select(range(3))
                yield _scored(rows, symbols, marks, others, vocabulary, weights, tables)
                done += len(symbols)

    # The numbers of the rows link what one task gives for a text, and are settled with it.
    number = F.monotonically_increasing_id().alias("row")
    named = docs.select(number, F.col(f"`{key}`").alias("key"), training.alias("training"), value.alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    parts = settle(named.mapInArrow(run, f"row bigint, key {kind}, training boolean, {PART}"), "scores")
    rare = parts.where("token IS NOT NULL").select("row", "token", "times", "known")
    known = counts.where(F.col("n") < least)
    n = F.coalesce("n", F.lit(0))
    unseen = F.element_at(F.array(*[F.lit(float(x)) for x in vocabulary.unseen]), F.col("known").cast("int") + 1)
    joined = rare.join(known, "token", "left").select(
        "row",
        F.when(n > 0, F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10(n + 1)).alias("base"),
        (F.col("times") * F.log10(F.when(n > 0, n.cast("double")).otherwise(unseen))).alias("model"),
    )
    whole = parts.where("token IS NULL").select("row", "known", "base", "model")
    sums = whole.union(joined.select("row", F.col("known").cast("bigint"), "base", "model")).groupBy("row").agg(
        F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score")
    )
    texts = parts.where("token IS NULL").select("row", F.col("key").alias(key), "training", "n_tokens")
    train_tokens = F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens")
    return texts.join(sums, "row").select(
        F.col(f"`{key}`"), "training", "n_tokens", "n_known", train_tokens, "base_score", "score"
    )


def _token_scores(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol: whether it is known, its base score, and its score in its leaf.

    For tokens outside the head both lack the logarithm of the count; a learned token has its leaf alone.
    """
    head = len(vocabulary.counts)
    counts = np.r_[vocabulary.counts, np.ones(SUFFIX_CLASSES)]
    space = vocabulary.tokens + vocabulary.distinct + 1
    base = np.log10(np.r_[vocabulary.counts + 1, np.ones(SUFFIX_CLASSES)]) - np.log10(space)
    shared = (vocabulary.leaves > 0) & (vocabulary.leaves <= SUFFIX_CLASSES)
    inside = np.zeros(len(counts))
    inside[shared] = np.log10(counts[shared]) - np.log10(vocabulary.rest[vocabulary.leaves[shared] - 1])
    return np.arange(head + SUFFIX_CLASSES) < head, base, inside


def _scored(
    rows: pa.RecordBatch, symbols, marks, others, vocabulary: Vocabulary, weights, tables
) -> pa.RecordBatch:
    """A row per text with what the head tells, and one per text and token outside it."""
    known, base, inside = tables
    flat = np.concatenate(symbols)
    bounds = np.cumsum([0, *map(len, symbols)])
    buckets, classes = features(marks, vocabulary.before), vocabulary.classes[flat]
    leaves = vocabulary.leaves[flat]
    model = np.empty(len(flat))
    for i in range(0, len(flat), BATCH_TOKENS):
        own = classes[i:i + BATCH_TOKENS]
        part = [b[i:i + BATCH_TOKENS] for b in buckets]
        natural = class_scores(part, weights[:-1], own)
        natural += inside_scores(part, leaves[i:i + BATCH_TOKENS], vocabulary, weights[-1])
        model[i:i + BATCH_TOKENS] = natural / np.log(10)
    model += inside[flat]
    starts = bounds[:-1]
    rare_rows, tokens, times = [], [], []
    for i, rare in enumerate(others):
        counts = Counter(rare)
        rare_rows += [i] * len(counts)
        tokens += counts.keys()
        times += counts.values()
    n, m = len(symbols), len(tokens)
    none = [None] * m
    classes_of = [OWN_CLASSES + suffix_class(t) for t in tokens]
    kept = rows.take(pa.array([*range(n), *rare_rows], pa.int64()))
    return pa.RecordBatch.from_arrays([
        *kept.columns,
        pa.array([*np.diff(bounds).tolist(), *none], pa.int64()),
        pa.array([*np.add.reduceat(known[flat].astype(np.int64), starts).tolist(), *classes_of], pa.int64()),
        pa.array([*np.add.reduceat(base[flat], starts).tolist(), *none], pa.float64()),
        pa.array([*np.add.reduceat(model, starts).tolist(), *none], pa.float64()),
        pa.array([*[None] * n, *tokens], pa.binary()),
        pa.array([*[None] * n, *times], pa.int64()),
    ], ["row", "key", "training", *[c.split()[0] for c in PART.split(", ")]])
