"""Spelling variants: words one edit apart, and the frequent word that a rare one stands for.

The near pairs of a vocabulary are what its minimised acceptor, a transducer of exactly
one edit and the acceptor again accept when they are composed. The composition is cut by its
initial states: every task gets the words that leave them by the same letters, builds the
acceptor of what follows, and enumerates the pairs that the composition accepts there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffcast.llm.common import settle

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Words of one initial state that a task takes at once; more are dealt out by more letters.
BOUND = 20_000
_OUT_ROWS = 50_000


class Acceptor:
    """Minimal acyclic automaton of sorted distinct words, which also numbers them.

    ``arcs[q]`` maps a letter to the next state and to the number of words of q that come
    before those of the arc, so that the numbers along a path add up to the place of its word.
    """

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        known: dict[tuple, int] = {}
        # The states of the last word that may still get arcs: arcs so far, and whether final.
        open_arcs: list[dict[str, int]] = [{}]
        open_final = [False]
        last = ""

        def close(depth: int) -> None:
            while len(open_arcs) > depth:
                arcs, final = open_arcs.pop(), open_final.pop()
                key = (final, *arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    before, numbered = int(final), {}
                    for letter, to in arcs.items():
                        numbered[letter] = (to, before)
                        before += self.words[to]
                    self.arcs.append(numbered)
                    self.final.append(final)
                    self.words.append(before)
                if open_arcs:
                    open_arcs[-1][last[len(open_arcs) - 1]] = state
                self.start = state

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            close(same + 1)
            for _ in range(same, len(word)):
                open_arcs.append({})
                open_final.append(False)
            open_final[-1] = True
            last = word
        close(0)


class OneEdit:
    """The composition of an acceptor, a transducer of exactly one edit, and the acceptor.

    Before the edit both sides are in one state; the edit leads to two states; from there both
    read the same. ``length`` is the length of the shorter word of a pair. Of the ways to
    delete a letter of a run of equal letters only the last counts, so that every pair
    is accepted by one path, and the edit comes right after its longest common prefix.
    """

    def __init__(self, acceptor: Acceptor, length: int):
        self.of, self.length = acceptor, length
        self._common: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        self._edits: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def common(self, x: int, y: int, rest: int) -> list[tuple[int, int]]:
        """Numbers, below x and below y, of the words of ``rest`` letters that both accept."""
        if not rest:
            return [(0, 0)] if self.of.final[x] and self.of.final[y] else []
        found = self._common.get((x, y, rest))
        if found is None:
            found = self._common[x, y, rest] = self._shared(x, y, rest, "")
        return found

    def _shared(self, x: int, y: int, rest: int, without: str) -> list[tuple[int, int]]:
        found, others = [], self.of.arcs[y]
        for letter, (tx, nx) in self.of.arcs[x].items():
            if letter != without and letter in others:
                ty, ny = others[letter]
                found += [(nx + a, ny + b) for a, b in self.common(tx, ty, rest - 1)]
        return found

    def edits(self, state: int, rest: int) -> list[tuple[int, int]]:
        """Numbers below ``state`` of the pairs edited there; ``rest`` letters of the shorter follow."""
        found = self._edits.get((state, rest))
        if found is not None:
            return found
        found = []
        arcs = list(self.of.arcs[state].items())
        for i, (letter, (to, before)) in enumerate(arcs):
            if rest:
                for _, (other, skipped) in arcs[i + 1:]:
                    found += [(before + a, skipped + b) for a, b in self.common(to, other, rest - 1)]
                if len(arcs) > 1:
                    found += [(before + a, b) for a, b in self._shared(to, state, rest, letter)]
            elif self.of.final[state] and self.of.final[to]:
                found.append((before, 0))
        self._edits[state, rest] = found
        return found

    def pairs(self, most: int) -> Iterator[tuple[int, int]]:
        """Numbers of all accepted pairs whose edit comes after less than ``most`` letters."""
        paths = [(self.of.start, 0, 0)]
        while paths:
            state, depth, before = paths.pop()
            for a, b in self.edits(state, self.length - depth):
                yield before + a, before + b
            if depth < min(self.length, most - 1):
                paths += [(to, depth + 1, before + n) for to, n in self.of.arcs[state].values()]


def letter_runs(docs: DataFrame, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal runs of at least so many letters, A-Z lower-cased: (key, run), one row each."""
    upper = "".join(map(chr, range(65, 91)))
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    runs = docs.select(F.col(f"`{key}`").alias("key"), F.explode(found).alias("run"))
    return runs.withColumn("run", F.translate("run", upper, upper.lower()))


def word_counts(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Words of a column ``word`` that are long and frequent enough: (word, n)."""
    return (
        words.where(F.length("word") >= min_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count)
    )


# A row of a group: a word, its n, and what its group has in common. ``shorter`` is the length
# of the shorter word of the wanted pairs, ``head`` and ``tail`` the number of first and last
# letters that all words of the group share, ``most`` the bound of the place of the edit.
_GROUP = ("shorter", "head", "tail", "most")


def _halved(rows: DataFrame) -> DataFrame:
    """The words of groups dealt to smaller groups that hold every pair of the group once.

    An edit of the part between head and tail lies after its first half or before its
    second: either the first half is equal, or the second one is.
    """
    middle = F.col("shorter") - F.col("head") - F.col("tail")
    half = F.ceil(middle / 2).cast("int")
    after = F.struct("shorter", (F.col("head") + half).alias("head"), "tail", "most")
    before = F.struct(
        "shorter", "head", (F.col("tail") + middle - half).alias("tail"),
        F.least("most", F.col("head") + half).alias("most"),
    )
    dealt = rows.select("word", "n", F.explode(F.array(after, before)).alias("g"))
    return _keyed(dealt.select("word", "n", "g.*").where("head < most"))


def _keyed(rows: DataFrame) -> DataFrame:
    shared = F.expr("left(word, head)"), F.expr("if(tail > 0, right(word, tail), '')")
    key = F.concat_ws("|", *_GROUP, *shared)
    return rows.withColumn("key", key).withColumn("hashed", F.xxhash64("key"))


def _pairs(rows: DataFrame, kind: str) -> DataFrame:
    """Near pairs within groups, both ways: (word, near, near_n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, n_right = [], [], []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(n_right, pa.int64())],
                ["word", "near", "near_n"],
            )
            left.clear(), right.clear(), n_right.clear()
            return made

        rows = (
            row for batch in batches
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", *_GROUP)))
        )
        for _, group in groupby(rows, key=lambda row: row[0]):
            group = list(group)
            if len(group) == 1:
                continue
            shorter, head, tail, most = group[0][3:]
            middles = sorted((w[head:len(w) - tail], w, n) for _, w, n, *_ in group)
            sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * shorter + 1000))
            edited = OneEdit(Acceptor(m for m, _, _ in middles), shorter - head - tail)
            for a, b in edited.pairs(most - head):
                (_, u, nu), (_, v, nv) = middles[a], middles[b]
                left += u, v
                right += v, u
                n_right += nv, nu
                if len(left) >= _OUT_ROWS:
                    yield out()
        if left:
            yield out()

    by_group = rows.repartition("hashed").sortWithinPartitions("hashed", "key")
    return by_group.select("key", "word", "n", *_GROUP).mapInArrow(run, f"word {kind}, near {kind}, near_n bigint")


def near_words(vocabulary: DataFrame, bound: int = BOUND) -> DataFrame:
    """All pairs of distinct words that differ by exactly one inserted, deleted or replaced letter.

    ``vocabulary`` is a settled table (word, n) of distinct words without null or empty ones.
    Every pair comes twice, once from each side: (word, near, near_n).

    A word of L letters is in the groups of pairs whose shorter word has L or L - 1 letters, by
    its first and by its last half. Groups of more than ``bound`` words are dealt out again by
    half of what is left between, as long as two letters or more are left; a group with
    one or none has no more words than there are pairs of letters.
    """
    length = F.length("word")
    shorter = F.array_compact(F.array(length, F.when(length > 1, length - 1)))
    rows = _halved(vocabulary.select(
        "word", "n", F.explode(shorter).alias("shorter"), F.lit(0).alias("head"), F.lit(0).alias("tail"),
        F.lit(2**31 - 1).alias("most"),
    ))
    found = None
    while True:
        # Two groups of one hash only count as a larger one.
        large = settle(
            rows.where("shorter - head - tail > 1").groupBy("hashed")
            .agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bound).select("hashed"),
            "large_groups",
        )
        if last := large.isEmpty():
            small = rows
        else:
            small = rows.join(large, "hashed", "left_anti")
        pairs = _pairs(small, "string")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found
        rows = settle(_halved(rows.join(large, "hashed", "left_semi")), "dealt_groups")


def _roots(forms: DataFrame) -> DataFrame:
    """The last form of every word that has one, by jumps that double their length."""
    roots = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        roots = settle(roots, "roots")
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )


def variants(vocabulary: DataFrame, ratio: int = RATIO, bound: int = BOUND) -> DataFrame:
    """Every word with its form and root: (word, form, root, n, n_near, form_n).

    ``vocabulary`` holds distinct words with their counts n. The form of a word is its most
    frequent near word (of equal ones the first in code-point order) if that occurs at
    least ``ratio`` times as often, the root the last of the forms that follow from it. A word
    without a form is its own root. An empty vocabulary gives no rows.
    """
    vocabulary = settle(vocabulary.select("word", "n"), "vocabulary")
    best = (
        near_words(vocabulary, bound).groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    )
    has_form = F.col("near_n") >= ratio * F.col("n")
    judged = settle(
        vocabulary.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
