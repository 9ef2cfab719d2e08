"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are what remains between the bytes 0-9, a-z and everything from 128 on, after A-Z
were lower-cased. The automaton of all item words is built once in a task. Document words
are streamed through it: the state keeps the longest suffix read so far that some item
holds, and where that length reaches the window (ten words, or a whole shorter item) the
words of the window are hit. The state also names the items that hold the window.

Only stretches of words whose every neighbouring pair occurs in some item are streamed;
a match longer than one word cannot leave such a stretch, so nothing is lost.

Items are dealt to automata of about ``AUTOMATON_WORDS`` words, so one automaton, which is
broadcast, has a bounded size however many items there are; documents pass every one.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffcast.llm.common import cut_points, settle, utf8

WINDOW = 10
AUTOMATON_WORDS = 200_000
#: A document of which more than this part is hit goes as a whole.
COVERAGE = 0.5
#: Words looked up at once.
CHUNK_WORDS = 1 << 18
#: Documents whose results go on at once.
OUT_ROWS = 500
#: Word bytes to themselves or to lower case, all others to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
GAPS = bytes(b for b in range(256) if WORD_BYTES[b] == 32)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Automaton:
    """Suffix automaton of many word sequences, with the items of every window state."""

    def __init__(self, items: Sequence[tuple[object, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        sequences: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text))
            if ids:
                sequences.setdefault(ids, set()).add(item)
        ends = [self._insert(ids) for ids in sequences]
        self._find_pairs(sequences)
        self.shortest = min([window, *map(len, sequences)]) if sequences else 0
        self._name_windows(list(sequences.items()), ends)
        self._number_sets()

    def _insert(self, ids: tuple[int, ...]) -> list[int]:
        """Add a sequence from the root; the states of its prefixes."""
        last, states = 0, []
        for c in ids:
            last = self._extend(last, c)
            states.append(last)
        return states

    def _add(self, length: int, link: int, following: dict[int, int]) -> int:
        self._length.append(length)
        self._link.append(link)
        self._next.append(following)
        return len(self._length) - 1

    def _extend(self, last: int, c: int) -> int:
        target = self._next[last].get(c)
        if target is not None:
            if self._length[target] == self._length[last] + 1:
                return target
            return self._split(last, c, target)
        new = self._add(self._length[last] + 1, 0, {})
        at = last
        while at >= 0 and c not in self._next[at]:
            self._next[at][c] = new
            at = self._link[at]
        if at >= 0:
            target = self._next[at][c]
            exact = self._length[target] == self._length[at] + 1
            self._link[new] = target if exact else self._split(at, c, target)
        return new

    def _split(self, at: int, c: int, target: int) -> int:
        """A copy of ``target`` for the shorter strings that end after ``at`` and ``c``."""
        copy = self._add(self._length[at] + 1, self._link[target], dict(self._next[target]))
        self._link[target] = copy
        while at >= 0 and self._next[at].get(c) == target:
            self._next[at][c] = copy
            at = self._link[at]
        return copy

    def _find_pairs(self, sequences) -> None:
        size = max(1, len(self.vocabulary))
        pairs = {a * size + b for ids in sequences for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _name_windows(self, sequences, ends) -> None:
        """Items by window state, and for each state the window states that end with it."""
        self.items: dict = {}
        for (ids, names), states in zip(sequences, ends, strict=True):
            width = min(self.window, len(ids))
            for state in states[width - 1:]:
                self.items.setdefault((self._holding(state, width), width), set()).update(names)
        widths: dict[int, list[int]] = {}
        for state, width in self.items:
            widths.setdefault(state, []).append(width)
        order = sorted(range(len(self._length)), key=self._length.__getitem__)
        self.found: list[tuple[tuple[int, int], ...]] = [()] * len(order)
        for state in order:
            above = self.found[self._link[state]] if state else ()
            self.found[state] = above + tuple((state, w) for w in widths.get(state, ()))

    def _holding(self, state: int, width: int) -> int:
        """The state of the suffix of ``width`` words."""
        while self._length[self._link[state]] >= width:
            state = self._link[state]
        return state

    def _number_sets(self) -> None:
        """Every distinct set of items once, and its number by window state."""
        numbers: dict[frozenset, int] = {}
        self.items = {
            window: numbers.setdefault(frozenset(names), len(numbers))
            for window, names in self.items.items()
        }
        self.sets = [tuple(sorted(names)) for names in numbers]

    def stream(self, ids: Sequence[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(place, windows that end there) for the word numbers of a stretch."""
        state, length = 0, 0
        following, link, longest = self._next, self._link, self._length
        for place, c in enumerate(ids):
            while state and c not in following[state]:
                state = link[state]
                length = longest[state]
            target = following[state].get(c)
            if target is not None:
                state, length = target, length + 1
            else:
                length = 0
            ending = [w for w in self.found[state] if w[1] <= length]
            if ending:
                yield place, ending

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """The same for any word numbers, -1 for words of no item."""
        if not self.shortest or not len(ids):
            return
        known = ids >= 0
        size = len(self.vocabulary)
        pairs = ids[:-1].astype(np.int64) * size + ids[1:]
        at = np.flatnonzero(known[:-1] & known[1:])
        if len(self.pairs):
            found = self.pairs[np.minimum(np.searchsorted(self.pairs, pairs[at]), len(self.pairs) - 1)]
            at = at[found == pairs[at]]
        else:
            at = at[:0]
        joined = np.zeros(len(ids) + 1, bool)
        joined[at + 1] = True  # this word goes on from the one before it
        starts = np.flatnonzero(known & ~joined[:-1])
        # A stretch ends where the next word does not go on.
        breaks = np.flatnonzero(~joined[1:])
        stops = breaks[np.searchsorted(breaks, starts)] + 1
        long = stops - starts >= self.shortest
        for start, stop in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            for place, ending in self.stream(ids[start:stop].tolist()):
                yield start + place, ending


def scan(
    texts: Iterable[bytes], automata: Sequence[Automaton]
) -> Iterator[tuple[int, np.ndarray, frozenset[tuple[int, int]]]]:
    """(words, hit marks or nothing, item sets) of each text.

    An item set is named by the number of its automaton and its number there, so that a text
    costs no more where very many items share a passage.
    """
    for group in _groups(texts):
        counts = [sum(len(p) for p in pieces) for pieces in group]
        bounds = np.cumsum([0, *[n + 1 for n in counts]])
        hit = np.zeros(bounds[-1] + 1, np.int32)
        found: dict[int, set] = {}
        for number, automaton in enumerate(automata):
            none = [b""]
            words = chain.from_iterable(chain(*pieces, none) for pieces in group)
            ids = np.fromiter(map(automaton.vocabulary.get, words, repeat(-1)), np.int32, bounds[-1])
            for place, ending in automaton.matches(ids):
                hit[place - max(w for _, w in ending) + 1] += 1
                hit[place + 1] -= 1
                doc = int(np.searchsorted(bounds, place, "right")) - 1
                found.setdefault(doc, set()).update((number, automaton.items[w]) for w in ending)
        marks = np.cumsum(hit) > 0
        for doc, n in enumerate(counts):
            own = marks[bounds[doc]:bounds[doc] + n] if doc in found else marks[:0]
            yield n, own, frozenset(found.get(doc, ()))


def items_of(sets: Iterable[tuple[int, int]], automata: Sequence[Automaton]) -> list[str]:
    """The items of item sets, in order."""
    return sorted(set().union(*[automata[a].sets[n] for a, n in sets]))


class Digests:
    """Number and digest of the items of a combination of item sets, worked out once.

    Only numbers are remembered, of the last combinations alone, so the memory does not grow with
    documents times items.
    """

    def __init__(self, automata: Sequence[Automaton], most: int = 4096):
        def digest(sets: frozenset) -> tuple[int, str]:
            items = items_of(sets, automata)
            return len(items), hashlib.sha256(",".join(items).encode()).hexdigest()

        self.of = lru_cache(most)(digest)


def _groups(texts: Iterable[bytes]) -> Iterator[list[list[list[bytes]]]]:
    """Texts as pieces of words, in groups of about ``CHUNK_WORDS`` words."""
    group, words = [], 0
    for text in texts:
        pieces = [words_of(p) for p in cut_points(text, 1 << 22, GAPS)]
        group.append(pieces)
        words += sum(map(len, pieces))
        if words >= CHUNK_WORDS:
            yield group
            group, words = [], 0
    if group:
        yield group


def build_automata(benchmark: DataFrame, key: str, text: str, window: int) -> list:
    """Broadcast automata over all items, each built by one task from about so many words."""
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.col(f"`{key}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text")
    ).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // (AUTOMATON_WORDS * 5)))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))

    def build(key_, group):
        rows = zip(group.column("item").to_pylist(), utf8(group.column("text")), strict=True)
        rows = [("" if i is None else i, t) for i, t in rows]
        made = pickle.dumps(vars(Automaton(rows, window)))
        return pa.table({"part": pa.array([key_[0].as_py()], pa.int64()), "made": pa.array([made], pa.binary())})

    made = dealt.groupBy("part").applyInArrow(build, "part bigint, made binary")
    made = settle(made, "automata")
    sent = []
    for part in range(parts):
        rows = made.where(F.col("part") == part).collect()
        sent += [spark.sparkContext.broadcast(bytes(r["made"])) for r in rows]
    return sent


def _automata(sent: Sequence) -> list[Automaton]:
    made = []
    for b in sent:
        automaton = Automaton.__new__(Automaton)
        vars(automaton).update(pickle.loads(b.value))
        made.append(automaton)
    return made


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", window: int = WINDOW, listed: bool = True,
) -> DataFrame:
    """One row per document: (key, n_words, n_hit, items), items in order as strings.

    Null texts have no words; null item texts are no items, a null item id reads ''.
    Repeated documents give repeated rows; items with one id count once. Without items,
    or for an empty table, nothing is hit. Where many items share a passage the lists are as
    many times longer; without ``listed`` there are (n_items, items_sha256) in their
    place, the number of the items and the digest of their comma-joined list.
    """
    sent = build_automata(benchmark, item_key, text, window)
    told = "items array<string>" if listed else "n_items bigint, items_sha256 string"
    names = [key, "n_words", "n_hit", *[part.split()[0] for part in told.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(sent)
        digests = Digests(automata)
        for whole in batches:
            for start in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(start, OUT_ROWS)
                rows = []
                for n, marks, sets in scan(utf8(batch.column(1)), automata):
                    items = [items_of(sets, automata)] if listed else digests.of(sets)
                    rows.append((n, int(marks.sum()), *items))
                kinds = [pa.int64(), pa.int64(), *([pa.list_(pa.string())] if listed else [pa.int64(), pa.string()])]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_hit bigint, {told}")


def cut_spans(text: bytes, automata: Sequence[Automaton], coverage: float) -> bytes | None:
    """The text without its hit spans, or nothing when too much of it is hit.

    Cutting can join words to a new window, so the rest is scanned again until it is clean.
    """
    whole = None
    while True:
        n, marks, _ = next(iter(scan([text], automata)))
        whole = n if whole is None else whole
        if not marks.any():
            return text
        if n - marks.sum() < (1 - coverage) * whole:
            return None
        starts, ends = _word_places(text)
        edges = np.diff(np.r_[0, marks.astype(np.int8), 0])
        kept, at = [], 0
        for a, b in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0), strict=True):
            kept.append(text[at:starts[a]])
            at = ends[b - 1]
        text = b"".join([*kept, text[at:]])


def _word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    is_word = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edges = np.diff(np.r_[0, is_word.astype(np.int8), 0])
    return np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
    window: int = WINDOW, coverage: float = COVERAGE,
) -> DataFrame:
    """The documents with hit spans cut out, without those of which too much is hit.

    All columns stay as they are, but a cut text has a new ``n_chars`` if there is one.
    Null texts stay.
    """
    sent = build_automata(benchmark, item_key, text, window)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(sent)
        for batch in batches:
            kept, changed = np.ones(batch.num_rows, bool), {}
            column = batch.column(at)
            for i, (_, marks, _) in enumerate(scan(utf8(column), automata)):
                if marks.any():
                    rest = cut_spans((column[i].as_py() or "").encode(), automata, coverage)
                    kept[i] = rest is not None
                    changed[i] = (rest or b"").decode()
            arrays = list(batch.columns)
            if changed:
                arrays[at] = _changed(column, changed)
                if "n_chars" in names:
                    n = names.index("n_chars")
                    arrays[n] = _changed(arrays[n], {i: len(t) for i, t in changed.items()})
            out = pa.RecordBatch.from_arrays(arrays, names)
            yield out.filter(pa.array(kept)) if changed else out

    return docs.mapInArrow(run, docs.schema)


def _changed(column: pa.Array, values: dict) -> pa.Array:
    rows = np.zeros(len(column), bool)
    rows[list(values)] = True
    new = pa.array([values[i] for i in sorted(values)], column.type)
    return pc.replace_with_mask(column, pa.array(rows), new)
