"""Language identification with a byte convolutional network.

A text is cut into windows of fixed length. Filters of several widths slide over the
bytes of a window, each keeps its largest response, and a softmax layer turns these into
chances of the languages. The chances of a text are the means over all its windows, each
weighted by its letters.

A filter has one weight for each byte class and place, so a response is a sum of table
entries. Two neighbouring places share one table of byte pairs when texts are predicted.

The network is trained in numpy on windows of a bounded number of labelled texts
(``SAMPLE_TEXTS`` for each language), drawn by a hash; every text is predicted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffcast.llm.common import utf8

#: Labelled texts of each language that are trained on, at most.
SAMPLE_TEXTS = 600
WINDOWS_EACH = 4
LENGTH = 160
WIDTHS = (2, 3, 4)
FILTERS = 16
EPOCHS = 12
BATCH = 128
RATE = 0.01
SEED = 11
UNKNOWN = "und"
#: Windows that are predicted at once.
CHUNK = 2048

#: Classes of bytes: 0 for padding, 1 for what is neither letter nor digit, 2 for digits,
#: then the letters a-z without regard to case, then every byte from 128 on.
CLASSES = 3 + 26 + 128


def byte_classes() -> bytes:
    def one(b: int) -> int:
        if b >= 128:
            return 29 + b - 128
        if chr(b).isalpha():
            return 3 + (b | 32) - 97
        return 2 if 48 <= b <= 57 else 1
    return bytes(map(one, range(256)))


CLASS_OF = byte_classes()
FIRST_LETTER = 3


@dataclass(frozen=True)
class Network:
    """Tables [width][place, class, filter], biases of the filters, and the softmax layer."""

    tables: Sequence[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pair_tables(self) -> list[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each width its tables of class pairs and their places; the second class of a
        pair does not count where the width is odd and the place the last."""
        made = []
        for table in self.tables:
            places = []
            for at in range(0, len(table) - 1, 2):
                pairs = table[at][:, None, :] + table[at + 1][None, :, :]
                places.append((at, pairs.reshape(-1, table.shape[2]).astype(np.float32)))
            if len(table) % 2:
                single = np.repeat(table[-1][:, None, :], CLASSES, axis=1)
                places.append((len(table) - 1, single.reshape(-1, table.shape[2]).astype(np.float32)))
            made.append((len(table), places))
        return made


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pooled(windows: np.ndarray, pairs: list, bias: np.ndarray) -> np.ndarray:
    """Largest response of every filter in every window of classes, not below zero."""
    codes = np.ascontiguousarray(windows.T).astype(np.int32)
    codes = np.concatenate([codes, np.zeros((1, codes.shape[1]), np.int32)])
    both = codes[:-1] * CLASSES + codes[1:]
    found = []
    for width, places in pairs:
        best = None
        for t in range(LENGTH - width + 1):
            at, table = places[0]
            response = table.take(both[t + at], axis=0)
            for at, table in places[1:]:
                response += table.take(both[t + at], axis=0)
            best = response if best is None else np.maximum(best, response, out=best)
        found.append(best)
    return np.maximum(np.concatenate(found, axis=1) + bias, 0)


def train(windows: np.ndarray, labels: np.ndarray, languages: int) -> Network:
    """Adam on the cross entropy; gradients reach each filter's best place only."""
    random = np.random.default_rng(SEED)
    tables = [random.normal(0, 0.1, (w, CLASSES, FILTERS)) for w in WIDTHS]
    bias = np.zeros(FILTERS * len(WIDTHS))
    dense = random.normal(0, 0.1, (FILTERS * len(WIDTHS), languages))
    values = [*tables, bias, dense, np.zeros(languages)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for part in range(0, len(order), BATCH):
            rows = order[part:part + BATCH]
            step += 1
            gradients = _gradients(windows[rows].astype(np.int64), labels[rows], values)
            for i, g in enumerate(gradients):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                size = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                values[i] -= size * first[i] / (np.sqrt(second[i]) + 1e-8)
    return Network(values[:-3], values[-3], values[-2], values[-1])


def _gradients(codes: np.ndarray, labels: np.ndarray, values: list) -> list[np.ndarray]:
    *tables, bias, dense, offset = values
    best, places = [], []
    for table in tables:
        width = len(table)
        span = LENGTH - width + 1
        response = sum(table[j][codes[:, j:j + span]] for j in range(width))
        at = response.argmax(axis=1)
        places.append(at)
        best.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
    raw = np.concatenate(best, axis=1) + bias
    hidden = np.maximum(raw, 0)
    error = softmax(hidden @ dense + offset)
    error[np.arange(len(labels)), labels] -= 1
    error /= len(labels)
    back = (error @ dense.T) * (raw > 0)
    out, filters = [], np.arange(FILTERS)
    for i, table in enumerate(tables):
        gradient = np.zeros_like(table)
        part = back[:, i * FILTERS:(i + 1) * FILTERS]
        for j in range(len(table)):
            byte = np.take_along_axis(codes, places[i] + j, axis=1)
            np.add.at(gradient[j], (byte, filters[None, :]), part)
        out.append(gradient)
    return [*out, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]


def windows_of(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of byte classes that cover every text, and the text of each.

    Windows overlap by the widest filter less one, so every run of bytes that a filter
    sees lies in some window whole.
    """
    step = LENGTH - max(WIDTHS) + 1
    padding = bytes(LENGTH)
    joined = np.frombuffer(b"".join(t.translate(CLASS_OF) + padding for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    counts = np.maximum(1, -(-(sizes - max(WIDTHS) + 1) // step))
    begins = np.cumsum([0, *(sizes[:-1] + LENGTH)])
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begins[owner] + nth * step
    return np.lib.stride_tricks.sliding_window_view(joined, LENGTH)[starts], owner


def predicted(texts: Iterable[bytes], network: Network) -> Iterator[np.ndarray | None]:
    """Chances of the languages for every text, nothing for a text without letters."""
    pairs, step = network.pair_tables(), LENGTH - max(WIDTHS) + 1
    dense, offset = network.dense.astype(np.float32), network.offset.astype(np.float32)
    bias = network.bias.astype(np.float32)
    group: list[tuple[int, bytes]] = []
    sums: dict[int, np.ndarray] = {}
    alone: set[int] = set()

    def flush() -> None:
        windows, owner = windows_of([t for _, t in group])
        for i in range(0, len(owner), CHUNK):
            part = windows[i:i + CHUNK]
            chances = softmax(pooled(part, pairs, bias) @ dense + offset)
            chances *= (part >= FIRST_LETTER).sum(axis=1, dtype=np.float32)[:, None]
            for own in np.unique(owner[i:i + CHUNK]):
                sums[group[own][0]] = sums.get(group[own][0], 0) + chances[owner[i:i + CHUNK] == own].sum(axis=0, dtype=np.float64)
        group.clear()

    count, held = 0, 0
    for text in texts:
        if not has_letter(text):
            alone.add(count)
        else:
            # A very long text goes in pieces, each begun early enough for the widest filter.
            for start in range(0, len(text), step * CHUNK):
                piece = text[start:start + step * CHUNK + max(WIDTHS) - 1]
                group.append((count, piece))
                held += -(-len(piece) // step)
                if held >= CHUNK:
                    flush()
                    held = 0
        count += 1
    if group:
        flush()
    for i in range(count):
        yield None if i in alone else sums[i] / sums[i].sum()


def has_letter(text: bytes) -> bool:
    if re.search(rb"[A-Za-z]", text):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode()))


def training_windows(docs: DataFrame, text: str, lang: str, key: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and labels from at most ``SAMPLE_TEXTS`` texts of each language.

    The texts are those with the smallest hashes of key and text, about; rows equal in both
    count once. Windows lie evenly over a text.
    """
    rows = docs.select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"),
        F.col(f"`{key}`").cast("string").alias("key"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("mark", F.xxhash64("key", "text"))
    marks = rows.select("lang", "mark").distinct()
    counts = {r["lang"]: r["n"] for r in marks.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.empty((0, LENGTH), np.uint8), np.empty(0, np.int64)
    limits = F.lit(-1)
    for name, n in counts.items():
        limits = F.when(F.col("lang") == name, min(1 << 30, (SAMPLE_TEXTS << 30) // n)).otherwise(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, drawn, made = [], [], []
            for name, hash_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                windows, _ = windows_of([t])
                at = np.unique(np.linspace(0, len(windows) - 1, WINDOWS_EACH).astype(int))
                for window in windows[at]:
                    if (window >= FIRST_LETTER).sum() >= 2:
                        names.append(name)
                        drawn.append(hash_)
                        made.append(window.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(drawn, pa.int64()), pa.array(made, pa.binary())],
                ["lang", "drawn", "window"],
            )

    # Places in the order of the marks hold the bound before any text goes to the driver.
    drawn = F.pmod("mark", F.lit(1 << 30))
    first = Window.partitionBy("lang").orderBy("drawn", "mark")
    taken = marks.withColumn("drawn", drawn).where(F.col("drawn") < limits)
    taken = taken.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE_TEXTS)
    taken = rows.join(F.broadcast(taken.drop("nth")), ["lang", "mark"])
    taken = taken.groupBy("lang", "mark", "drawn").agg(F.min("text").alias("text")).select("lang", "drawn", "text")
    found = sorted(tuple(r) for r in taken.mapInArrow(run, "lang string, drawn bigint, window binary").collect())
    kept, seen = [], dict.fromkeys(languages, 0)
    for name, _, window in found:
        if seen[name] < SAMPLE_TEXTS * WINDOWS_EACH:
            seen[name] += 1
            kept.append((languages.index(name), window))
    windows = np.frombuffer(b"".join(w for _, w in kept), np.uint8).reshape(-1, LENGTH)
    return languages, windows, np.array([i for i, _ in kept], np.int64)


def identify(
    docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(key, training, lang_pred, score) of every document.

    Learns from the rows that ``training`` marks. A null text or one without a letter, and
    every text when nothing can be learned, is ``und`` with score 0. Repeated rows repeat.
    """
    languages, windows, labels = training_windows(docs.where(training), text, lang, key)
    network = train(windows, labels, len(languages)) if len(labels) else None
    sent = docs.sparkSession.sparkContext.broadcast((languages, network and vars(network)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, parts = sent.value
        network = parts and Network(**parts)
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            if network:
                for i, chances in enumerate(predicted(utf8(batch.column(2)), network)):
                    if chances is not None:
                        best = int(chances.argmax())
                        names[i], scores[i] = languages[best], float(chances[best])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [key, "training", "lang_pred", "score"],
            )

    rows = docs.select(F.col(f"`{key}`"), training.alias("training"), F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(run, f"`{key}` {kind}, training boolean, lang_pred string, score double")
