"""Chat formatting: records of many layouts to canonical turns, and turns to one template.

A record is JSON. The hash of its sorted nested field paths, its fingerprint, selects a
declarative mapping that says where roles and texts are; metadata fields do not count. A
record with an unknown fingerprint gives a single row without role that names the
fingerprint, so nothing is lost.

The template writes a turn as ``<turn ROLE>TEXT</turn>`` and a line end. Inside role and
text a backslash stands before every backslash and every control string, so reading back
is exact. Turns stay rows: a conversation is the concatenation of its segments in order,
however many there are, and no task holds a whole one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Fields that do not belong to the layout.
METADATA = frozenset({"id", "source", "lang", "conv_id", "turn", "n_chars"})
#: Names of speakers in known layouts.
ROLES = {
    "human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant",
    "model": "assistant", "chatgpt": "assistant",
}
UNKNOWN = ""


@dataclass(frozen=True)
class Turn:
    """A turn with a fixed role (or the one in a field), its text from some fields."""

    texts: tuple[str, ...]
    role: str | None = None
    role_field: str | None = None


@dataclass(frozen=True)
class Mapping:
    """Turns of a record, or of every element of the list in field ``each``."""

    turns: tuple[Turn, ...]
    each: str | None = None

    @property
    def paths(self) -> frozenset[str]:
        inner = {p for t in self.turns for p in (*t.texts, t.role_field) if p}
        return frozenset({f"{self.each}[].{p}" for p in inner} if self.each else inner)

    def read(self, record: dict) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn."""
        for part in record[self.each] if self.each else [record]:
            for turn in self.turns:
                text = "\n\n".join(filter(None, (as_text(part.get(f)) for f in turn.texts)))
                role = turn.role or as_text(part.get(turn.role_field))
                yield ROLES.get(role, role), text


def _asked(question: tuple[str, ...], answer: str, *system: str) -> Mapping:
    first = tuple(Turn((s,), "system") for s in system)
    return Mapping((*first, Turn(question, "user"), Turn((answer,), "assistant")))


MAPPINGS = (
    Mapping((Turn(("text",), role_field="role"),)),
    Mapping((Turn(("content",), role_field="role"),)),
    Mapping((Turn(("content",), role_field="role"),), each="messages"),
    Mapping((Turn(("text",), role_field="role"),), each="messages"),
    Mapping((Turn(("value",), role_field="from"),), each="conversations"),
    _asked(("instruction",), "output"),
    _asked(("instruction", "input"), "output"),
    _asked(("instruction", "context"), "response"),
    _asked(("prompt",), "completion"),
    _asked(("prompt",), "response"),
    _asked(("question",), "answer"),
    _asked(("question",), "response", "system_prompt"),
)


def as_text(value: object) -> str:
    """A field as text: null is empty, numbers and nested values as JSON."""
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested paths of a record's fields; elements of a list share the path ``[]``."""
    if isinstance(value, dict):
        fields = ((k, v) for k, v in value.items() if at or k not in METADATA)
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in fields))
    if isinstance(value, list) and any(isinstance(v, dict) for v in value):
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(m.paths): m for m in MAPPINGS}


def turns_of(record: str | None, registry: dict[str, Mapping]) -> tuple[str, list[tuple[str | None, str]]]:
    """Fingerprint and turns of a record; what is not a known layout is one turn without role."""
    try:
        value = json.loads(record or "")
    except ValueError:
        return UNKNOWN, [(None, record or "")]
    mark = fingerprint(field_paths(value)) if isinstance(value, dict) else UNKNOWN
    mapping = registry.get(mark)
    if mapping is None:
        return mark, [(None, record or "")]
    return mark, list(mapping.read(value))


def canonical_turns(records: DataFrame, record: str, keep: list[str], registry: dict | None = None) -> DataFrame:
    """The columns ``keep`` with fingerprint, part (from 0), role and text, a row per turn.

    A null, broken or unknown record gives one row with role null and the record as text.
    Null texts and roles of known layouts are empty. Records stay apart even if equal.
    """
    registry = REGISTRY if registry is None else registry
    kinds = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks, parts, roles, texts = [], [], [], [], []
            for i, value in enumerate(batch.column(0).to_pylist()):
                mark, turns = turns_of(value, registry)
                for part, (role, text) in enumerate(turns):
                    rows.append(i)
                    marks.append(mark)
                    parts.append(part)
                    roles.append(role)
                    texts.append(text)
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[1:]]
            made = [pa.array(marks, pa.string()), pa.array(parts, pa.int32()),
                    pa.array(roles, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, "fingerprint", "part", "role", "text"])

    rows = records.select(F.col(f"`{record}`").cast("string").alias("_record"), *[f"`{c}`" for c in keep])
    return rows.mapInArrow(run, f"{kinds}, fingerprint string, part int, role string, text string")


#: What the template gives a meaning, and so is escaped inside texts.
CONTROLS = ("<turn ", "</turn>")


def _escaped(text: Column, controls: tuple[str, ...]) -> Column:
    for control in ("\\", *controls):
        text = F.replace(text, F.lit(control), F.lit("\\" + control))
    return text


def segments(turns: DataFrame) -> DataFrame:
    """The turns with ``formatted`` and the loss mask: code points ``loss_from`` to ``loss_to``.

    The mask covers the texts of assistants and is null for other turns. Role and text are
    taken as empty when null.
    """
    role = _escaped(F.coalesce("role", F.lit("")), (">",))
    text = _escaped(F.coalesce("text", F.lit("")), CONTROLS)
    head = F.concat(F.lit("<turn "), role, F.lit(">"))
    learned = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return turns.withColumns({
        "formatted": F.concat(head, text, F.lit("</turn>\n")),
        "loss_from": F.when(learned, F.length(head)),
        "loss_to": F.when(learned, F.length(head) + F.length(text)),
    })


SEGMENT = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>((?:[^\\<]++|\\.|<(?!turn |/turn>))*+)</turn>\n", re.S)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\|>|<turn |</turn>)", r"\1", text)


def read_segment(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = SEGMENT.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescaped(found[1]), unescaped(found[2])


class Digest:
    """Digests of a conversation whose turns come one by one."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, loss_from: int | None, loss_to: int | None) -> None:
        role, text = read_segment(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += 1
        self.formatted_chars += len(formatted)
        if loss_from is not None:
            learned = unescaped(formatted[loss_from:loss_to])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)

    def row(self) -> tuple:
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)


DIGESTS = (
    "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint"
)


def read_back(formatted: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per conversation with digests of what is read from its segments, in order.

    The rows of a conversation pass one after the other, so its length takes no memory.
    Rows with a null key form one conversation; ties of ``order`` follow the segment.
    """
    columns = [key, "formatted", "loss_from", "loss_to"]
    sorted_ = formatted.repartition(F.col(f"`{key}`")).sortWithinPartitions(key, *order, "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for own, *segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or own != now:
                    if digest is not None:
                        done.append((now, *digest.row()))
                    now, digest = own, Digest()
                digest.add(*segment)
            if done:
                yield _batch(done, kind_of)
        if digest is not None:
            yield _batch([(now, *digest.row())], kind_of)

    def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [key, *[c.split()[0] for c in DIGESTS.split(", ")]])

    kind_of = to_arrow_type(formatted.schema[key].dataType)
    return sorted_.select(*[f"`{c}`" for c in columns]).mapInArrow(
        run, f"`{key}` {formatted.schema[key].dataType.simpleString()}, {DIGESTS}"
    )
