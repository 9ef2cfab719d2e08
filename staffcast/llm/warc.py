"""Web archives, and one capture index merged from their sorted runs.

``write_archives`` writes one WARC record per page with Spark's text writer: the record
separator of the format is the line separator of the writer, so any store that Spark can
write to will do and a repeated task leaves one copy. Of records with one payload, that
with the smallest key is the response, all others are revisits without payload.

``read_archives`` parses the archives by their content lengths, checks every digest and
gives each archive's captures sorted by URL key and time: a run. ``merge_runs`` deals the
runs by ranges of the sort key, and each task merges the pieces of the runs that it gets
with a loser tree, so the captures are in order over all partitions. The sort key ends
with the run and the place in it, so even one URL with most captures is spread.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staffcast.llm.common import run_starts, settle
from staffcast.operators.spread import shared_dir

#: Payloads of fewer bytes are always written.
LEAST_REVISIT = 0
#: Uncompressed bytes of an archive, about.
ARCHIVE_BYTES = 8 << 20
#: Captures merged by one task, about.
RANGE_ROWS = 1 << 15
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
GAP = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def base32(hex_digits: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five digits hold four letters."""
    def letter(i: Column) -> Column:
        group = F.conv(F.substring(hex_digits, (i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10)
        shift = (F.lit(15) - (i % 4) * 5).cast("int")
        return F.substring(F.lit(BASE32), F.call_function("shiftright", group.cast("int"), shift) % 32 + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _header_text(value: Column) -> Column:
    """A value fit for a header line: line ends as in URLs."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def records(pages: DataFrame, key: str, url: str, payload: str, captured: Column, least: int) -> DataFrame:
    """(record): the WARC record of every page, without the separator that follows it."""
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    marked = pages.select(
        F.col(f"`{key}`").alias("key"), _header_text(F.col(f"`{url}`").cast("string")).alias("uri"),
        body.alias("body"), F.date_format(captured, TIME).alias("date"),
        F.octet_length(body).alias("bytes"), F.sha1(body.cast("binary")).alias("sha1"),
    )
    firsts = marked.where(F.col("bytes") >= least).groupBy("sha1").agg(
        F.min("key").alias("first"), F.count(F.lit(1)).alias("n")
    )
    repeated = settle(firsts.where("n > 1").select("sha1", "first"), "repeated")
    joined = marked.join(repeated, "sha1", "left")
    own = F.coalesce(F.col("key").cast("string"), F.lit(""))
    first = F.coalesce(F.col("first").cast("string"), F.lit(""))
    revisit = (F.col("bytes") >= least) & F.col("first").isNotNull() & (own != first)
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(GAP))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), own, F.lit(">"))),
        line("WARC-Date", F.coalesce("date", F.lit(""))),
        F.when(F.col("uri").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", F.col("uri"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), first, F.lit(">"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return joined.select(F.concat(head, F.lit("\r\n"), block).alias("record"))


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    captured: Column | None = None, least: int = LEAST_REVISIT,
) -> None:
    """Write compressed archives of about ``ARCHIVE_BYTES`` each into a folder.

    A null payload is empty, a null URL has no target line, a null key an empty name; of
    equal payloads the smallest key that is not null is the response, and all rows that
    share that key are. Without ``captured`` all records have the first day of the epoch.
    """
    captured = F.timestamp_seconds(F.lit(0)) if captured is None else captured
    size = F.coalesce(F.octet_length(F.col(f"`{payload}`")), F.lit(0)) + 600
    mean, total = pages.agg(F.avg(size), F.sum(size)).first()
    # Small partitions share an archive; large ones are cut into several.
    rows = records(pages, key, url, payload, captured, least).coalesce(max(1, -(-(total or 0) // ARCHIVE_BYTES)))
    rows.write.option("lineSep", GAP).option("compression", "gzip").option(
        "maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (mean or ARCHIVE_BYTES)))
    ).text(path)


def url_key(url: str | None) -> str:
    """Host names from the last to the first, then path and query: ``org,example)/a?b``."""
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)(?::[0-9]+)?([^#]*)", url or "")
    if not found:
        return url or ""
    return ",".join(reversed(found[1].lower().split("."))) + ")" + (found[2] or "/")


def parse(content: bytes) -> Iterator[tuple]:
    """(offset, headers, payload bytes, payload or None) of every record of an archive."""
    stream = Unpacked(content)
    while stream.more():
        offset = stream.offset
        if stream.line() != b"WARC/1.1":
            raise ValueError(f"no record at byte {offset}")
        headers = {}
        while line := stream.line():
            name, _, value = line.partition(b": ")
            headers[name.decode()] = value.decode()
        block = stream.take(int(headers["Content-Length"]))
        if stream.take(len(GAP)) != GAP.encode():
            raise ValueError(f"record at byte {offset} does not end with its length")
        http, _, payload = block.partition(GAP.encode())
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        is_response = headers["WARC-Type"] == "response"
        yield offset, headers, size, payload if is_response else None


class Unpacked:
    """A gzip stream, unpacked piece by piece."""

    def __init__(self, content: bytes):
        self._source, self._unpack = io.BytesIO(content), zlib.decompressobj(31)
        self._held, self._at, self.offset = b"", 0, 0

    def _fill(self) -> bool:
        piece = self._source.read(1 << 16)
        while self._unpack.eof and (piece or self._unpack.unused_data):
            piece, self._unpack = self._unpack.unused_data + piece, zlib.decompressobj(31)
        if not piece:
            return False
        self._held = self._held[self._at:] + self._unpack.decompress(piece)
        self._at = 0
        return True

    def more(self) -> bool:
        while self._at == len(self._held):
            if not self._fill():
                return False
        return True

    def line(self) -> bytes:
        while (end := self._held.find(b"\r\n", self._at)) < 0:
            if not self._fill():
                raise ValueError("the archive ends inside a record")
        found = self._held[self._at:end]
        self._move(end + 2)
        return found

    def take(self, size: int) -> bytes:
        parts, missing = [], size
        while len(self._held) - self._at < missing:
            parts.append(self._held[self._at:])
            missing -= len(parts[-1])
            self.offset += len(parts[-1])
            self._at = len(self._held)
            if not self._fill():
                raise ValueError("the archive ends inside a record")
        parts.append(self._held[self._at:self._at + missing])
        self._move(self._at + missing)
        return b"".join(parts)

    def _move(self, to: int) -> None:
        self.offset += to - self._at
        self._at = to


CAPTURES = (
    "run string, place int, url_key string, date string, uri string, key {key}, bytes bigint, "
    "digest string, type string, refers_to {key}, offset bigint"
)


def _name(value: str | None) -> str | None:
    """Key inside ``<urn:page:key>``; an empty one is null."""
    return (value[len("<urn:page:"):-1] or None) if value else None


def read_archives(spark, path: str, key_type: str) -> DataFrame:
    """The captures of all archives of a folder, each archive's sorted: one run per archive."""
    number = key_type in ("bigint", "int", "smallint", "tinyint")
    schema = CAPTURES.format(key=key_type)
    cast = int if number else str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield _run(name.as_py().rpartition("/")[2], content.as_py(), cast)

    def _run(name: str, content: bytes, cast) -> pa.RecordBatch:
        found = []
        for offset, headers, size, payload in parse(content):
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if payload is not None:
                sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if sha1 != digest or len(payload) != size:
                    raise ValueError(f"payload of the record at byte {offset} of {name} is damaged")
            uri, own = headers.get("WARC-Target-URI"), _name(headers["WARC-Record-ID"])
            refers = _name(headers.get("WARC-Refers-To"))
            found.append((
                url_key(uri), headers["WARC-Date"], own is not None, cast(own) if own else cast(0),
                uri, size, digest, headers["WARC-Type"], cast(refers) if refers else None, offset,
            ))
        found.sort(key=lambda x: x[:4] + x[-1:])
        rows = [
            (name, i, x[0], x[1], x[4], x[3] if x[2] else None, *x[5:]) for i, x in enumerate(found)
        ]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 11
        kind = pa.int64() if number else pa.string()
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 3, kind, pa.int64(), pa.string(), pa.string(), kind, pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if number:
        return files.mapInArrow(run, CAPTURES.format(key="bigint"))
    return files.mapInArrow(run, schema)


class LoserTree:
    """k-way merge: every inner node keeps the loser of its match, so one path is replayed."""

    def __init__(self, runs: Sequence[Sequence]):
        self._runs, self._at = runs, [0] * len(runs)
        self._k = len(runs)
        # The number k stands for a run that wins every match, until all have played.
        self._losers = [self._k] * max(1, self._k)
        for run in reversed(range(self._k)):
            self._replay(run)

    def _beats(self, a: int, b: int) -> bool:
        if a == self._k or b == self._k:
            return a == self._k
        left, right = self._runs[a], self._runs[b]
        i, j = self._at[a], self._at[b]
        if i == len(left) or j == len(right):
            return j == len(right) and (i < len(left) or a < b)
        return (left[i], a) < (right[j], b)

    def _replay(self, run: int) -> None:
        winner, node = run, (run + self._k) // 2
        while node > 0:
            if self._beats(self._losers[node], winner):
                winner, self._losers[node] = self._losers[node], winner
            node //= 2
        self._losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) in merged order."""
        while self._k and self._at[run := self._losers[0]] < len(self._runs[run]):
            yield run, self._at[run]
            self._at[run] += 1
            self._replay(run)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures with ``range`` and ``position``, ordered by URL key, time and key over both.

    The runs must be settled. Each task holds one range of about ``RANGE_ROWS`` captures.
    """
    order = ["url_key", "date", "key", "run", "place"]
    parts = max(1, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(parts, *order).sortWithinPartitions("run", "place")
    names = runs.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _merged(pa.Table.from_batches(held))

    def _merged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = table.column("run").to_pylist()
        starts = run_starts(np.unique(names, return_inverse=True)[1])
        keys = list(zip(
            table.column("url_key").to_pylist(), table.column("date").to_pylist(),
            [(k is not None, k) if k is not None else (False,) for k in table.column("key").to_pylist()],
            strict=True,
        ))
        bounds = [*starts.tolist(), len(keys)]
        pieces = [keys[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        order = np.fromiter((bounds[r] + i for r, i in LoserTree(pieces)), np.int64, len(keys))
        n = len(order)
        merged = table.take(pa.array(order))
        merged = merged.append_column("range", pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)))
        merged = merged.append_column("position", pa.array(np.arange(n)))
        yield from merged.combine_chunks().to_batches()

    schema = ", ".join(f"`{c}` {t}" for c, t in runs.dtypes)
    return dealt.select(*names).mapInArrow(merge, f"{schema}, `range` int, position bigint")


def capture_history(pages: DataFrame, key: str = "page_id", captured: Column | None = None, **names) -> DataFrame:
    """Write archives of the pages, read them back, and merge their runs to one history.

    Columns as in ``CAPTURES``, and ``capture_rank``, the place in the whole history from 0.
    Repeated rows give repeated captures; an empty table gives an empty history.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staffcast/{spark.sparkContext.applicationId}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path, key=key, captured=captured, **names)
    runs = settle(read_archives(spark, path, pages.schema[key].dataType.simpleString()), "runs")
    history = settle(merge_runs(runs), "history")
    counts = history.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_"))
    ranked = history.join(offsets, "range")
    return ranked.withColumn("capture_rank", F.col("offset_") + F.col("position")).drop("offset_")
