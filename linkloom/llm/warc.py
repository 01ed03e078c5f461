"""WARC archives and their capture index by external merging.

``write`` puts each page into a WARC record. Of records with equal payloads of at least ``min_bytes``, the one with the largest
page_id is the response and the others revisit it without a payload. Records are built by columns and written by Spark's own text
sink: the blank lines that end a record are the sink's line separator, so files are plain WARC in any store that Spark reaches.

``read`` parses the archives by their lengths and gives a capture run per file, sorted by URL key and time. ``merge`` deals the runs out
by ranges of (key, time, page), as many as it takes to hold ``RANGE_LINES`` lines each, and merges the runs of a range with a loser tree, which
yields capture histories in global order. Within a range Spark's own external sort keeps each run together and in order; a URL
captured any number of times is split between ranges. A task holds the index lines of one range, never payloads.

Archives are cut by the mean size of a page and so that none exceeds ``MOST_BYTES``, unless a single record does. The text sink compresses
a file as one stream, so offsets count in the decompressed archive.

Defined cases: a NULL html is an empty payload; a NULL url gives a record without a target and an empty key; rows that repeat the largest
page_id of equal payloads are all responses; a NULL page_id revisits, unless no equal page has an id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import durable, shared_dir

FILE_BYTES = 32 << 20
MOST_BYTES = 1 << 30
RANGE_LINES = 1 << 16
MIN_BYTES = 0
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_CAPTURE = 946_684_800  # pages bear no time of capture; page n counts as captured n seconds after this

INDEX = "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
_FIELDS = [f.split()[0] for f in INDEX.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string, five bytes at a time."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), digits, letters)


def _records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``value``: a whole record but for the blank lines that end it."""
    copies = pages.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    known = pages.join(copies.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda cond, text: F.when(cond, text).otherwise(F.lit(""))
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    captured = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return known.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", record_id(F.col("page_id"))),
            line("WARC-Date", captured),
            optional(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", ""))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            optional(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("first"))))),
            F.lit("Content-Type: application/http;msgtype=response\r\n"),
            line("Content-Length", length.cast("string")),
            F.lit("\r\n"),
            http,
            F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        ).alias("value")
    )


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write gzipped archives of about ``FILE_BYTES`` each before compression."""
    payload = F.coalesce(F.col(html), F.lit(""))
    read = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    read = read.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    size = F.octet_length(F.col(html))
    mean, most = (x or 0 for x in pages.agg(F.avg(size), F.max(size)).first())
    per_file = max(1, min(int(FILE_BYTES / (mean + 600)), MOST_BYTES // (most + 600)))
    _records(read, min_bytes).write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(folder)


def url_key(url: str | None) -> str:
    """The SURT-like sort key: host labels reversed, then the rest, all lower-cased."""
    if not url:
        return ""
    host, slash, rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*://", "", url).lower().partition("/")
    return ",".join(reversed(host.split("."))) + ")" + slash + rest


_RECORD_ID = re.compile(rb"<urn:page:(-?\d*)>")


def _page(value: bytes | None) -> int | None:
    found = _RECORD_ID.fullmatch(value or b"")
    return int(found[1]) if found and found[1] else None


def parse(data: bytes, file: str) -> Iterator[tuple]:
    """Index lines of one archive, found by the lengths that the records state; offsets are those of the unpacked bytes."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"{file}: no record at byte {at}")
        body = data.index(b"\r\n\r\n", at) + 4
        head = dict(x.split(b": ", 1) for x in data[at : body - 4].split(b"\r\n")[1:])
        end = body + int(head[b"Content-Length"])
        start = data.index(b"\r\n\r\n", body, end) + 4
        kind, digest = head[b"WARC-Type"].decode(), head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        if kind == "response":
            size, found = end - start, base64.b32encode(hashlib.sha1(data[start:end]).digest()).decode()
            if found != digest:
                raise ValueError(f"{file}: the payload at byte {start} has the digest {found}, not {digest}")
        else:
            size = int(re.search(rb"Content-Length: (\d+)", data[body:start])[1])
        url = head[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in head else None
        page, first = _page(head[b"WARC-Record-ID"]), _page(head.get(b"WARC-Refers-To"))
        yield url_key(url), head[b"WARC-Date"].decode(), page, url, size, digest, kind, first, file, at, end - at
        at = end + len(END)


def _order(line: tuple) -> tuple:
    return line[0], line[1], line[2] is None, line[2] or 0, line[8], line[9]


def _batch(lines: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines, strict=True), schema, strict=True)], schema=schema)


_ARROW = pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in INDEX.split(", ")])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Capture runs: the index lines of each archive, sorted by URL key and time within it."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = gzip.decompress(content.as_py()) if path.as_py().endswith(".gz") else content.as_py()
                lines = sorted(parse(data, path.as_py().rpartition("/")[2]), key=_order)
                if lines:
                    yield _batch(lines, _ARROW)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(index, INDEX)


class LoserTree:
    """Merges k sorted iterators; each step replays one path of log2(k) matches."""

    def __init__(self, runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for run in range(self.k):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0  # an empty place lets everything wait until the tree is full
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.key(self.heads[a]), a) < (self.key(self.heads[b]), b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def merge(runs: DataFrame) -> DataFrame:
    """All runs as one index in the order of URL key, time and page."""

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for line in zip(*(batch.column(c).to_pylist() for c in _FIELDS), strict=True))
        by_file = [list(run) for _, run in groupby(lines, key=lambda line: line[8])]
        held: list[tuple] = []
        for line in LoserTree([iter(run) for run in by_file], _order):
            held.append(line)
            if len(held) == 10_000:
                yield _batch(held, _ARROW)
                held = []
        if held:
            yield _batch(held, _ARROW)

    runs = durable(runs)
    order = ["url_key", "captured", F.asc_nulls_last("page_id")]
    ranges = max(1, math.ceil(runs.count() / RANGE_LINES))
    return runs.repartitionByRange(ranges, *order).sortWithinPartitions("file", *order, "offset").mapInArrow(merged, INDEX)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read these back and merge their runs."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, min_bytes=min_bytes)
    return merge(read(spark, folder))
