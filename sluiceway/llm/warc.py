"""WARC archives: a writer, and a splittable reader.

The writer puts every record into a gzip member of its own; each task writes files with
names of its own and returns what it has written, so a task that runs twice leaves at most
a file that nobody lists.  The reader's tasks own byte ranges: they look for the magic bytes
of gzip, take a candidate only if it decodes to a WARC header, decode every record that
starts inside their range, wherever it ends, and go on from its end.  Where no record begins, they
look for the next one, and what they pass over is listed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcastable, dealt, materialise, new_path, qualified, read_table, slices
from .store import open_read, open_write

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
#: Files are closed at this size.
FILE_BYTES = 1 << 30
#: Groups of equal payloads that are broadcast; more are joined by a shuffle.
MOST_GROUPS = 200_000
#: How far back a member is looked for that may hold another in its payload.
LOOK_BACK = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header value without line ends or control characters."""
    return "".join(quote(c) if c < " " or c == "\x7f" else c for c in text)


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A record of type response, or revisit if it refers to another; one gzip member."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:record:{quote(key or '', safe='')}>"), ("WARC-Date", date)]
    head += [("WARC-Target-URI", _line(url))] if url else []
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    head += [("WARC-Refers-To", f"<urn:record:{quote(refers_to, safe='')}>"), ("WARC-Profile", PROFILE)] if refers_to is not None else []
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row under `to`; returns the list of files: file, bytes, records.

    Null payloads are empty.  Of equal payloads of least_bytes or more the row with the largest
    id is the response, which the others revisit; rows that share id and payload are responses
    alike, as are rows without id if no row of their group has one.  An empty table gives no file.
    Only the three columns are read."""
    to = qualified(pages.sparkSession, to)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    long_enough = keyed.where(F.octet_length("payload") >= least_bytes)
    same = materialise(long_enough.groupBy("sha").agg(F.max("id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("sha").alias("_sha"), "_keep"), "payloads")
    side = F.broadcast(same) if broadcastable(same, MOST_GROUPS) else same
    joined = keyed.join(side, (F.col("sha") == F.col("_sha")) & (F.octet_length("payload") >= least_bytes), "left")
    final = joined.select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(F.col("_keep").isNotNull() & ~F.col("_keep").eqNullSafe(F.col("id")), F.col("_keep").cast("string")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, size, count = None, None, 0, 0
        done = []
        for batch in batches:
            for part in slices(batch, 2):
                for key, url, payload, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None:
                        name, size, count = f"{to}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = open_write(name)
                    data = record(key, url, payload, refers)
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= FILE_BYTES:
                        out.close()
                        done.append((name, size, count))
                        out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "bytes", "records"])

    return materialise(final.mapInArrow(run, "file string, bytes long, records long"), "archives")


class _Bytes:
    """A file with a window of bytes that are held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        """Up to n bytes from pos."""
        if not self.base <= pos or pos + n > self.base + len(self.data):
            self.file.seek(pos)
            self.base, self.data = pos, self.file.read(max(n, READ_BYTES))
        return self.data[pos - self.base : pos - self.base + n]


def _begins(source: _Bytes, pos: int) -> bool:
    """Whether a member that decodes to a WARC header begins at pos."""
    chunk = source.at(pos, 1 << 16)
    if chunk[:3] != MAGIC:
        return False
    try:
        return zlib.decompressobj(31).decompress(chunk, 1 << 16).startswith(b"WARC/")
    except zlib.error:
        return False


def _member(source: _Bytes, pos: int) -> tuple[bytes, int] | None:
    """The decoded member at pos and where it ends; None if it is broken."""
    unpacker, parts = zlib.decompressobj(31), []
    try:
        while not unpacker.eof:
            chunk = source.at(pos, READ_BYTES)
            if not chunk:
                return None
            parts.append(unpacker.decompress(chunk))
            pos += len(chunk) - len(unpacker.unused_data)
    except zlib.error:
        return None
    return b"".join(parts), pos


def _whole(source: _Bytes, pos: int) -> tuple[bytes, int] | None:
    """The member at pos and its end, if it begins with a WARC header and its checksum and length are right."""
    return _member(source, pos) if _begins(source, pos) else None


def _within(source: _Bytes, pos: int) -> bool:
    """Whether a whole member that begins before pos ends after it: pos is then in its payload."""
    at = pos
    while at > max(0, pos - LOOK_BACK):
        low = max(0, at - READ_BYTES)
        window = source.at(low, at - low + 2)
        k = window.rfind(MAGIC, 0, at - low + 2)
        while k >= 0:
            if low + k < pos and (found := _whole(source, low + k)) is not None and found[1] > pos:
                return True
            k = window.rfind(MAGIC, 0, k + 2)
        at = low
    return False


def _next(source: _Bytes, pos: int, end: int) -> tuple[int, tuple[bytes, int] | None]:
    """The first record that begins in [pos, end), found without knowing where one before it ends,
    and its place; (end, None) if there is none.  A candidate that the next record or the end of the
    file follows is one; any other, unless it lies in the payload of a whole record."""
    while pos < end:
        window = source.at(pos, min(READ_BYTES, end - pos) + 2)
        k = window.find(MAGIC)
        if k < 0:
            pos += max(1, len(window) - 2)
            continue
        pos += k
        if pos < end and (found := _whole(source, pos)) is not None:
            if found[1] >= source.size or _begins(source, found[1]) or not _within(source, pos):
                return pos, found
        pos += 1
    return end, None


def records(uri: str, start: int, end: int, size: int, passed: list[tuple[int, int]] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record whose member starts in [start, end).

    A record whose checksum and length are right is never lost, whatever stands beside it; one that
    is damaged is passed over.  `passed` gets (place, bytes) of each stretch without a record that
    begins where a record of this range ends, or at the beginning of the file."""
    with open_read(uri) as file:
        source, pos, known = _Bytes(file, size), start, start == 0
        while True:
            found = _whole(source, pos) if known and pos < min(end, size) else None
            if found is None:
                if known and pos < size and (pos < end or passed is not None and _whole(source, pos) is None):
                    to, found = _next(source, pos, size if passed is not None else min(end, size))
                    if passed is not None and to > pos:
                        passed.append((pos, to - pos))
                    pos = to
                elif not known:
                    pos, found = _next(source, pos, min(end, size))
            if found is None or pos >= end:
                return
            head, _, rest = found[0].partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
            yield fields, rest[: int(fields.get("Content-Length", 0))]
            pos, known = found[1], True


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """(file, bytes, start) of every range, a task for each."""
    listed = files.where("file is not null and bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    written = materialise(listed, "ranges")
    return dealt(written, written.count(), "file", "start")


def passed_over(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, start, bytes) of the stretches of archives where no record can be read; no rows if all
    are whole, or for an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                passed: list[tuple[int, int]] = []
                for _ in records(uri, start, min(size, start + range_bytes), size, passed):
                    pass
                if passed:
                    yield _batch([(uri, *x) for x in passed], ["file", "start", "bytes"], [pa.string(), pa.int64(), pa.int64()])

    return _ranges(files, range_bytes).mapInArrow(run, "file string, start long, bytes long")


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record: record_id, record_type, refers_to, url, payload_digest, payload_bytes, payload (null if a revisit).

    `files` is (file, bytes), as write_archives returns it; an empty list, null files and those of no
    bytes give no rows.  Damaged records are left out, whole ones beside them are not (`passed_over`
    lists what is left out); a payload that does not match its digest is an error.  Records that
    repeat have a row each.  Ranges are read by a task each."""
    from urllib.parse import unquote

    names = ["record_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def key(text: str | None) -> str | None:
        return unquote(text[len("<urn:record:") : -1]) or None if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for fields, block in records(uri, start, min(size, start + range_bytes), size):
                    kind, named = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and digest(payload) != named:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} in {uri} does not match its digest")
                    length = len(payload) if payload is not None else int(fields["X-Payload-Length"])
                    rows.append((key(fields["WARC-Record-ID"]), kind, key(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), named, length, payload))
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names, types)

    return _ranges(files, range_bytes).mapInArrow(run, "record_id string, record_type string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(read_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    found = read_archives(files)
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h),
d AS (SELECT h, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS INT), 5) AS BIGINT)) AS v FROM g)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p JOIN g USING (h) JOIN d USING (h)
"""
