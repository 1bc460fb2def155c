"""Helpers that the training-data operators share: the shared folder, materialised
tables, bounded text slices and vectorised word hashing."""

from __future__ import annotations

import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a worker handles at once; one document is never cut, however long.
SLICE_BYTES = 1 << 20
#: Text and other data that Spark hands to a worker at once, where the session does not say.
ARROW_BYTES = 2 << 20
MOST_TASKS = 50_000
#: Share of the driver's heap beyond which garbage is collected when a table is written.
HEAP_SHARE = 0.25


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark itself takes it: without a scheme it is on the default file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share: ``spark.checkpoint.dir``.
    Only where that is unset another is taken: a temporary folder in local mode, the warehouse
    (which a cluster shares) otherwise.  It goes when the application ends."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='sluiceway-')}" if _local(spark) else f"{spark.conf.get('spark.sql.warehouse.dir')}/_sluiceway"
        spark.conf.set("spark.checkpoint.dir", path)
    own = f"{path.rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        where = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _OWN[own] = files.makeQualified(where).toString()
    return _OWN[own]


_OWN: dict[str, str] = {}


class _Scopes(threading.local):
    """Paths written since each `scratch` of this thread was opened, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage is cut, and the
    loss of an executor costs nothing of what is written.  The table lasts as long as the innermost
    `scratch` in which it is written, with `keep` as the one around that."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    relieve(df.sparkSession)
    if len(_SCOPES.open) > keep:
        _SCOPES.open[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written within, but for those kept, and shuffle files."""
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            _delete(spark, path)
        tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Lets go of the shuffle files of what is done.  Spark deletes them when the driver collects the
    garbage that stands for them, which a driver with a large heap may not do for long."""
    gc.collect()
    time.sleep(0.3)  # what Python has let go of is let go of in the JVM by a thread that wakes ten times a second
    spark._jvm.System.gc()
    _trim(spark)


def relieve(spark: SparkSession) -> None:
    """Collects the driver's garbage once that and what lives take so much of its heap: broadcast tables
    and plans of what is done would pile up to the whole heap, beside which the JVM needs as much again
    for itself.  What it has freed goes back to the system."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > HEAP_SHARE * heap.maxMemory():
        spark._jvm.System.gc()
        _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Free parts of the JVM's native memory, which its many threads leave behind, go back to the system."""
    jvm = spark._jvm
    with suppress(Py4JError):  # not every JVM can do so
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(name, "systemTrimNativeHeap", None, None)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def discard(table: DataFrame) -> None:
    """Deletes a table that `materialise` has written."""
    files = table.inputFiles()
    if files and (own := shared_dir(table.sparkSession)) and files[0].replace("file:///", "file:/").startswith(own.replace("file:///", "file:/")):
        _delete(table.sparkSession, files[0].rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A short list of things to read, a task for each: partitions by number are not merged for
    being small.  Rows beyond MOST_TASKS share tasks, neighbours by key."""
    return df.repartitionByRange(max(1, min(rows, MOST_TASKS)), *keys)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcastable(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def hashed(df: DataFrame) -> DataFrame:
    """df, which has one row a key, as the side of a join that shuffles: a task holds its share of df
    in a hash table, so that neither side is sorted."""
    return df.hint("shuffle_hash")


def binary(column: pa.Array) -> pa.Array:
    """A text column as bytes, null as empty."""
    if pa.types.is_null(column.type):
        return pa.array([b""] * len(column), pa.binary())
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return pc.fill_null(column.cast(pa.binary()), b"")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
    at, base = 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at, base = to, int(ends[to - 1])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each begins (one more for the end)."""
    column = binary(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, text: int | None = None) -> DataFrame:
    """mapInArrow over batches, cut to bounded slices by the text column if one is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text) if text is not None else [batch]:
                yield from fn(part)

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes, unless the session says how large they are."""
    if df.sparkSession.conf.get(_ARROW, None) is None:
        df.sparkSession.conf.set(_ARROW, str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits (splitmix64), in place where it can."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A-Z to a-z; every other ASCII character but letters and digits to a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
for _c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]:
    FOLD[_c] = 32
FOLD_TABLE = FOLD.tobytes()

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), read only: those for a slice are kept."""
    if n > SLICE_BYTES + 1:
        return _powers(base, n)
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = _powers(base, min(SLICE_BYTES + 1, max(2 * n, 1 << 16)))
        _POWERS[base].flags.writeable = False
    return _POWERS[base][:n] if n else np.empty(0, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict[int, np.ndarray] = {}


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text: start, end (bytes in data), document, and a hash of 64 bits.

    A word is a run of ASCII letters and digits (A-Z as a-z) and any others than ASCII.
    The hash is that of the bytes alone, from prefix sums of a polynomial."""
    folded = FOLD[data]
    inside = folded != 32
    edge = np.empty(len(inside), bool)
    if len(inside):
        edge[0] = inside[0]
        np.logical_and(inside[1:], ~inside[:-1], out=edge[1:])
        firsts = offsets[:-1][(offsets[:-1] < len(data))]
        edge[firsts] = inside[firsts]
    start = np.flatnonzero(edge)
    if not len(start):
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, np.uint64)
    # a word ends where the next byte is outside, or where its document ends
    last = inside.copy()
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    past = offsets[1:][offsets[1:] > 0] - 1
    last[past] = inside[past]
    end = np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return start, end, doc, span_hash(folded, start, end)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of data[start:end] for every span: difference of prefix sums of
    (byte + 1) * B**i, brought to the same power by B**-start, then mixed with the length."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SCRAMBLE[data] * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def span_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key of 64 bits for every span, and its first and last eight bytes (a shorter one: all of
    it, twice).  Spans up to seven bytes have keys of their own; of longer ones two different
    spans with equal keys, lengths and ends are left to chance."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    first = eight[start]
    short = size < 8
    mask = (np.uint64(1) << (np.uint64(8) * np.minimum(size, 7).astype(np.uint64))) - np.uint64(1)
    first = np.where(short, first & mask, first)
    keys, last = first | size.astype(np.uint64) << np.uint64(56), first.copy()
    long = np.flatnonzero(~short)
    keys[long] = span_hash(data, start[long], start[long] + size[long]) >> np.uint64(4) | np.uint64(0xF << 60)
    last[long] = eight[start[long] + size[long] - 8]
    return keys, first, last


_SCRAMBLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def windows(hashes: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words of one document, their documents and first words.
    A document of fewer words, but not none, gives one window of all of them."""
    counts = np.bincount(doc, minlength=n_docs)
    base = np.concatenate([[0], np.cumsum(counts)])
    size = len(hashes)
    acc = np.zeros(size, np.uint64)
    left = base[doc + 1] - np.arange(size) if size else np.empty(0, np.int64)
    for i in range(n):
        acc *= np.uint64(_BASE)
        shifted = np.zeros(size, np.uint64)
        if i < size:
            shifted[: size - i] = hashes[i:]
        acc += np.where(left > i, shifted, np.uint64(0x51ED27))
    whole = left >= n
    first = np.zeros(size, bool)
    starts = base[:-1][counts > 0]
    first[starts] = True
    keep = np.flatnonzero(whole | (first & (left < n)))
    return mix(acc[keep]), doc[keep], keep
