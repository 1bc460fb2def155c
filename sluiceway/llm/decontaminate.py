"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every benchmark item gives windows of consecutive words.  A document is folded to its words
with one space between them, and windows are searched in it as byte strings: a shift table
over blocks of bytes tells how far no window can end, a block with shift nought selects the
windows of its suffix-hash bucket (after a test of their first bytes), and a direct comparison
confirms.  Many stretches of a batch of documents advance in step, so that the skipping runs
in numpy.  Windows are kept in classes by length, lest a short one shorten every shift.

The search tables are bounded: beyond MAX_WINDOWS the items are dealt into parts, whose tables lie
in the shared folder.  Documents are read once: a worker gathers a block of them, takes up one part
after another, and searches the block for each.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD_TABLE, binary, map_arrow, map_batches, new_path, read_table, slices
from .store import open_read, open_write

WINDOW = 10
#: Windows in one set of tables, which is broadcast.
MAX_WINDOWS = 200_000
#: Text that a worker gathers where there are several parts.
BLOCK_BYTES = 64 << 20
#: Windows of these many bytes or more stand in one class.
CLASSES = (32, 16, 8, 0)
LANE = 1024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def fold(text: bytes) -> list[bytes]:
    """Words: A-Z as a-z, then runs of ASCII letters and digits and of any others than ASCII."""
    return text.translate(FOLD_TABLE).split()


def item_windows(text: bytes, n: int = WINDOW) -> list[list[bytes]]:
    words = fold(text)
    return [words[i : i + n] for i in range(max(1, len(words) - n + 1))] if words else []


class Searcher:
    """Shift tables, prefixes and buckets of one class of windows."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.block = b = 8 if m >= 24 else 4 if m >= 8 else 2
        self.mask = np.uint64((1 << 8 * b) - 1)
        self.prefix_mask = np.uint64((1 << 8 * min(8, m)) - 1)
        self.bits = np.uint64(64 - min(22, max(12, (16 * len(patterns) * m).bit_length())))
        text = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(len(patterns), m)
        self.shift = np.full(1 << (64 - int(self.bits)), m - b + 1, np.uint16)
        for j in range(b, m + 1):
            np.minimum.at(self.shift, self._hash(_pack(text[:, j - b : j])), m - j)
        self.prefixes = np.unique(_pack(text[:, : min(8, m)]))
        self.buckets: dict[bytes, dict[int, list[int]]] = {}
        for k, p in enumerate(patterns):
            self.buckets.setdefault(p[m - b : m], {}).setdefault(len(p), []).append(k)
        self.buckets = {key: [(size, {patterns[k]: k for k in ks}) for size, ks in sorted(by.items())] for key, by in self.buckets.items()}

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks * _MULTIPLIER) >> self.bits

    def find(self, text: bytes, n: int) -> Iterator[tuple[int, int]]:
        """(start, pattern) of all windows in text[:n]; text has 8 bytes or more after those."""
        if n < self.m:
            return
        eight = np.ndarray(n, "<u8", text, 0, (1,))
        first = np.arange(0, n - self.m + 1, LANE)
        last = np.minimum(first + LANE, n - self.m + 1)  # of the starts that a lane owns, one past
        at, back = first, self.m - self.block
        found = []
        while len(at):
            step = self.shift[self._hash(eight[at + back] & self.mask)]
            zero = step == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(step, 1)
            going = at < last
            if not going.all():
                at, last = at[going], last[going]
        if not found:
            return
        starts = np.concatenate(found)
        prefix = eight[starts] & self.prefix_mask
        near = np.minimum(np.searchsorted(self.prefixes, prefix), len(self.prefixes) - 1)
        for a in starts[self.prefixes[near] == prefix].tolist():
            for size, named in self.buckets.get(text[a + back : a + self.m], ()):
                if (k := named.get(text[a : a + size])) is not None and a + size <= n:
                    yield a, k


def _pack(columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns), np.uint64)
    for i in range(columns.shape[1]):
        out |= columns[:, i].astype(np.uint64) << np.uint64(8 * i)
    return out


class Index:
    """Windows of a part of the items, and which items have them."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int = WINDOW):
        owners: dict[bytes, set] = defaultdict(set)
        for item, text in items:
            for window in item_windows(text, n):
                owners[b" " + b" ".join(window) + b" "].add(item)
        self.patterns = sorted(owners)
        self.owners = [sorted(x for x in owners[p] if x is not None) for p in self.patterns]
        self.words = [p.count(b" ") - 1 for p in self.patterns]
        self.searchers = []
        rest = list(range(len(self.patterns)))
        for least in CLASSES:
            own, rest = [k for k in rest if len(self.patterns[k]) >= least], [k for k in rest if len(self.patterns[k]) < least]
            if own:
                self.searchers.append((own, Searcher([self.patterns[k] for k in own])))

    def search(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """For each text: number of words, spans of hit words (not merged), items found."""
        parts, counts = [], []
        for text in texts:
            words = fold(text)
            counts.append(len(words))
            parts.append(b" " + b" ".join(words) + b" " if words else b" ")
        base = np.cumsum([0, *map(len, parts)])
        whole = b"".join(parts)
        n, padded = len(whole), whole + b"\0" * 16
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        spaces = None
        for own, searcher in self.searchers:
            for a, k in searcher.find(padded, n):
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
                d = int(np.searchsorted(base, a, "right")) - 1
                word = int(np.searchsorted(spaces, a) - np.searchsorted(spaces, base[d]))
                spans[d].append((word, word + self.words[own[k]]))
                items[d].update(self.owners[own[k]])
        return counts, spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    """Number of words in the union of spans."""
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _parts(benchmark: DataFrame, id_col: str, text_col: str, n: int, max_windows: int) -> list[DataFrame]:
    """The items, dealt into so many parts by hash that each has few enough windows.  The number
    of bytes bounds that of windows; an item too long for one part makes a part alone."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    parts = -(-size // (2 * max_windows)) or 1
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [items]


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per row of docs: id_col, n_words, spans (hit words from, to), items (sorted ids).

    Null texts, on either side, have no words and match nothing; an empty benchmark leaves every
    document clean.  Repeated items count once for their id; items without id mark words but are
    not listed.  Repeated documents have a row each.  Only the named columns are read."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, spans array<struct<a:long,b:long>>, items array<string>"
    want = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def row(batch: pa.RecordBatch, counts: list[int], spans: list[set], items: list[set]) -> pa.RecordBatch:
        rest = pa.RecordBatch.from_pydict({"n_words": counts, "spans": [[{"a": a, "b": b} for a, b in sorted(x)] for x in spans], "items": [sorted(x) for x in items]}, want)
        return pa.RecordBatch.from_arrays([batch.column(0), *rest.columns], ["id", *want.names])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _searched(texts, Tables(_parts(benchmark, item_col, item_text, n, max_windows), n), row, schema, 1).withColumnRenamed("id", id_col)


@lru_cache(maxsize=2)
def _table(uri: str) -> Index:
    with open_read(uri) as f:
        return pickle.loads(f.read())


class Tables:
    """The search tables of all parts: broadcast if there is one, in files of the shared folder otherwise."""

    def __init__(self, parts: list[DataFrame], n: int):
        self.one, self.uris = None, []
        for part in parts:  # one at a time is in the driver's memory
            spark, index = part.sparkSession, Index([(r.item, r.text.encode()) for r in part.toLocalIterator()], n)
            if len(parts) == 1:
                self.one = spark.sparkContext.broadcast(index)
                continue
            self.uris.append(new_path(spark, "windows"))
            with open_write(self.uris[-1]) as f:
                f.write(pickle.dumps(index, pickle.HIGHEST_PROTOCOL))

    def each(self) -> Iterator[Index]:
        if self.one is not None:
            yield self.one.value
        for uri in self.uris:
            yield _table(uri)


def _searched(df: DataFrame, tables: Tables, make: Callable[..., pa.RecordBatch], schema: str | T.StructType, at: int) -> DataFrame:
    """What `make` gives for slices of df with the words, spans and items that all parts find in text column `at`."""
    limit = BLOCK_BYTES if tables.uris else 0

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, spans, items = [[] for _ in parts], [[set() for _ in range(p.num_rows)] for p in parts], [[set() for _ in range(p.num_rows)] for p in parts]
        for index in tables.each():
            for k, part in enumerate(parts):
                counts[k], own, named = index.search(binary(part.column(at)).to_pylist())
                for d in range(part.num_rows):
                    spans[k][d].update(own[d])
                    items[k][d] |= named[d]
        for part, *rest in zip(parts, counts, spans, items, strict=True):
            yield make(part, *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, at):
                held.append(part)
                size += part.column(at).nbytes
                if size >= limit:
                    yield from found(held)
                    held, size = [], 0
        if held:
            yield from found(held)

    return map_batches(df, run, schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the search found, as counts and a digest of the items."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans = batch.column(2).to_pylist()
        items = batch.column(3).to_pylist()
        hit = [covered([(s["a"], s["b"]) for s in x]) for x in spans]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = found.schema[id_col].dataType.simpleString()
    return map_arrow(found, run, f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without those in which a window of the benchmark occurs; no row is shuffled.  Null and
    empty texts have no words and stay, as do all documents if the benchmark is empty or null; rows
    that repeat stay or go alike; an empty table stays empty."""
    at, names = docs.columns.index(text_col), docs.columns
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)])

    def clean(batch: pa.RecordBatch, counts: list[int], spans: list[set], items: list[set]) -> pa.RecordBatch:
        return batch.filter(pa.array([not x for x in spans], pa.bool_()))

    return _searched(docs.toDF(*plain.names), Tables(_parts(benchmark, item_col, item_text, n, max_windows), n), clean, plain, at).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bi AS (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(ws[i : i + size - 1], ' ') AS gram FROM bi),
sizes AS (SELECT DISTINCT size FROM bw),
p AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes),
g AS (SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS gram FROM p),
m AS (SELECT g.doc_id, g.i, g.size, bw.item_id FROM g JOIN bw ON g.gram = bw.gram AND g.size = bw.size),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
