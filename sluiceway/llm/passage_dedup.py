"""Passages that repeat across documents, by paragraph MinHash banding.

Paragraphs are of two kinds.  One is a line of PASSAGE_WORDS words or more.  A passage may also
stand inside a line or run over several, where no line break marks it, so the other kind is a
window of WINDOW words that begins wherever the words decide: at a pair of words whose hash is the
least of REACH neighbours.  Any PASSAGE_WORDS words in a row hold such a window, the same one
wherever they stand.  MinHash bands (6 of 2 for a line, which find a pair of similarity 0.8 with
probability 0.998; 2 of 2 for windows that begin with the same pair of words, 0.87 for each of
those that a passage holds, and equal ones always) bring paragraphs together, exact Jaccard similarity verifies those that are not equal, and connected
components are classes.  Of each class the document of the least id keeps its text.

Windows become passages where they follow one another in a document as they do in the keeper.
Both texts are then compared word by word beyond either end, neighbouring runs with the same
keeper are joined over a few foreign words if the whole is alike, and only passages of
PASSAGE_WORDS or more are reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import build
from .common import broadcastable, hashed, map_arrow, materialise, mix, powers, raw, read_table, scratch, windows, words
from .linking import bucket_members, link, pack
from .near_dedup import band_names

SHINGLE, SIMILARITY = 5, 0.8
WINDOW, REACH = 32, 20
#: "Over 50 words": the fewest that hold a window whatever stands around them.
PASSAGE_WORDS = WINDOW + REACH - 1
#: Of lines, and of windows.
BANDS, ROWS, WINDOW_BANDS = 6, 2, 2
#: Foreign words between two runs that may be joined.
GAP = 8
#: Rows that are broadcast.
MOST_ROWS = 100_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _GOLD)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LINE, _INNER = 0, 1


def _slide(x: np.ndarray, n: int, take) -> np.ndarray:
    """take over x[i : i + n] for every i; the last n - 1 are over what is left."""
    out, width = x.copy(), 1
    while width < n:
        step = min(width, n - width)
        out[:-step] = take(out[:-step], out[step:])
        width += step
    return out


class Words:
    """The words of a batch of texts: places in bytes, text, hash, and hashes of runs of words."""

    def __init__(self, column: pa.Array):
        self.texts = len(column)
        self.data, self.offsets = raw(column)
        self.start, self.end, self.doc, self.hash = words(self.data, self.offsets)
        self.base = np.searchsorted(self.doc, np.arange(self.texts + 1))
        n = len(self.hash)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * powers(_BASE, n), out=self._sums[1:])
        self._inverse = powers(_INVERSE, n)

    def runs(self, n: int) -> np.ndarray:
        """Hash of n words from every word but the last n - 1 of the batch, whatever texts they are of."""
        k = max(0, len(self.hash) - n + 1)
        return mix((self._sums[n : n + k] - self._sums[:k]) * self._inverse[:k])

    @cached_property
    def chars(self) -> np.ndarray:
        """Characters before every byte of the batch."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])

    def characters(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bytes of the batch as characters of their texts."""
        return self.chars[at] - self.chars[self.offsets[doc]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """First words of windows, and the hash of the pair of words there."""
        n = len(self.hash)
        if n < PASSAGE_WORDS:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        order = np.append(self.runs(2), np.uint64(0)) | np.uint64(1)
        least = _slide(order, REACH, np.minimum)
        least[np.arange(n) + PASSAGE_WORDS > self.base[self.doc + 1]] = 0
        near = _slide(np.concatenate([np.zeros(REACH - 1, np.uint64), least]), REACH, np.maximum)[:n]
        at = np.flatnonzero(order == near)
        # of neighbours that are equal, as in a word said over and over, one in 16 will do
        whole = self.runs(WINDOW)[at]
        again = np.zeros(len(at), bool)
        again[1:] = (at[1:] == at[:-1] + 1) & (whole[1:] == whole[:-1])
        at = at[~again | ((at - self.base[self.doc[at]]) % 16 == 0)]
        return at, order[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, names (hash of all words) and bands of windows."""
        at, pair = self.anchors()
        if not len(at):
            return at, np.empty(0, np.uint64), np.empty((0, WINDOW_BANDS), np.uint64)
        shingles, size = self.runs(SHINGLE), WINDOW - SHINGLE + 1
        least = [_slide(mix(shingles ^ _SALTS[k]), size, np.minimum)[at] for k in range(WINDOW_BANDS * ROWS)]
        return at, self.runs(WINDOW)[at], mix(band_names(np.stack(least, axis=1), ROWS) + pair[:, None])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lines of PASSAGE_WORDS words or more: first word, words, and their distinct shingles: 64-bit
        name and line, in the order of line and name."""
        n, e = len(self.hash), np.empty(0, np.int64)
        if not n:
            return e, e, np.empty(0, np.uint64), e
        breaks = np.concatenate([[0], np.cumsum(self.data == 10)])
        begin = np.ones(n, bool)
        begin[1:] = (self.doc[1:] != self.doc[:-1]) | (breaks[self.start[1:]] != breaks[self.end[:-1]])
        first = np.flatnonzero(begin)
        size = np.diff(np.append(first, n))
        keep = size >= PASSAGE_WORDS
        line = np.repeat(np.where(keep, np.cumsum(keep) - 1, -1), size)
        mine = line >= 0
        first, size = first[keep], size[keep]
        w, owner, _ = windows(self.hash[mine], line[mine], len(first), SHINGLE)
        edge = np.searchsorted(owner, np.arange(len(first) + 1)).tolist()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            w[a:b].sort()
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (owner[1:] != owner[:-1])
        return first, size, w[new], owner[new]


def _line_nodes(w: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of 128 bits and bands of n lines."""
    if not n:
        return np.empty((0, 2), np.uint64), np.empty((0, BANDS), np.uint64)
    at = np.searchsorted(line, np.arange(n))
    node = np.stack([np.add.reduceat(mix(w ^ np.uint64(s)), at) for s in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)], axis=1)
    return node, band_names(np.stack([np.minimum.reduceat(mix(w ^ s), at) for s in _SALTS], axis=1), ROWS)


def _names(node: np.ndarray) -> pa.Array:
    """Names of 64 bits, or of several 64 bits a row, as bytes."""
    size = 8 * (node.size // max(1, len(node)))
    data = pa.py_buffer(np.ascontiguousarray(node).astype("<u8").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(node), [None, pa.py_buffer((np.arange(len(node) + 1) * size).astype("<i4").tobytes()), data])


def _packed(t: Words, at: np.ndarray, wanted: np.ndarray) -> list[bytes | None]:
    """Shingles of windows as `pack` has them; None where they are not wanted."""
    rows = np.sort(t.runs(SHINGLE)[at[wanted][:, None] + np.arange(WINDOW - SHINGLE + 1)], axis=1)
    again = (rows[:, 1:] == rows[:, :-1]).any(axis=1).tolist()
    found = iter([(np.unique(x) if y else x).astype("<u8").tobytes() for x, y in zip(rows, again, strict=True)])
    return [next(found) if x else None for x in wanted.tolist()]


def _repeated_bands(rows: DataFrame, kind: str) -> DataFrame:
    """Bands that several paragraphs have: band, several (whether in two documents), mixed (whether the
    paragraphs differ)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = Words(batch.column(1))
        first, _, w, line = t.lines()
        node, bands = _line_nodes(w, line, len(first))
        for at, name, own in ((first, node[:, 0], bands), t.windows()):
            if len(at):
                k = own.shape[1]
                ids = batch.column(0).take(pa.array(np.repeat(t.doc[at], k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.ravel().view(np.int64)), pa.array(np.repeat(name, k).view(np.int64))], ["id", "band", "node"])

    every = map_arrow(rows, run, f"id {kind}, band long, node long", 1)
    bounds = every.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("node").alias("c"), F.max("node").alias("d"))
    return materialise(bounds.where("a <> b or c <> d").select("band", (F.col("a") != F.col("b")).alias("several"), (F.col("c") != F.col("d")).alias("mixed")), "bands", keep=True)


def _paragraphs(rows: DataFrame, kind: str) -> DataFrame:
    """Paragraphs that may repeat: id, kind, at (first word), words, start, end (characters), node,
    bands (those in which they meet others than their like), shingles (null if there are none)."""
    with scratch(rows.sparkSession):
        repeated = _repeated_bands(rows, kind)
    context = rows.sparkSession.sparkContext
    any_, unlike = (context.broadcast(build(x, x.count())) for x in (repeated.where(what).select("band") for what in ("several", "mixed")))

    test = lambda bands, of: of.value.test(bands.ravel().view(np.int64)).reshape(bands.shape)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = Words(batch.column(1))
        first, size, w, line = t.lines()
        node, bands = _line_nodes(w, line, len(first))
        k, mixed = met(bands)
        if len(k):
            edge = np.searchsorted(line, np.arange(len(first) + 1))
            own = [pack(w[edge[x] : edge[x + 1]], np.ones(1))[0] if m else None for x, m in zip(k.tolist(), mixed.any(axis=1).tolist(), strict=True)]
            yield batch_of(t, batch, _LINE, first[k], size[k], node[k], bands[k], mixed, own)
        at, name, bands = t.windows()
        k, mixed = met(bands)
        if len(k):
            yield batch_of(t, batch, _INNER, at[k], np.full(len(k), WINDOW), name[k], bands[k], mixed, _packed(t, at[k], mixed.any(axis=1)))

    def met(bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paragraphs that another document may have, and the bands in which they meet others than their
        like, if they do so in one that two documents have."""
        repeated = test(bands, any_)
        k = np.flatnonzero(repeated.any(axis=1))
        mixed = test(bands[k], unlike)
        return k, mixed & (mixed & repeated[k]).any(axis=1)[:, None]

    def batch_of(t: Words, batch: pa.RecordBatch, what: int, at: np.ndarray, size: np.ndarray, node: np.ndarray, bands: np.ndarray, mixed: np.ndarray, sets: list) -> pa.RecordBatch:
        doc, n = t.doc[at], len(at)
        ints = lambda x: pa.array(x, pa.int32())
        lists = pa.ListArray.from_arrays(ints(np.concatenate([[0], np.cumsum(mixed.sum(axis=1))])), pa.array(bands[mixed].view(np.int64)))
        columns = [batch.column(0).take(pa.array(doc)), ints(np.full(n, what)), ints(at - t.base[doc]), ints(size), ints(t.characters(doc, t.start[at])), ints(t.characters(doc, t.end[at + size - 1]))]
        columns += [_names(node), lists, pa.array(sets, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "kind", "at", "words", "start", "end", "node", "bands", "shingles"])

    found = materialise(map_arrow(rows, run, f"id {kind}, kind int, at int, words int, start int, end int, node binary, bands array<long>, shingles binary", 1), "paragraphs")
    any_.destroy()  # the driver's heap holds what it has sent
    unlike.destroy()
    return found


def _classes(found: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Paragraphs with `root`, the name of their class; and (_root, first) of classes that two documents have."""
    members = bucket_members(materialise(found.select(F.explode("bands").alias("band"), "node").distinct(), "banded"))
    sets = materialise(found.where("shingles is not null").select("node", "shingles", F.lit(b"").alias("weights")).dropDuplicates(["node"]), "sets")
    roots = link(members, sets, 1 - similarity)
    columns = ["id", "kind", "at", "words", "start", "end", "node"]
    named = found.select(*columns, F.col("node").alias("root"))
    if roots is not None:  # only what has bands can be in a class with others
        linked = found.where(F.size("bands") > 0).join(hashed(roots.select(F.col("node").alias("_n"), "root")), F.col("node") == F.col("_n"), "left")
        named = found.where(F.size("bands") == 0).select(*columns, F.col("node").alias("root")).unionAll(linked.select(*columns, F.coalesce("root", "node").alias("root")))
    named = materialise(named, "named", keep=True)
    classes = named.groupBy("root").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    return named, materialise(classes.select(F.col("root").alias("_root"), "first"), "classes", keep=True)


def _runs(named: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """Windows that follow one another in a document as in its keeper: id, first (the keeper), and of
    both the first word, the word past the last, the first words of the first and last window, and
    characters; equal (whether the windows are); nodes (names of those at either end)."""
    inner = named.where(F.col("kind") == _INNER)
    known = materialise(inner.join(hashed(classes), F.col("root") == F.col("_root")).select("id", "at", "start", "end", "node", "root", "first"), "known")
    # the equal window of the keeper if it has one, else the first of the class
    first_of = lambda by, name: materialise(known.where("id = first").groupBy(F.col(by).alias("_r")).agg(F.min(F.struct("at", "start", "end", "node")).alias(name)), name)
    placed = known.where("id <> first").join(hashed(first_of("root", "k0")), F.col("root") == F.col("_r")).drop("_r")
    placed = placed.join(hashed(first_of("node", "k1")), F.col("node") == F.col("_r"), "left").withColumn("k", F.coalesce("k1", "k0"))
    placed = placed.select("id", "first", "at", F.col("k.at").alias("k_at"), "start", "end", F.col("k.start").alias("k_start"), F.col("k.end").alias("k_end"), "node", F.col("k.node").alias("k_node"))
    names = ["id", "first", "at", "last", "k_at", "k_last", "start", "end", "k_start", "k_end", "equal", "nodes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, number = None, [], lambda x: int.from_bytes(x, "little", signed=True)
        for batch in batches:
            for key, first, at, k_at, start, end, k_start, k_end, node, k_node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                equal = node == k_node
                if held is not None and held[:2] == [key, first] and equal and held[10] and at - k_at == held[3] - held[5] and at <= held[3] + WINDOW:
                    if at > held[3]:  # else a row that repeats the id
                        held[3], held[5], held[7], held[9], held[11][1] = at, k_at, end, k_end, number(node)
                    continue
                if held is not None:
                    out.append(held)
                held = [key, first, at, at, k_at, k_at, start, end, k_start, k_end, equal, [number(node), number(k_node)]]
            if len(out) > 10_000:
                yield _batch(out, names, schema)
                out = []
        if held is not None:
            yield _batch([*out, held], names, schema)

    schema = f"id {kind}, first {kind}, at int, last int, k_at int, k_last int, start int, end int, k_start int, k_end int, equal boolean, nodes array<bigint>"
    n = max(1, int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # windows of one alignment with the keeper stand together
    ordered = placed.withColumn("_shift", F.col("at") - F.col("k_at")).repartition(n, "id").sortWithinPartitions("id", "first", "_shift", "at").drop("_shift")
    return materialise(ordered.mapInArrow(run, schema), "runs", keep=True)


def _batch(rows: list[list], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[x.split(" ")[1]]) for k, x in enumerate(schema.split(", "))], names)


def _place(key: np.ndarray, at: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A key of 64 bits for a window: of its document's key, its first word and its name."""
    return mix(mix(key.view(np.uint64) + (at.astype(np.uint64) + np.uint64(1)) * _GOLD) + node.view(np.uint64)).view(np.int64)


def _contexts(rows: DataFrame, runs: DataFrame, kind: str) -> DataFrame:
    """Words around windows at the ends of runs: id, at; before, before_at (hashes of up to REACH - 1
    words, the nearest first, and at how many characters before the window they begin); after,
    after_at (the same beyond it, to where they end); and of windows that are not equal to their
    keeper's own, own_begin, own_end (hashes of its words, and where they begin and end)."""
    context = rows.sparkSession.sparkContext
    ends = materialise(runs.where("not equal").select(F.explode("nodes").alias("node")).distinct(), "ends")
    begin, end, equal = F.col("nodes")[0], F.col("nodes")[1], F.col("equal")
    places = [("id", "at", begin), ("id", "last", F.when(equal, end).otherwise(begin)), ("first", "k_at", F.when(equal, begin).otherwise(end)), ("first", "k_last", end)]
    every = [runs.select(F.col(key).alias("_id"), F.col(at).alias("_at"), node.alias("_node")) for key, at, node in places]
    asked = materialise(every[0].unionAll(every[1]).unionAll(every[2]).unionAll(every[3]).distinct(), "asked")

    def keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, at, node = (np.asarray(x) for x in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.unique(key), _place(key, at, node)]))], ["key"])

    # one filter for documents and windows in them: what it lets through too much is not asked for
    wanted = materialise(map_arrow(asked.select(F.xxhash64("_id"), "_at", "_node"), keys, "key long"), "wanted")
    any_, unlike = (context.broadcast(build(x, x.count())) for x in (wanted, ends))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pa.array(any_.value.test(np.asarray(batch.column(2)))))
        t = Words(batch.column(1))
        at, name, _ = t.windows()
        name = name.view(np.int64)
        keep = any_.value.test(_place(np.asarray(batch.column(2))[t.doc[at]], at - t.base[t.doc[at]], name))
        at, name = at[keep], name[keep]
        whole = unlike.value.test(name)
        if not len(at):
            return
        doc, small = t.doc[at], (t.hash >> np.uint64(32)).astype("<u4")
        begin, end = t.chars[t.start].astype("<i4"), t.chars[t.end].astype("<i4")
        first, past = np.maximum(at - REACH + 1, t.base[doc]), np.minimum(at + WINDOW + REACH - 1, t.base[doc + 1])
        columns: list[list] = [[] for _ in range(7)]
        for k, a, b, full in zip(at.tolist(), first.tolist(), past.tolist(), whole.tolist(), strict=True):
            to = k + WINDOW
            found = [small[a:k][::-1], begin[k] - begin[a:k][::-1], small[to:b], end[to:b] - end[to - 1]]
            found += [small[k:to], begin[k:to] - begin[k], end[k:to] - end[to - 1]] if full else [None] * 3
            for column, x in zip(columns, found, strict=True):
                column.append(None if x is None else x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(at - t.base[doc], pa.int32()), pa.array(name), *(pa.array(x, pa.binary()) for x in columns)], ["id", "at", "node", *_AROUND])

    every = map_arrow(rows.withColumn("key", F.xxhash64("id")), run, f"id {kind}, at int, node long, {', '.join(f'{x} binary' for x in _AROUND)}", 1)
    found = materialise(every.join(asked, (F.col("id") == F.col("_id")) & (F.col("at") == F.col("_at")) & (F.col("node") == F.col("_node")), "left_semi").drop("node").dropDuplicates(["id", "at"]), "contexts")
    any_.destroy()
    unlike.destroy()
    return found


#: Kinds of rows that passages are made of, in their order; words around a document's own windows come without `first`.
_AROUND_ROW, _LINE_ROW, _RUN_ROW = 0, 1, 2
_AROUND = ["before", "before_at", "after", "after_at", "own", "own_begin", "own_end"]


class _Around:
    """A window of an altered run with its neighbours, in order: hashes, beginnings (counted from that
    of the window) and ends (counted from its end) of words; pre is how many stand before it."""

    def __init__(self, x: dict):
        ints = lambda name, kind: np.frombuffer(x[name], kind)
        before, after = ints("before", "<u4")[::-1], ints("after", "<u4")
        self.pre, self.own = len(before), ints("own", "<u4")
        self.hash = np.concatenate([before, self.own, after])
        self.begin = np.concatenate([-ints("before_at", "<i4")[::-1], ints("own_begin", "<i4"), np.zeros(len(after), np.int32)])
        self.end = np.concatenate([np.zeros(len(before), np.int32), ints("own_end", "<i4"), ints("after_at", "<i4")])


def _shared(a: dict | None, b: dict | None, name: str) -> int:
    """How many words from the first on are equal."""
    x, y = (np.frombuffer(v[name], "<u4") if v else np.empty(0, np.uint32) for v in (a, b))
    n = min(len(x), len(y))
    unlike = np.flatnonzero(x[:n] != y[:n])
    return int(unlike[0]) if len(unlike) else n


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of the shingles of two windows."""
    a, b = ({tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)} for w in (x.tolist(), y.tolist()))
    return len(a & b) / max(1, len(a | b))


def _grown(row: tuple, similarity: float) -> Iterator[list]:
    """Runs of equal words (at, to, k_at, k_to, start, end, k_start, k_end) of a run of windows: equal
    windows grow at both ends; of a window and its keeper's that are alike the stretches of equal words
    are taken; of two that are so by way of others only, nothing."""
    at, last, k_at, k_last, start, end, k_start, k_end, equal, a, b, c, d = row
    if equal:
        left, right = _shared(a, c, "before"), _shared(b, d, "after")
        moved = lambda x, name, n: int(np.frombuffer(x[name], "<i4")[n - 1]) if n else 0
        bounds = start - moved(a, "before_at", left), end + moved(b, "after_at", right), k_start - moved(c, "before_at", left), k_end + moved(d, "after_at", right)
        yield [at - left, last + WINDOW + right, k_at - left, k_last + WINDOW + right, *bounds]
    elif a and c and a["own"] and c["own"] and _alike((a := _Around(a)).own, (c := _Around(c)).own) >= similarity - 1e-9:
        pre = min(a.pre, c.pre)
        x, y = a.pre - pre, c.pre - pre
        n = min(len(a.hash) - x, len(c.hash) - y)
        same = np.concatenate([[False], a.hash[x : x + n] == c.hash[y : y + n], [False]])
        for i, j in zip(np.flatnonzero(same[1:] & ~same[:-1]).tolist(), np.flatnonzero(same[:-1] & ~same[1:]).tolist(), strict=True):
            if j - i >= SHINGLE and j > pre and i < pre + WINDOW:
                bounds = start + a.begin[x + i], end + a.end[x + j - 1], k_start + c.begin[y + i], k_end + c.end[y + j - 1]
                yield [at - pre + i, at - pre + j, k_at - pre + i, k_at - pre + j, *map(int, bounds)]


def _joined(runs: list[list], similarity: float) -> Iterator[list]:
    """Runs (at, to, k_at, k_to, start, end, k_start, k_end) of one document and keeper, in order, joined over up to GAP foreign words where the whole is alike: the shingles that
    equal words give, over those of both texts, are `similarity` or more."""
    held, common = None, 0
    for run in runs:
        if held is not None:
            gaps = run[0] - held[1], run[2] - held[3]
            if run[1] <= held[1] and run[3] <= held[3] and run[2] - run[0] == held[2] - held[0]:
                continue  # within what is held
            lost = max(0, -min(gaps))
            more = common + max(0, run[1] - run[0] - lost - SHINGLE + 1)
            both = (run[1] - held[0]) + (run[3] - held[2]) - 2 * (SHINGLE - 1)
            if max(gaps) <= GAP and min(gaps) >= -REACH and run[1] > held[1] and run[3] > held[3] and more >= similarity * (both - more):
                held[1], held[3], held[5], held[7], common = run[1], run[3], run[5], run[7], more
                continue
            yield held
        held, common = list(run), max(0, run[1] - run[0] - SHINGLE + 1)
    if held is not None:
        yield held


def _overlaid(found: list[list]) -> list[list]:
    """Passages of one document and keeper, those that overlap as one: words that are said over and over
    match the keeper at many places.  What names it is the longest of the keeper's."""
    out: list[list] = []
    for x in sorted(found):
        if out and x[0] < out[-1][1]:
            held = out[-1]
            if x[1] > held[1]:
                held[1], held[5] = x[1], x[5]
            if x[3] - x[2] > held[3] - held[2]:
                held[2:4], held[6:8] = x[2:4], x[6:8]
        else:
            out.append(list(x))
    return out


def _outermost(found: list[list]) -> list[list]:
    """Passages (first, start, end, ..., class, own) of one document without those that lie within another
    whose keeper is no later.  Of those with one keeper and the same ends one stays: a line that the keeper
    has too (own), else the inner passage, which says what the keeper has, else a line."""
    out, widest = [], None
    for x in sorted(found, key=lambda x: (x[1], -x[2], x[0], 1 if x[7] is None else 0 if x[8] else 2)):
        if widest is None or x[2] > widest[2] or x[0] < widest[0]:
            out.append(x)
        if widest is None or x[2] > widest[2]:
            widest = x
    return out


def _passages(rows: DataFrame, lines: DataFrame, runs: DataFrame, kind: str, similarity: float, least: int) -> DataFrame:
    """id, first, start, end, words, k_start, k_end, k_words of passages of `least` words or more, and
    of lines (id, first, start, end, words, class, own: whether the keeper has the line itself), which
    have no k_; what lies within another is left out."""
    around = _contexts(rows, runs, kind)

    # windows of a document, and those of its keepers once for each that asks for them, however many runs do
    kept = [runs.select("id", "first", F.col(x).alias("at")) for x in ("k_at", "k_last")]
    kept = materialise(kept[0].unionAll(kept[1]).distinct(), "kept")
    side = around.select(F.col("id").alias("_i"), F.col("at").alias("_a"), *_AROUND)
    side = F.broadcast(side) if broadcastable(side, MOST_ROWS // 5) else hashed(side)
    kept = kept.join(side, (F.col("first") == F.col("_i")) & (F.col("at") == F.col("_a"))).select("id", "first", F.lit(_AROUND_ROW).alias("what"), "at", *_AROUND)
    full = runs.drop("nodes").withColumn("what", F.lit(_RUN_ROW)).unionByName(kept, allowMissingColumns=True)
    full = full.unionByName(around.withColumn("what", F.lit(_AROUND_ROW)), allowMissingColumns=True)
    full = full.withColumn("class", F.lit(None).cast("long")).select("id", "first", "what", "class", "at", "last", "k_at", "k_last", "start", "end", "k_start", "k_end", "equal", *_AROUND)
    names = ["id", "first", "start", "end", "words", "k_start", "k_end", "k_words", "class"]
    schema = f"id {kind}, first {kind}, start int, end int, words int, k_start int, k_end int, k_words int, class bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, own, theirs, held, found, out = None, None, {}, {}, [], [], []

        def passages() -> None:
            for x in _overlaid([x for x in _joined(sorted(held), similarity) if min(x[1] - x[0], x[3] - x[2]) >= least]):
                found.append([first, x[4], x[5], x[1] - x[0], x[6], x[7], x[3] - x[2], None, None])
            held.clear()
            theirs.clear()

        def done() -> None:
            passages()
            own.clear()
            out.extend([key, *x[:8]] for x in _outermost(found))
            found.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    done()
                elif row[1] != first:
                    passages()
                key, first = row[:2]
                if row[2] == _AROUND_ROW:
                    (own if first is None else theirs)[row[4]] = dict(zip(_AROUND, row[13:], strict=True))
                elif row[2] == _LINE_ROW:
                    found.append([first, row[8], row[9], row[5], None, None, None, row[3], row[12]])
                else:
                    held.extend(_grown((*row[4:13], own.get(row[4]), own.get(row[5]), theirs.get(row[6]), theirs.get(row[7])), similarity))
            if len(out) > 10_000:
                yield _batch(out, names, schema)
                out.clear()
        done()
        if out:
            yield _batch(out, names, schema)

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = full.unionByName(lines.select("id", "first", F.lit(_LINE_ROW).alias("what"), "class", F.col("words").alias("last"), "start", "end", F.col("own").alias("equal")), allowMissingColumns=True)
    ordered = every.repartition(n, "id").sortWithinPartitions("id", "first", "what", "at")
    return materialise(ordered.mapInArrow(run, schema), "passages")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per repeated passage of a document: id_col, start, end (characters of its text),
    n_words, kind (line or inner), class_id, first_id (the document that keeps it), removed.

    A line has `least_words` words or more, or PASSAGE_WORDS if that is more, and is in a class with
    lines of other documents; an inner passage is held by its keeper too: word for word, or alike by
    `similarity` where a few words differ.  The keeper has a row (removed is false) for all that
    others have of it.  Passages with one keeper that overlap are one, though it may have their parts in
    different places (as words said over and over).  What lies within another passage, with a keeper no later, is not listed; of a line and an inner
    passage with the same ends and keeper, the line is if the keeper has the same line, else the inner one.
    Words are runs of letters and digits, A-Z as a-z, whatever stands between them, line breaks too.

    Rows with the same id are one document, within which nothing repeats; ties go to the least id.
    Null and empty texts, and rows without id, have no passages; an empty table gives no rows.  Very
    long texts are taken whole.  Other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            named, classes = _classes(_paragraphs(rows, kind), similarity)
        line = named.where((F.col("kind") == _LINE) & (F.col("words") >= least_words)).join(classes, F.col("root") == F.col("_root"))
        heads = line.where("id = first").select(F.col("node").alias("_node"), F.lit(True).alias("own")).distinct()
        line = line.join(heads, F.col("node") == F.col("_node"), "left").select("id", "start", "end", "words", F.xxhash64("root").alias("class"), "first", F.coalesce("own", F.lit(False)).alias("own"))
        with scratch(docs.sparkSession):
            runs = _runs(named, classes, kind)
        every = _passages(rows, line, runs, kind, similarity, least_words)
        inner = every.where("class is null")
        name = F.xxhash64("first", "k_start", "k_end").alias("class")
        line = every.where("class is not null").select("id", "start", "end", "words", F.lit("line").alias("kind"), "class", "first")
        lost = inner.select("id", "start", "end", "words", F.lit("inner").alias("kind"), name, "first")
        kept = inner.groupBy("first", "k_start", "k_end").agg(F.min("k_words").alias("words")).select(F.col("first").alias("id"), F.col("k_start").alias("start"), F.col("k_end").alias("end"), "words", F.lit("inner").alias("kind"), name, "first")
        found = materialise(line.unionAll(lost).unionAll(kept), "repeated", keep=True)
    return found.select(F.col("id").alias(id_col), "start", "end", F.col("words").alias("n_words"), "kind", F.col("class").alias("class_id"), F.col("first").alias("first_id"), (F.col("id") != F.col("first")).alias("removed"))


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages that are marked as removed; other texts are as they were."""
    spans = passages.where("removed").groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))

    @F.pandas_udf("string")
    def without(text, spans):
        out = []
        for t, s in zip(text, spans, strict=True):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            parts, at = [], 0
            for span in s:
                parts.append(t[at : max(at, span["start"])])
                at = max(at, span["end"])
            out.append("".join([*parts, t[at:]]))
        import pandas as pd

        return pd.Series(out, dtype=object)

    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    joined = plain.join(spans, F.col(f"c{names.index(id_col)}") == F.col("__id"), "left")
    return joined.select(*[without(F.col(f"c{k}"), F.col("__spans")).alias(c) if c == text_col else F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))
