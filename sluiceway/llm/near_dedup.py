"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its shingles of five words with their counts.  Every element has
a field of weight by rank into which darts are thrown, as a Poisson process that depends on the
element alone.  The fields are cut into regions that double in size; a document looks only at
regions below its weights and below a rank at which it expects enough darts, about k log k in
all whatever its length.  Darts are dealt to k coordinates, and each keeps that of least rank:
two documents agree in a coordinate with the probability of their weighted Jaccard similarity.
Bands of coordinates give candidates, which are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import build
from .common import binary, broadcastable, map_arrow, materialise, mix, raw, read_table, scratch, windows, words
from .linking import bucket_members, link, pack

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 meets in one of 24 bands of 6 with probability 0.9993.
BANDS, ROWS = 24, 6
K = BANDS * ROWS
#: Ids that are broadcast as a table.
MOST_IDS = 100_000
#: Bits of the filter of ids whose sets are wanted.
ID_BITS = 1 << 27
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _poisson(mean: float) -> np.ndarray:
    """Cumulative distribution, as far as it differs from one."""
    top = int(mean + 12 * np.sqrt(mean) + 20)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
    return np.cumsum(np.exp(np.arange(top + 1) * np.log(mean) - mean - logs))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _region_rank(r: int) -> tuple[float, float]:
    """Region r of ranks: [0, 1/8), [1/8, 1/4), [1/4, 1/2), ..."""
    return (0.0, 0.125) if r == 0 else (0.0625 * 2**r, 0.125 * 2**r)


def _throw(element: np.ndarray, weight: np.ndarray, slot: np.ndarray, limit: np.ndarray):
    """Darts that hit: place (slot * K + coordinate), rank, name; limit: of ranks, by element."""
    out = []
    for r in range(64):
        low, high = _region_rank(r)
        near = np.flatnonzero(limit > low)
        if not len(near):
            break
        for v in range(40):
            base, width = 2.0**v - 1, 2.0**v
            own = near[weight[near] > base] if v else near
            if not len(own):
                break
            key = mix(element[own] + np.uint64((r * 64 + v + 1) * int(_GOLD) % 2**64))
            count = np.searchsorted(_poisson(width * (high - low)), _uniform(key), "right")
            which = np.repeat(np.arange(len(own)), count)
            if not len(which):
                continue
            number = (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
            name = mix(key[which] + (number + np.uint64(1)) * _GOLD)
            second = mix(name ^ np.uint64(0xD1B54A32D192ED03))
            rank = low + _uniform(second) * (high - low)
            hit = rank < limit[own[which]]
            if v:
                hit &= base + _uniform(mix(second)) * width < weight[own[which]]
            which, name, rank = which[hit], name[hit], rank[hit]
            out.append((slot[own[which]] * K + (name % np.uint64(K)).astype(np.int64), rank, name))
    if not out:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64)
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """K names of darts for each document; documents without elements get noughts.
    element: 64-bit names; weight: positive; doc: ascending."""
    out = np.zeros((n_docs, K), np.uint64)
    total = np.bincount(doc, weight, n_docs)
    todo = np.flatnonzero(total > 0)
    enough = K * (np.log(K) + 2)
    while len(todo):
        slot = np.full(n_docs, -1)
        slot[todo] = np.arange(len(todo))
        mine = slot[doc] >= 0
        e, w, s = element[mine], weight[mine], slot[doc[mine]]
        place, rank, name = _throw(e, w, s, (enough / total[todo])[s])
        best = np.full(len(todo) * K, np.inf)
        np.minimum.at(best, place, rank)
        first = rank == best[place]
        found = np.zeros(len(todo) * K, np.uint64)
        found[place[first]] = name[first]
        full = np.isfinite(best).reshape(-1, K).all(axis=1)
        out[todo[full]] = found.reshape(-1, K)[full]
        todo, enough = todo[~full], enough * 2
    return out


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts: 64-bit name, count and text, in the order of text and name.
    A text without words has one shingle of its own, made of what it has between its blanks."""
    data, offsets = raw(column)
    _, _, doc, hashes = words(data, offsets)
    h, d, _ = windows(hashes, doc, len(column), n)
    bare = np.flatnonzero(np.bincount(d, minlength=len(column)) == 0)
    if len(bare):
        import hashlib

        texts = binary(column)
        own = [int.from_bytes(hashlib.blake2b(texts[int(k)].as_py().strip(), digest_size=8, person=b"bare").digest(), "little") for k in bare]
        h, d = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([d, bare])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), d[at]


def digests(h: np.ndarray, count: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """16 bytes that name the weighted set of each text, in any order of its elements."""
    out = np.zeros((n, 2), np.uint64)
    for k, salt in enumerate((0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D)):
        np.add.at(out[:, k], doc, mix(mix(h ^ np.uint64(salt)) + count.astype(np.uint64)))
    return out


def band_names(signature: np.ndarray, rows: int) -> np.ndarray:
    """A name for each band of `rows` coordinates."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    name = np.broadcast_to(np.arange(k // rows, dtype=np.uint64) * _GOLD, (n, k // rows)).copy()
    for i in range(rows):
        name = mix(name + parts[:, :, i])
    return name


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, node (the digest of its set), names of its bands."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        h, count, doc = shingle_sets(batch.column(1))
        bands = band_names(signatures(h, count.astype(float), doc, n), ROWS)
        node = digests(h, count, doc, n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in node], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))], ["id", "node", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(_two(docs, id_col, text_col), run, f"id {kind}, node binary, bands array<long>", 1)


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _sets(rows: DataFrame, wanted) -> DataFrame:
    """node, shingles and weights of those rows (key, text) whose keys the broadcast filter has."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pa.array(wanted.value.test(np.asarray(batch.column(0)))))
        n = batch.num_rows
        if not n:
            return
        h, count, doc = shingle_sets(batch.column(1))
        node = [x.tobytes() for x in digests(h, count, doc, n)]
        at = np.searchsorted(doc, np.arange(n + 1))
        packed = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            packed.append(pack(h[a:b], count[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], ["node", "shingles", "weights"])

    return map_arrow(rows, run, "node binary, shingles binary, weights binary", 1)


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row, the node that of its class, and (_n, _first, n) of classes of more than one row."""
    sketches = materialise(_sketches(docs, id_col, text_col), "sketches")
    nodes = materialise(sketches.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "nodes")
    members = bucket_members(nodes.select(F.explode("bands").alias("band"), "node"))
    wanted = materialise(members.select("node").distinct().join(nodes.select("node", "id"), "node").select(F.col("node").alias("_node"), F.col("id").alias("_id")), "wanted")
    # a filter of ids in place of their table, whatever their number: texts are not shuffled, and what it lets through too much has no wanted node
    key = lambda x: F.xxhash64(x).alias("key")
    ids = docs.sparkSession.sparkContext.broadcast(build(wanted.select(key("_id")), wanted.count(), ID_BITS))
    sets = materialise(_sets(_two(docs, id_col, text_col).select(key("id"), "text"), ids).join(wanted.select("_node"), F.col("node") == F.col("_node"), "left_semi").dropDuplicates(["node"]), "sets")
    ids.destroy()
    roots = link(members, sets, 1 - similarity)
    named = sketches.select("id", "node")
    if roots is not None:
        named = named.join(roots.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left").select("id", F.coalesce("root", "node").alias("node"))
    named = materialise(named, "named", keep=True)
    classes = named.groupBy("node").agg(F.min(F.struct("id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named, materialise(classes.select(F.col("node").alias("_n"), F.col("first.id").alias("_first"), "n"), "classes", keep=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id_col, class_id (the least id of its class), class_size, kept.

    Two documents are linked if the weighted Jaccard similarity of their shingles of five words
    (A-Z as a-z; a shorter text is one shingle) is `similarity` or more; classes are connected by
    links.  Null is empty; texts without words are linked if equal but for blanks at their ends,
    so all empty ones are one class.  Rows that repeat an id are kept alike.  Null ids come first.
    An empty table gives no rows.  Other columns are not read."""
    with scratch(docs.sparkSession):
        named, classes = _classes(docs, id_col, text_col, similarity)
    out = named.join(classes, F.col("node") == F.col("_n"), "left")
    class_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("_first"))
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce("n", F.lit(1)).cast("long").alias("class_size"), class_id.eqNullSafe(F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class, that of the least id; columns are as they were.

    Null texts are empty, and all empty ones are one class; null ids come first.  Of rows that
    repeat an id one stays, where their class has more than one row.  An empty table stays empty."""
    found = materialise(near_duplicates(docs, id_col, text_col, similarity), "near")
    lost = found.where("not kept").select(F.col(id_col).alias("__lost")).distinct()
    side = F.broadcast(lost) if broadcastable(lost, MOST_IDS) else lost
    left = docs.join(side, F.col(id_col).eqNullSafe(F.col("__lost")), "left_anti")
    again = found.where("kept and class_size > 1").groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("__again"))
    if again.limit(1).count():
        again = materialise(again, "again")
        once = left.join(again, F.col(id_col).eqNullSafe(F.col("__again")), "left_semi").dropDuplicates([id_col])
        left = left.join(again, F.col(id_col).eqNullSafe(F.col("__again")), "left_anti").unionAll(once)
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
