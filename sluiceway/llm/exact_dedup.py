"""Exact deduplication with a two-pass Bloom filter.

Pass 1 hashes every normalised text and counts hash bits up to two; a bit set by two
different rows goes into the filter of possible repeats.  Pass 2 tests each row: only
rows with all bits in that filter are shuffled and grouped by the full SHA-256, the rest
pass straight through.  The filter errs on one side only, so results are exact.

The filter is bounded: beyond MAX_BITS the hashes are dealt into classes, written apart in one
pass over the small table of hashes.  A filter is built for each class in turn from its own part
alone, tested there and destroyed before the next, so that workers hold one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import build
from .common import binary, exists, map_arrow, materialise, new_path, read_table, scratch

BITS_PER_KEY, PROBES = 8, 3
#: Of one filter: 64 MB, the most that is broadcast.
MAX_BITS = 1 << 29
SEGMENT = 1 << 16
#: That build one filter: each counts about a million hashes of the 67 million of a full one.
TASKS = 64
_BLANK = b" \t\n\x0b\x0c\r"


def _digest(value: bytes) -> bytes:
    return hashlib.sha256(value.translate(None, _BLANK)).digest()


def text_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, SHA-256 of the text without blanks, and its code points (null: empty)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = binary(batch.column(1))
        sha = pa.array([_digest(x) for x in text.to_pylist()], pa.binary())
        points = pc.fill_null(pc.utf8_length(batch.column(1).cast(pa.string())), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sha, points], ["id", "sha", "points"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, sha binary, points long", 1)


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """Bits of each digest; where two fall together the second is -1, so that one row never counts twice."""
    h = np.frombuffer(b"".join(digests), "<u8").reshape(len(digests), 4)
    at = np.sort(((h[:, :1] + np.arange(PROBES, dtype=np.uint64) * (h[:, 1:2] | np.uint64(1))) % np.uint64(bits)).astype(np.int64), axis=1)
    at[:, 1:][at[:, 1:] == at[:, :-1]] = -1
    return at


def _or_counts(seen: np.ndarray, twice: np.ndarray, at: np.ndarray) -> None:
    bit, n = np.unique(at[at >= 0], return_counts=True)
    byte, mask = bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8)
    again = (n > 1) | ((seen[byte] & mask) > 0)
    np.bitwise_or.at(twice, byte[again], mask[again])
    np.bitwise_or.at(seen, byte, mask)


def repeats_filter(hashes: DataFrame, bits: int) -> bytes:
    """The bitmap of bits that at least two rows set.  Tasks count in two bitmaps;
    their segments are merged by segment, and only the merged bitmap comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros(-(-bits // 8), np.uint8), np.zeros(-(-bits // 8), np.uint8)
        for batch in batches:
            digests = batch.column(0).to_pylist()
            if digests:
                _or_counts(seen, twice, _positions(digests, bits))
        for k in range(0, len(seen), SEGMENT):
            if seen[k : k + SEGMENT].any():
                yield pa.RecordBatch.from_pydict({"segment": [k // SEGMENT], "seen": [seen[k : k + SEGMENT].tobytes()], "twice": [twice[k : k + SEGMENT].tobytes()]}, pa.schema([("segment", pa.int64()), ("seen", pa.binary()), ("twice", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, t = np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8)
                if k in held:
                    a, b = held[k]
                    held[k] = [a | s, b | t | (a & s)]
                else:
                    held[k] = [s, t]
        for k, (_, t) in held.items():
            yield pa.RecordBatch.from_pydict({"segment": [k], "twice": [t.tobytes()]}, pa.schema([("segment", pa.int64()), ("twice", pa.binary())]))

    segments = -(-bits // 8 // SEGMENT) or 1
    # each task sends the segments that it has set: so many tasks as the cluster has use for, and no more
    counted = hashes.select("sha").coalesce(TASKS).mapInArrow(count, "segment long, seen binary, twice binary")
    out = bytearray(-(-bits // 8))
    for row in counted.repartition(min(segments, TASKS), "segment").mapInArrow(merge, "segment long, twice binary").toLocalIterator():
        out[row.segment * SEGMENT : row.segment * SEGMENT + len(row.twice)] = row.twice
    return bytes(out)


def _test(digests: list[bytes], bitmap: np.ndarray, bits: int) -> np.ndarray:
    at = _positions(digests, bits)
    hit = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return np.where(at < 0, 1, hit).all(axis=1)


def _marked(hashes: DataFrame, max_bits: int) -> DataFrame:
    """`hashes` with `maybe`: whether another row may have the same hash (never wrongly false)."""
    spark, rows = hashes.sparkSession, hashes.count()
    classes = max(1, -(-rows * BITS_PER_KEY // max_bits))
    bits = max(1 << 12, min(max_bits, rows * BITS_PER_KEY // classes))
    kind = hashes.schema["id"].dataType.simpleString()
    with scratch(spark):
        if classes > 1:
            number = F.pmod(F.xxhash64("sha"), F.lit(classes)).cast("int")
            path = new_path(spark, "classes")
            hashes.withColumn("class", number).repartition("class", F.pmod(F.xxhash64("sha", F.lit(1)), F.lit(8))).write.partitionBy("class").parquet(path)
            parts = [spark.read.schema(hashes.schema).parquet(f"{path}/class={k}") for k in range(classes) if exists(spark, f"{path}/class={k}")]
        else:
            parts = [hashes]
        out = []
        for part in parts:
            kept = spark.sparkContext.broadcast(repeats_filter(part, bits))

            def run(batch: pa.RecordBatch, kept=kept) -> Iterator[pa.RecordBatch]:
                if batch.num_rows:
                    maybe = _test(batch.column(1).to_pylist(), np.frombuffer(kept.value, np.uint8), bits)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*batch.schema.names, "maybe"])

            out.append(materialise(map_arrow(part, run, f"id {kind}, sha binary, points long, maybe boolean"), "marked", keep=True))
            kept.destroy()
    every = out[0] if out else hashes.withColumn("maybe", F.lit(False))
    for more in out[1:]:
        every = every.unionAll(more)
    return every


def groups(rows: DataFrame) -> DataFrame:
    """One row for each text that occurs more than once: who stays, and how many rows it has.
    Grouping combines on the map side first, so a text that fills a third of the rows does no harm."""
    best = F.min(F.struct((-F.col("points")).alias("points"), "id"))
    return rows.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sha").alias("_sha"), F.col("best.id").alias("_keep"), (-F.col("best.points")).alias("_keep_points"), F.col("n").alias("_n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deletion of blanks (space, tab to carriage return).
    Null counts as empty; empty texts are equal.  Of equal texts the one with the most code
    points stays, then the smallest id (null first).  An empty table gives no rows.  Rows that
    repeat an id and its text wholly are one document: all have the same keep_id and kept, each
    counts in group_size.  Other columns are ignored whatever their names."""
    marked = _marked(materialise(text_hashes(docs, id_col, text_col), "hashes"), max_bits)
    maybe = marked.where("maybe")
    # the groups are written first, so that this join shuffles both its sides and a hot text can be split
    found = maybe.join(materialise(groups(maybe), "groups"), F.col("sha") == F.col("_sha"), "left")
    alone = F.col("_n").isNull()
    tail = F.lower(F.hex("sha")).alias("text_sha256")
    own = F.col("id").alias(id_col)
    shuffled = found.select(own, F.when(alone, F.col("id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("_keep").eqNullSafe(F.col("id")) & (F.col("_keep_points") == F.col("points")))).alias("kept"), tail)
    straight = marked.where("not maybe").select(own, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), tail)
    return straight.unionAll(shuffled)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """docs without all but one row of each group of equal texts, as `exact_dedup` chooses it;
    columns are as they were.  A filter over the hashes of groups lets rows that cannot repeat pass
    where they are read; only the others are joined.  Null counts as empty, so one of all null and blank texts stays; null ids come first.  Of rows
    that repeat both id and length one stays, whichever.  An empty table stays empty."""
    marked = _marked(materialise(text_hashes(docs, id_col, text_col), "hashes"), max_bits)
    best = materialise(groups(marked.where("maybe")), "groups")
    word = F.conv(F.substring(F.hex("_sha"), 1, 15), 16, 10).cast("long")
    repeats = docs.sparkSession.sparkContext.broadcast(build(best.select(word.alias("word")), best.count()))
    names, at = docs.columns, docs.columns.index(text_col)

    def part(wanted: bool, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            sha = [_digest(x) for x in binary(batch.column(at)).to_pylist()]
            words = np.frombuffer(b"".join(x[:8] for x in sha), ">u8") >> np.uint64(4)
            keep = repeats.value.test(words.astype(np.int64)) == wanted
            if wanted:
                batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(sha, pa.binary())], [*batch.schema.names, "__sha"])
            yield batch.filter(pa.array(keep))

    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)])
    renamed = docs.toDF(*plain.names)
    straight = map_arrow(renamed, lambda b: part(False, b), plain, at)
    held = map_arrow(renamed, lambda b: part(True, b), T.StructType([*plain, T.StructField("__sha", T.BinaryType())]), at)
    joined = held.join(best, F.col("__sha") == F.col("_sha"), "left")
    key, points = f"c{names.index(id_col)}", F.coalesce(F.char_length(F.col(f"c{at}").cast("string")), F.lit(0))
    single = joined.where("_sha is null").select(*plain.names)
    several = joined.where(F.col(key).eqNullSafe(F.col("_keep")) & (points == F.col("_keep_points"))).dropDuplicates(["__sha"]).select(*plain.names)
    return straight.unionAll(single).unionAll(several).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH h AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT text_sha256, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size
  FROM h GROUP BY text_sha256)
SELECT h.doc_id, k.keep_id, k.group_size, h.doc_id = k.keep_id AS kept, h.text_sha256
FROM h JOIN k USING (text_sha256)
"""
