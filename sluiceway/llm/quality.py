"""Quality by importance resampling.

Two generative models of hashed n-grams, of target text (labelled good) and of all raw text,
give every document an importance weight: the sum over its n-grams of the log ratio of their
probabilities.  Documents are sampled without replacement in proportion to their weights by
Gumbel top-k: noise that depends on the id alone is added to the log weight, and the k largest
stay.  The k-th is found exactly by counting digits of the keys, without sorting them.

N-grams are word unigrams and bigrams (A-Z as a-z) and the three-byte sequences of the text as
it stands, in which case, symbols and markup show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcastable, map_arrow, materialise, mix, raw, read_table, words
from .toxicity import held_out

BITS = 16
SMOOTHING = 0.5
MOST_LABELS = 1_000_000
SEED = 11


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and text of every n-gram, and the number of texts."""
    data, offsets = raw(column)
    _, _, doc, h = words(data, offsets)
    shift = np.uint64(64 - BITS)
    one = mix(h + np.uint64(1)) >> shift
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.empty(0, np.int64)
    two = mix(h[pair] * np.uint64(3) + h[pair + 1]) >> shift
    n = max(0, len(data) - 2)
    wide = data.astype(np.uint64)
    three = wide[:n] | wide[1 : n + 1] << np.uint64(8) | wide[2 : n + 2] << np.uint64(16)
    owner = np.searchsorted(offsets, np.arange(n), "right") - 1 if n else np.empty(0, np.int64)
    inside = np.arange(n) + 3 <= offsets[owner + 1] if n else np.empty(0, bool)
    bins = np.concatenate([one, two, mix(three[inside] | np.uint64(1 << 40)) >> shift]).astype(np.int64)
    return bins, np.concatenate([doc, doc[pair], owner[inside]]).astype(np.int64), len(column)


def counts(texts: DataFrame) -> np.ndarray:
    """N-grams of the one text column by bin; every task counts its own, and bins are summed by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import slices

        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                total += np.bincount(grams(part.column(0))[0], minlength=1 << BITS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["bin", "n"])

    out = np.zeros(1 << BITS)
    for row in texts.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.bin] = row.n
    return out


def log_ratios(target: np.ndarray, everything: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) of each bin; nought everywhere without a target."""
    if not target.sum() or not everything.sum():
        return np.zeros(len(target))
    def p(x: np.ndarray) -> np.ndarray:
        return np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * len(x)))

    return p(target) - p(everything)


def score(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """id_col, n_grams, log_weight, key (the weight with Gumbel noise) and rank (the key as an
    integer that sorts alike) of whole texts.  Null and empty texts have no n-grams and weight 0."""
    kept = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bins, doc, n = grams(batch.column(1))
        weight = np.bincount(doc, kept.value[bins], n)
        noise = np.asarray(batch.column(2)).astype(np.int64).view(np.uint64)
        u = ((mix(noise) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        key = weight - np.log(-np.log(u)) + 0.0
        bits = key.view(np.int64)
        rank = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(doc, minlength=n), pa.int64()), pa.array(weight), pa.array(key), pa.array(rank)], ["id", "n_grams", "log_weight", "key", "rank"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("noise"))
    return map_arrow(source, run, f"id {kind}, n_grams long, log_weight double, key double, rank long", 1).withColumnRenamed("id", id_col)


def kth_largest(ranks: DataFrame, k: int) -> int | None:
    """The k-th largest of a column `rank`, exactly: 16 bits are settled in each of four passes,
    which count at most 65,536 values.  None if k is nought or there are fewer."""
    if k <= 0:
        return None
    prefix, left = [], k
    shifted = ranks.select((F.col("rank").bitwiseXOR(F.lit(-(2**63)))).alias("r"))
    for step in range(4):
        shift = 48 - 16 * step
        rows = shifted
        if prefix:
            so_far = 0
            for p in prefix:
                so_far = so_far << 16 | p
            rows = rows.where(F.shiftrightunsigned("r", shift + 16) == F.lit(so_far))
        found = rows.groupBy(F.shiftrightunsigned("r", shift).bitwiseAND(0xFFFF).alias("digit")).count()
        for digit, n in sorted(((r.digit, r["count"]) for r in found.toLocalIterator()), reverse=True):
            if n >= left:
                prefix.append(digit)
                break
            left -= n
        else:
            return None
    value = 0
    for p in prefix:
        value = value << 16 | p
    value ^= 1 << 63
    return value - (1 << 64) if value >= 1 << 63 else value


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_grams, log_weight, key, kept.

    The target model is that of all documents labelled 1 and not held out, the raw model that of
    all documents.  `share` of the rows is kept, by default the smoothed share of label 1; rows with
    the same id and text have the same key and are kept alike.  Without labels every weight is 0,
    and the choice is that of the noise.  An empty table gives no rows; other columns are not read."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).alias("_good"))
    total = known.agg(F.count_if("_good").alias("a"), F.count(F.lit(1)).alias("n")).first()
    good = known.where("_good").select("_id")
    side = F.broadcast(good) if broadcastable(good, MOST_LABELS) else good
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    target = counts(texts.join(side, F.col(id_col) == F.col("_id"), "left_semi").select("_text"))
    scored = materialise(score(docs, log_ratios(target, counts(texts.select("_text"))), id_col, text_col), "weights")
    part = share if share is not None else (total.a + 1) / (total.n + 1)
    least = kth_largest(scored, round(part * scored.count()))
    kept = F.lit(False) if least is None else F.col("rank") >= F.lit(least)
    return scored.select(id_col, "n_grams", "log_weight", "key", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
