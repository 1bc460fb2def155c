import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sluiceway.llm import quality

from .awkward import TEXTS, awkward, empty

LABELS = "doc_id long, quality int, toxic int"


def test_scores_are_those_of_each_text_alone(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(1, None, None), (None, 1, 1), (1, 1, 0)], LABELS)
    found = quality.resample(awkward(spark), labels).collect()
    assert len(found) == len(TEXTS)
    held = {r.doc_id for r in spark.range(20).select(quality.F.col("id").alias("doc_id"), quality.held_out(quality.F.col("id")).alias("h")).where("h").collect()}
    good = {k for k in range(20) if (k % 2 or k == 1) and k not in held}
    count = lambda texts: sum((np.bincount(quality.grams(pa.array([t]))[0], minlength=1 << quality.BITS) for t in texts), np.zeros(1 << quality.BITS))
    ratios = quality.log_ratios(count([t or "" for k, t in TEXTS if k in good]), count([t or "" for _, t in TEXTS]))
    for r in found:
        own = [t for k, t in TEXTS if k == r.doc_id]
        weights = [float(ratios[quality.grams(pa.array([t or ""]))[0]].sum()) for t in own]
        assert min(abs(r.log_weight - w) for w in weights) < 1e-6 * max(1, abs(r.log_weight))
    keys = sorted((r.key for r in found), reverse=True)
    kept = sorted((r.key for r in found if r.kept), reverse=True)
    assert kept and kept == keys[: len(kept)]
    assert all(r.n_grams == 0 and r.log_weight == 0 for r in found if r.doc_id in (4, 5))


def test_grams_by_hand():
    bins, doc, n = quality.grams(pa.array(["Ab c", "", "é", None, "abcd abcd abcd"]))
    # words, neighbours, triples of bytes
    assert np.bincount(doc, minlength=n).tolist() == [2 + 1 + 2, 0, 1, 0, 3 + 2 + 12]


def test_kth_largest_with_ties(spark):
    values = [5, -3, 5, 5, 2**63 - 1, -(2**63), 0, 70_000, -70_000, 5]
    df = spark.createDataFrame([(v,) for v in values], "rank long")
    for k in range(1, len(values) + 1):
        assert quality.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, 0) is None and quality.kth_largest(df, 11) is None


def test_prefers_target_and_samples_by_noise(spark):
    good, bad = "clear careful prose about rivers", "zzz click buy now $$$"
    rows = [(k, f"{good if k % 2 else bad} {k % 7}") for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)], LABELS)
    kept = {r.doc_id for r in quality.resample(awkward(spark, rows), labels, share=0.4).where("kept").collect()}
    assert len(kept) == 160 and sum(k % 2 for k in kept) > 150


def test_without_labels_and_without_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r.log_weight for r in quality.resample(awkward(spark), none).collect()} == {0.0}
    assert quality.resample(empty(spark), none).count() == 0


def plain_grams(text):
    """Words, pairs of neighbours and triples of bytes, without hashing."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    data = (text or "").encode()
    return [*words, *zip(words, words[1:], strict=False), *(data[k : k + 3] for k in range(len(data) - 2))]


def test_whole_query_against_models_of_plain_grams(spark):
    texts = [None, "", "up a hill", "up up a hill", "down é lane", "A hill", "lane", "up a lane"]
    rows = [(k, texts[k % 8]) for k in range(64)]
    labels = [(k, int(k % 8 in (2, 3, 5)), 0) for k in range(32)]
    held = {r.k for r in spark.range(64).select(F.col("id").alias("k"), (F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0).alias("h")).where("h").collect()}
    distinct = {g for t in texts for g in plain_grams(t)}
    bins = {b for t in texts for b in quality.grams(pa.array([t or ""]))[0].tolist()}
    assert len(bins) == len(distinct), "these few grams share no bin, so hashing changes nothing"
    target, raw = Counter(), Counter()
    for k, text in rows:
        raw.update(plain_grams(text))
        if k < 32 and labels[k][1] and k not in held:
            target.update(plain_grams(text))
    size = 1 << quality.BITS
    p = lambda of, g: math.log((of[g] + quality.SMOOTHING) / (sum(of.values()) + quality.SMOOTHING * size))
    weights = {k: sum(p(target, g) - p(raw, g) for g in plain_grams(text)) for k, text in rows}
    noise = {r.k: r.x for r in spark.range(64).select(F.col("id").alias("k"), F.xxhash64(F.col("id"), F.lit(quality.SEED)).alias("x")).collect()}

    def mixed(x):
        x &= 2**64 - 1
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & 2**64 - 1
        return x ^ x >> 31

    keys = {k: w - math.log(-math.log(((mixed(noise[k]) >> 11) + 0.5) / 2**53)) for k, w in weights.items()}
    known = [k for k in range(32) if k not in held]
    share = (sum(labels[k][1] for k in known) + 1) / (len(known) + 1)
    top = set(sorted(keys, key=keys.get, reverse=True)[: round(share * 64)])
    found = quality.resample(awkward(spark, rows).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    for r in found:
        assert r.n_grams == len(plain_grams(texts[r.doc_id % 8]))
        assert math.isclose(r.log_weight, weights[r.doc_id], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.key, keys[r.doc_id], rel_tol=1e-9, abs_tol=1e-9)
    assert {r.doc_id for r in found if r.kept} == top
