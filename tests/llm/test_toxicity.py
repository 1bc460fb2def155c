import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluiceway.llm import toxicity as t

from .awkward import TEXTS, awkward, empty

LABELS = "doc_id long, quality int, toxic int"


def brute_marginals(e, first, model):
    """Forward-backward, one token after another."""
    out = []
    cuts = [*np.flatnonzero(first), len(e)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        step, w = np.exp(model.step), np.stack([np.ones(b - a), np.exp(np.clip(e[a:b], -30, 30))], axis=1)
        ahead, behind = np.empty((b - a, 2)), np.ones((b - a, 2))
        ahead[0] = np.exp(model.start) * w[0]
        ahead[0] /= ahead[0].sum()
        for k in range(1, b - a):
            ahead[k] = ahead[k - 1] @ step * w[k]
            ahead[k] /= ahead[k].sum()
        for k in range(b - a - 2, -1, -1):
            behind[k] = step @ (w[k + 1] * behind[k + 1])
            behind[k] /= behind[k].sum()
        p = ahead * behind
        out.append(p[:, 1] / p.sum(1))
    return np.concatenate(out)


def test_marginals_against_forward_backward():
    r = np.random.default_rng(1)
    for n in (1, 2, 127, 128, 129, 5000):
        first = r.random(n) < 0.03
        first[0] = True
        model = t.Model(np.zeros(1), 0.0, r.normal(size=(2, 2)), r.normal(size=2), np.zeros(3))
        e = r.normal(scale=4, size=n)
        assert np.allclose(t.marginals(e, first, model), brute_marginals(e, first, model), atol=1e-9)


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(2)
    words = [f"w{k}" for k in range(200)]
    clean = [" ".join(r.choice(words, 30)) for _ in range(200)]
    return t.fit([*clean, *[f"{a[:40]} zounds vile scum {a[40:]}" for a in clean[:80]]], [False] * 200 + [True] * 80)


def test_spans_point_at_what_offends(spark, model):
    text = "w1 w2 ü w3 Zounds VILE scum, w4 w5"
    row = t.tag(awkward(spark, [(1, text)]), model).first()
    assert row.score > 0.5
    assert [text[s.start : s.end] for s in row.spans] == ["Zounds VILE scum"]


def test_awkward_rows_score_alike_in_any_company(spark, model):
    docs = awkward(spark, [*TEXTS, (99, "w9 scum vile w8")])
    together = {(r.doc_id, r.score) for r in t.tag(docs.coalesce(1), model).collect()}
    apart = {(r.doc_id, r.score) for r in t.tag(docs.repartition(16), model).collect()}
    assert together == apart
    assert all(0 <= s <= 1 for _, s in together)
    blank = {round(s, 12) for k, s in together if k in (4, 5, 6, 8)}
    assert len(blank) == 1 and blank.pop() < 0.5
    left = t.drop_toxic(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, _ in TEXTS}
    assert t.tag(empty(spark), model).count() == 0 and t.drop_toxic(empty(spark), model).count() == 0


def brute_score(text, model):
    """One text's score from its words, one after another; weights of a word are looked up by itself."""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def weight(word):
        data = np.frombuffer(word.encode(), np.uint8)
        start, end, _, whole = t.words(data, np.array([0, len(data)]))
        return float(model.weights[t.features(data, start, end, whole)].sum()) + model.bias

    e = np.array([weight(w) for w in words])
    p = brute_marginals(e, np.arange(len(e)) == 0, model) if len(e) else np.zeros(0)
    top = min(max([1e-6, *p]), 1 - 1e-6)
    x = model.document @ np.array([1.0, np.log(top / (1 - top)), np.log1p(p.sum())])
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def test_the_query_against_one_word_after_another(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, rows = t.train(docs, labels), docs.collect()
    got = {r.doc_id: r for r in t.query(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        score = brute_score(r.text, model)
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-6)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)


def log_likelihood(e, y, model):
    """Of the labels of one text, by the forward algorithm."""
    step, w = np.exp(model.step), np.stack([np.ones(len(e)), np.exp(e)], axis=1)
    ahead = np.exp(model.start) * w[0]
    path = np.log(ahead[int(y[0])])
    for k in range(1, len(e)):
        path += np.log(step[int(y[k - 1]), int(y[k])] * w[k, int(y[k])])
        ahead = ahead @ step * w[k]
    return path - np.log(ahead.sum())


def test_the_fit_climbs_to_where_no_step_helps():
    r = np.random.default_rng(4)
    n, kinds = 40, 12
    bins = np.stack([r.integers(0, kinds, 1200)] * 1, axis=1).astype(np.int32)
    y = (bins[:, 0] < 3) & (r.random(1200) < 0.9)
    first = np.arange(1200) % n == 0
    model = t.fit_chain(bins, first, y, np.arange(kinds), epochs=300, rate=0.05)
    texts = [(bins[k : k + n], y[k : k + n]) for k in range(0, 1200, n)]
    total = lambda m: sum(log_likelihood(t.emissions(b, m), own, m) for b, own in texts)
    best = total(model)
    assert best > total(t.Model(np.zeros_like(model.weights), -2.0, np.zeros((2, 2)), np.zeros(2), np.zeros(3))) + 100
    for k in [*range(kinds), "bias"]:
        for by in (-0.5, 0.5):
            weights = model.weights.copy()
            if k != "bias":
                weights[k] += by
            moved = t.Model(weights, model.bias + (by if k == "bias" else 0), model.step, model.start, model.document)
            assert total(moved) < best + 0.5


def test_labels_of_one_kind_or_none(spark):
    for flags in ([], [True], [False, False]):
        m = t.fit(["some text"] * len(flags), flags)
        share = (sum(flags) + 0.5) / (len(flags) + 1)
        assert t.tag(awkward(spark, [(1, "other text")]), m).first().score == pytest.approx(share)
    labels = spark.createDataFrame([(None, 1, 1), (1, 1, None)], LABELS)
    assert t.train(awkward(spark), labels).document[1] == 0


def test_a_text_that_does_not_fit_is_passed_over(spark):
    rows = [(k, ("vile scum " if k % 2 else "fine day ") * 5) for k in range(40)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k, _ in rows], LABELS)
    expected = t.train(awkward(spark, rows), labels, most_bytes=4000)
    assert expected.document[1] != 0
    fitted = [r.doc_id for r in labels.where(~t.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit(17))).collect()]
    long = [(k, text + "w " * 4000 if k == fitted[0] else text) for k, text in rows]
    got = t.train(awkward(spark, long), labels, most_bytes=4000)
    assert got.document[1] != 0
    assert t._fill([(1, True, 99), (2, True, 30), (3, True, 30), (4, False, 30), (5, False, 10)], 100) == [2, 4, 5, 3]
    assert t._fill([(1, True, 300), (2, True, 200), (3, False, 30)], 100) == [3, 2]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = t.query(spark, sf).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    known = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    yes, no = [s for y, s, _ in known if y], [s for y, s, _ in known if not y]
    auc = np.mean([(a > np.array(no)).mean() + (a == np.array(no)).mean() / 2 for a in yes])
    right = np.mean([y == p for y, _, p in known])
    print(len(yes), len(no), auc, right)
    assert auc > 0.95 and right > 0.93
