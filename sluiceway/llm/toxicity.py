"""Toxic spans by a linear-chain conditional random field.

Labels mark documents, so tokens are labelled first: in a toxic document those whose word or
beginning tells toxic documents from others (a likelihood-ratio test over the labelled sample),
as far as they come near the strongest of that document.  A chain of two labels is fitted to
these tokens with hashed features (the word and its first 3, 4, 5 and 6 bytes).  Forward-backward
gives every token of a whole text its marginal; runs of tokens over one half are the offending
spans, and the marginals of a document, the largest and the sum, give its score by a logistic
regression on the same sample.

The chain is run for a batch at once: products of its matrices associate, so stretches of
tokens are multiplied side by side, composed, and run again from the right start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, map_arrow, mix, raw, read_table, span_hash, words

#: The labelled sample: at most so many documents of either label, and bytes of both.
TRAIN_DOCS, TRAIN_BYTES = 3000, 8 << 20
BITS = 22
#: Features of fewer sampled documents than this get no weight.
LEAST_DOCS = 3
PREFIXES = (3, 4, 5, 6)
LANE, SEGMENT = 128, 64


@dataclass
class Model:
    weights: np.ndarray  # of features: log odds of label 1
    bias: float
    step: np.ndarray  # log weights of transitions, [from, to]
    start: np.ndarray
    document: np.ndarray  # of 1, logit of the largest marginal, log1p of their sum


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bins of each word: itself and its beginnings."""
    folded = FOLD[data]
    columns = [whole] + [mix(span_hash(folded, start, np.minimum(end, start + k)) + np.uint64(k)) for k in PREFIXES]
    return (np.stack(columns, axis=1) >> np.uint64(64 - BITS)).astype(np.int32)


def _g2(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio of a of n1 against b of n0, nought where the share is not the larger on the left."""
    def term(k: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0.0)

    share = (a + b) / (n1 + n0)
    g = 2 * (term(a, n1 * share) + term(n1 - a, n1 * (1 - share)) + term(b, n0 * share) + term(n0 - b, n0 * (1 - share)))
    return np.where(a / max(n1, 1) > b / max(n0, 1), g, 0.0)


def token_labels(bins: np.ndarray, doc: np.ndarray, toxic: np.ndarray, least: float = 8.0, sure: float = 25.0, share: float = 0.9) -> np.ndarray:
    """Which tokens of toxic documents mark them: those with a feature that is met with `share`
    in toxic documents (were either kind as frequent) and whose test value is `sure` or more;
    where a document has none, those of `least` or more and half that of its strongest token."""
    n_docs = len(toxic)
    best = np.zeros(len(doc))
    for k in range(bins.shape[1]):
        own, place = np.unique(bins[:, k], return_inverse=True)  # of the bins that are met, not of all there are
        pairs = np.unique(doc.astype(np.int64) << BITS | place.ravel())
        d, f = pairs >> BITS, pairs & ((1 << BITS) - 1)
        a = np.bincount(f[toxic[d]], minlength=len(own)).astype(float)
        b = np.bincount(f[~toxic[d]], minlength=len(own)).astype(float)
        n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
        clear = a / n1 >= share * (a / n1 + b / n0)
        np.maximum(best, np.where(clear, _g2(a, b, n1, n0), 0.0)[place.ravel()], out=best)
    top = np.zeros(n_docs)
    np.maximum.at(top, doc, best)
    return toxic[doc] & (best >= least) & (best >= np.minimum(sure, top[doc] / 2))


def _potentials(e: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(np.clip(e, -30, 30)), np.exp(model.step)


def _chain(m: list[np.ndarray]) -> np.ndarray:
    """Share of the second entry of row vector (1/2, 1/2) times the first 1, 2, ... matrices."""
    n = len(m[0])
    lanes = -(-n // LANE)
    cols = []
    for x, fill in zip(m, (1.0, 0.0, 0.0, 1.0), strict=True):
        padded = np.full(lanes * LANE, fill)
        padded[:n] = x
        cols.append(np.ascontiguousarray(padded.reshape(lanes, LANE).T))
    a, b, c, d = (np.full(lanes, x) for x in (1.0, 0.0, 0.0, 1.0))
    for t in range(LANE):
        p, q, r, s = (x[t] for x in cols)
        a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        z = 1 / (a + b + c + d)
        a, b, c, d = a * z, b * z, c * z, d * z
    width = 1
    while width < lanes:  # products of all lanes up to each
        pa_, pb, pc, pd = a[:-width], b[:-width], c[:-width], d[:-width]
        p, q, r, s = a[width:], b[width:], c[width:], d[width:]
        w = [pa_ * p + pb * r, pa_ * q + pb * s, pc * p + pd * r, pc * q + pd * s]
        z = 1 / (w[0] + w[1] + w[2] + w[3])
        a, b, c, d = (np.concatenate([old[:width], new * z]) for old, new in zip((a, b, c, d), w, strict=True))
        width *= 2
    u = np.concatenate([[0.5], ((a + c) / (a + b + c + d))[:-1]])
    v = 1 - u
    out = np.empty((LANE, lanes))
    for t in range(LANE):
        p, q, r, s = (x[t] for x in cols)
        u, v = u * p + v * r, u * q + v * s
        z = 1 / (u + v)
        u, v = u * z, v * z
        out[t] = v
    return np.ascontiguousarray(out.T).ravel()[:n]


def marginals(e: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """P(label 1) of each token; first: whether a token begins a document."""
    if not len(e):
        return np.empty(0)
    w, t = _potentials(e, model)
    s = np.exp(model.start)
    m = [np.where(first, s[0], t[0, 0]), np.where(first, s[1], t[0, 1]) * w, np.where(first, s[0], t[1, 0]), np.where(first, s[1], t[1, 1]) * w]
    ahead = _chain(m)
    # backwards: from the token after, unless that begins another document
    last = np.append(first[1:], True)
    nxt = [np.append(x[1:], 1.0) for x in m]
    back = [np.where(last, 1.0, x)[::-1] for x in (nxt[0], nxt[2], nxt[1], nxt[3])]
    behind = _chain(back)[::-1]
    one, zero = ahead * behind, (1 - ahead) * (1 - behind)
    return one / (one + zero)


def known_bins(bins: np.ndarray, doc: np.ndarray, least: int = LEAST_DOCS) -> np.ndarray:
    """Bins that occur in enough documents."""
    count = np.zeros(1 << BITS, np.int32)
    for k in range(bins.shape[1]):
        seen = np.unique(doc.astype(np.int64) << BITS | bins[:, k]) & ((1 << BITS) - 1)
        count += np.bincount(seen, minlength=1 << BITS).astype(np.int32)
    return np.flatnonzero(count >= least)


def fit_chain(bins: np.ndarray, first: np.ndarray, y: np.ndarray, known: np.ndarray, epochs: int = 6, rate: float = 0.15, decay: float = 1e-5, seed: int = 5) -> Model:
    """Maximum likelihood by Adam over stretches of at most SEGMENT tokens."""
    size = 1 << BITS
    place = np.full(size, len(known), np.int32)
    place[known] = np.arange(len(known))
    local = place[bins]
    n, k = len(y), len(known) + 1  # the last feature stands for all that are not known, at nought
    theta = np.zeros(k + 7)  # features, bias, transitions, start
    theta[k] = -2.0
    position = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    heads = np.flatnonzero(position % SEGMENT == 0)
    lengths = np.diff(np.append(heads, n))
    begins = first[heads]
    good, square, step = np.zeros_like(theta), np.zeros_like(theta), 0
    order = np.random.default_rng(seed)
    for _ in range(epochs if n else 0):
        mixed = order.permutation(len(heads))
        for chosen in np.array_split(mixed, max(1, len(mixed) // 1500)):
            b, size_ = len(chosen), lengths[chosen]
            at = np.minimum(heads[chosen][:, None] + np.arange(SEGMENT), n - 1)
            real = np.arange(SEGMENT) < size_[:, None]
            f = local[at]
            label = y[at].astype(int)
            e = np.where(real, np.clip(theta[f].sum(axis=2) + theta[k], -30, 30), 0)
            w, t, s = np.exp(e), np.exp(theta[k + 1 : k + 5].reshape(2, 2)), np.exp(theta[k + 5 : k + 7])
            ahead = np.empty((SEGMENT, b, 2))
            v = np.stack([np.where(begins[chosen], s[0], 1.0), np.where(begins[chosen], s[1], 1.0) * w[:, 0]], axis=1)
            ahead[0] = v / v.sum(1, keepdims=True)
            for j in range(1, SEGMENT):
                v = ahead[j - 1] @ t
                v[:, 1] *= w[:, j]
                ahead[j] = np.where(real[:, j, None], v / v.sum(1, keepdims=True), ahead[j - 1])
            behind = np.ones((SEGMENT, b, 2))
            pair = np.zeros((2, 2))
            for j in range(SEGMENT - 2, -1, -1):
                nxt = behind[j + 1] * np.stack([np.ones(b), w[:, j + 1]], axis=1)
                joint = ahead[j][:, :, None] * t * nxt[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                pair += joint[real[:, j + 1]].sum(0)
                v = nxt @ t.T
                behind[j] = np.where(real[:, j + 1, None], v / v.sum(1, keepdims=True), behind[j + 1])
            p = ahead * behind
            p = (p[:, :, 1] / p.sum(2)).T
            grad = np.zeros_like(theta)
            error = np.where(real, label - p, 0.0)
            grad[:k] = np.bincount(f[real].ravel(), np.repeat(error[real], f.shape[2]), k)
            grad[k - 1] = 0
            grad[k] = error.sum()
            seen = np.zeros((2, 2))
            both = real[:, 1:]
            np.add.at(seen, (label[:, :-1][both], label[:, 1:][both]), 1)
            grad[k + 1 : k + 5] = (seen - pair).ravel()
            own = begins[chosen]
            grad[k + 5] = ((1 - label[own, 0]) - (1 - p[own, 0])).sum()
            grad[k + 6] = (label[own, 0] - p[own, 0]).sum()
            grad = grad / b - decay * theta
            step += 1
            good = 0.9 * good + 0.1 * grad
            square = 0.99 * square + 0.01 * grad * grad
            theta += rate * (good / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(size, np.float32)
    weights[known] = theta[: k - 1]
    return Model(weights, float(theta[k]), theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 : k + 7], np.zeros(3))


def _document_columns(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    top, total = np.zeros(n), np.zeros(n)
    np.maximum.at(top, doc, p)
    np.add.at(total, doc, p)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(total)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = _sigmoid(x @ w)
        w += np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w), -3, 3)
    return w


def fit(texts: list[str], toxic: list[bool]) -> Model:
    """The model of a labelled sample.  Without both labels every score is the smoothed share of label 1."""
    flags = np.array(toxic, bool)
    data, offsets = raw(pa.array(texts, pa.string()))
    start, end, doc, whole = words(data, offsets)
    bins = features(data, start, end, whole) if len(start) else np.empty((0, 1 + len(PREFIXES)), np.int32)
    if not flags.any() or flags.all():
        share = (flags.sum() + 0.5) / (len(flags) + 1)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, np.zeros((2, 2)), np.zeros(2), np.array([np.log(share / (1 - share)), 0, 0]))
    first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.empty(0, bool)
    model = fit_chain(bins, first, token_labels(bins, doc, flags), known_bins(bins, doc))
    model.document = _logistic(_document_columns(marginals(emissions(bins, model), first, model), doc, len(texts)), flags.astype(float))
    return model


def emissions(bins: np.ndarray, model: Model) -> np.ndarray:
    return model.weights[bins].sum(axis=1, dtype=np.float64) + model.bias


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fill(rows: list[tuple], most_bytes: int) -> list:
    """Ids of rows (id, label, bytes), in their order, that most_bytes hold; see train."""
    total, left, taken = {True: 0, False: 0}, [], []
    for row in rows:
        if total[row[1]] + row[2] <= most_bytes // 2:
            total[row[1]] += row[2]
            taken.append(row)
        else:
            left.append(row)
    room = most_bytes - sum(total.values())
    for row in left:
        if row[2] <= room:
            room -= row[2]
            taken.append(row)
    for label in {row[1] for row in rows} - {row[1] for row in taken}:
        taken.append(min((row for row in rows if row[1] == label), key=lambda row: row[2]))
    return [row[0] for row in taken]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit to a sample of labelled rows that are not held out: at most most_docs of either label
    in the order of a hash of the id, and of those as many whole texts as most_bytes hold: half of
    it for either label, and what one label leaves for the other.  A text that does not fit is
    passed over; of a label of which none fits, the shortest is taken."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg((F.max(F.col(label_col)) > 0).alias("_y"))
    order = F.xxhash64("_id", F.lit(17))
    sample = known.where("_y").orderBy(order).limit(most_docs).unionAll(known.where("not _y").orderBy(order).limit(most_docs))
    chosen = docs.select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("_t")).where("_t is not null").join(F.broadcast(sample), F.col("_d") == F.col("_id"))
    sizes = chosen.groupBy("_id", "_y").agg(F.sum(F.octet_length("_t")).alias("n")).select("_id", "_y", "n", order.alias("h")).collect()
    ids = [(k,) for k in _fill([(r._id, r._y, r.n) for r in sorted(sizes, key=lambda r: r.h)], most_bytes)]
    if not ids:
        return fit([], [])
    kept = docs.sparkSession.createDataFrame(ids, f"_k {docs.schema[id_col].dataType.simpleString()}").distinct()
    rows = sorted(chosen.join(F.broadcast(kept), F.col("_id") == F.col("_k")).select("_id", "_t", "_y").collect(), key=lambda r: (r._id, r._t))
    return fit([r._t for r in rows], [r._y for r in rows])


def _scores(p: np.ndarray, doc: np.ndarray, n: int, model: Model) -> np.ndarray:
    return np.round(_sigmoid(_document_columns(p, doc, n) @ model.document), 9)


def score_slice(column: pa.Array, model: Model):
    """Scores of texts, and the tokens over one half: document, start and end in bytes.
    Scores are rounded, so that they do not depend on what else is in the slice."""
    data, offsets = raw(column)
    start, end, doc, whole = words(data, offsets)
    if not len(start):
        return _scores(np.empty(0), np.empty(0, int), len(column), model), data, offsets, np.empty(0, int), start, end
    first = np.append(True, doc[1:] != doc[:-1])
    p = marginals(emissions(features(data, start, end, whole), model), first, model)
    hit = np.flatnonzero(p >= 0.5)
    return _scores(p, doc, len(column), model), data, offsets, hit, start, end


def tag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, score, spans (first and last but one character of each run
    of neighbouring tokens whose marginal is one half or more).

    Texts are scored whole.  Null and empty texts, and those without words, have no spans and the
    score of a document without any toxic token.  Rows that repeat, or share an id, have a row each;
    an empty table gives no rows.  Only the two columns are read."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores, data, offsets, hit, start, end = score_slice(batch.column(1), kept.value)
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        if len(hit):
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            owner = np.searchsorted(offsets, start[hit], "right") - 1
            before = -2
            for k, d, a, b in zip(hit.tolist(), owner.tolist(), start[hit].tolist(), end[hit].tolist(), strict=True):
                base = int(chars[offsets[d]])
                if k == before + 1 and spans[d]:
                    spans[d][-1]["end"] = int(chars[b]) - base
                else:
                    spans[d].append({"start": int(chars[a]) - base, "end": int(chars[b]) - base})
                before = k
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, score double, spans array<struct<start:int,end:int>>", 1).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without those that score `threshold` or more; no row is shuffled.  Null and empty texts
    have the score of a text without any toxic token; rows that repeat stay or go alike; an empty
    table stays empty.  Columns are as they were, whatever their names."""
    kept, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores, *_ = score_slice(batch.column(at), kept.value)
        yield batch.filter(pa.array(scores < threshold))

    return map_arrow(docs, run, docs.schema, at)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return tag(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
