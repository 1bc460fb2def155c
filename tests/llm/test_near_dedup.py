import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sluiceway.llm import linking, near_dedup

from .awkward import TEXTS, awkward, empty
from .test_decontaminate import words


def shingles(text):
    w = words(text)
    if not w:
        return Counter({("", (text or "").strip(" \t\n\x0b\x0c\r")): 1})
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    root = roots(range(len(rows)), edges)
    own = defaultdict(list)
    for k, r in root.items():
        own[r].append(rows[k][0])
    first = lambda keys: min(keys, key=lambda k: (k is not None, k or 0))
    return sorted(((rows[k][0], first(own[r]), len(own[r]), first(own[r]) == rows[k][0]) for k, r in root.items()), key=str)


def copies(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    out = []
    for base in range(n):
        text = [r.choice(vocabulary) for _ in range(r.choice([8, 40, 200, 900]))]
        for _ in range(r.choice([1, 1, 2, 8])):
            own = list(text)
            for _ in range(r.choice([0, 1, len(own) // 80, len(own) // 40])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            out.append((len(out), " ".join(own) + r.choice(["", ".", " "])))
    r.shuffle(out)
    return out


def test_against_all_pairs(spark):
    rows = copies(6, 60)
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(awkward(spark, rows).repartition(3)).collect()), key=str)
    assert got == brute(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    expected = brute(TEXTS)
    assert sorted((tuple(r) for r in near_dedup.near_duplicates(docs).collect()), key=str) == expected
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((r[0] for r in expected if r[3]), key=str)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    assert near_dedup.drop_near_duplicates(empty(spark)).count() == 0


def test_signatures_agree_as_often_as_sets_are_alike():
    r = np.random.default_rng(8)
    hits, total = 0, 0
    for trial in range(60):
        common, own = r.integers(0, 1 << 63, 60).astype(np.uint64), r.integers(0, 1 << 63, (2, 20)).astype(np.uint64)
        weight = r.integers(1, 9, 60).astype(float)
        e = np.concatenate([common, own[0], common, own[1]])
        w = np.concatenate([weight, np.full(20, 3.0), weight * 2, np.full(20, 3.0)])
        s = near_dedup.signatures(e, w, np.repeat([0, 1], 80), 2)
        hits, total = hits + (s[0] == s[1]).sum(), total + weight.sum() / (2 * weight.sum() + 120)
    assert (s != 0).all()
    assert abs(hits / (60 * near_dedup.K) - total / 60) < 0.02
    alone = near_dedup.signatures(e[80:], w[80:], np.zeros(80, int), 1)
    assert (alone[0] == s[1]).all()


def test_components_both_ways(spark):
    r = random.Random(9)
    names = [bytes([k // 256, k % 256]) for k in range(600)]
    edges = [(names[k], names[k + 1]) for k in range(80)] + [tuple(r.sample(names, 2)) for _ in range(200)] + [(names[5], names[5])]
    df = spark.createDataFrame(edges, "a binary, b binary")
    touched = {x for e in edges if e[0] != e[1] for x in e}
    expected = sorted(roots(touched, edges).items())
    for most in (10_000, 3):
        got = sorted((bytes(x.node), bytes(x.root)) for x in linking.components(df, most).collect())
        assert got == expected
    assert linking.components(df.limit(0)).count() == 0 and linking.components(df.limit(0), -1).count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_no_link_of_a_large_bucket_is_lost(spark, rounds, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 7)
    r = random.Random(10)
    sets = {}
    for k in range(90):
        base = r.sample(range(1000), 30) if k % 30 == 0 else base  # noqa: F821
        own = set(base) | set(r.sample(range(1000), r.randrange(6)))
        sets[bytes([k])] = sorted(own)
    packed = [(n, *linking.pack(np.array(s, np.uint64), np.ones(len(s)))) for n, s in sets.items()]
    members = [(band, n) for n in sets for band in range(3) if r.random() < 0.8]
    shared = lambda a, b: any((k, a) in set(members) and (k, b) in set(members) for k in range(3))
    near = [(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.8 and shared(a, b)]
    found = linking.link(spark.createDataFrame(members, "band long, node binary"), spark.createDataFrame(packed, "node binary, shingles binary, weights binary"), 0.2, rounds)
    got = {bytes(x.node): bytes(x.root) for x in found.collect()}
    assert {n: got.get(n, n) for n in sets} == roots(sets, near)


def test_a_chain_of_edits_keeps_its_links(spark):
    l1 = set(range(100))
    edited = lambda base, gone, new: (base - set(range(*gone))) | set(range(*new))
    x, l2 = edited(l1, (0, 9), (200, 209)), edited(l1, (20, 29), (300, 309))
    y = edited(x, (50, 60), (400, 410))
    sets = {b"a": l1, b"b": l2, b"c": x, b"d": y}
    r = random.Random(12)
    for chain in range(6):  # each node is an edit of an earlier one, all of a chain in one bucket
        own = [set(range(1000 * (chain + 1), 1000 * (chain + 1) + 100))]
        for _ in range(24):
            base = r.choice(own)
            own.append((base - set(r.sample(sorted(base), 10))) | {r.randrange(10**6, 10**9) for _ in range(10)})
        names = r.sample(range(256), 25)
        sets |= {bytes([97 + chain, 0, k]): s for k, s in zip(names, own, strict=True)}
    packed = [(n, *linking.pack(np.array(sorted(s), np.uint64), np.ones(len(s)))) for n, s in sets.items()]
    members = [(n[0] if len(n) > 1 else 0, n) for n in sets]
    near = [(a, b) for i, a in members for j, b in members if i == j and a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    for rounds in (0, 1, 2, 4):
        found = linking.link(spark.createDataFrame(members, "band long, node binary"), spark.createDataFrame(packed, "node binary, shingles binary, weights binary"), 0.2, rounds)
        got = {bytes(q.node): bytes(q.root) for q in found.collect()}
        assert got[b"d"] == b"a"
        assert {n: got.get(n, n) for n in sets} == roots(sets, near)


def test_distance_by_hand():
    p = lambda s, w: linking.pack(np.array(s, np.uint64), np.array(w))
    assert linking.distance(p([1, 2, 3], [1, 1, 1]), p([2, 3, 4], [1, 1, 1])) == 0.5
    assert linking.distance(p([1, 2], [3, 1]), p([1, 9], [1, 2])) == pytest.approx(1 - 1 / 6)
    assert linking.distance(p([], []), p([], [])) == 0 and linking.distance(p([], []), p([1], [1])) == 1


def test_texts_without_words_have_their_own_shingle():
    h, count, doc = near_dedup.shingle_sets(pa.array(["!!", " !! ", "??", None, ""]))
    assert doc.tolist() == [0, 1, 2, 3, 4] and h[0] == h[1] != h[2] and h[3] == h[4]


def test_ids_whose_sets_are_wanted_are_no_table_of_the_driver(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghij") * 3 + str(r.randrange(99)) for _ in range(40)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t + " more") for k, t in enumerate(texts[:30])] + [(None, texts[39] + " last")]
    seen, real = [], near_dedup.F.broadcast
    monkeypatch.setattr(near_dedup.F, "broadcast", lambda df: seen.append(df.columns) or real(df))
    found = {q.doc_id: (q.class_id, q.kept) for q in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: (k, True) for k in range(39)} | {39: (None, False), None: (None, True)} | {100 + k: (k, False) for k in range(30)}
    assert seen and ["_id"] not in seen
    assert linking.MOST_BUCKETS <= 50_000 and near_dedup.MOST_IDS <= 100_000


def test_only_hot_buckets_are_spread(spark, monkeypatch):
    monkeypatch.setattr(linking, "MOST_BUCKETS", 1)
    monkeypatch.setattr(linking, "HOT", 3)
    names = [bytes([k]) for k in range(6)]
    bands = [(0, n) for n in names] + [(1, names[0]), (1, names[1]), (2, names[5])]
    members = linking.bucket_members(spark.createDataFrame(bands, "band long, node binary"))
    assert sorted((m.band, bytes(m.node), m.hot) for m in members.collect()) == [(b, n, b == 0) for b, n in bands[:-1]]
    side = linking.materialise(spark.createDataFrame([(0, True, "x"), (1, False, "y")], "_b long, _hot boolean, what string"), "side")
    joined = linking.with_band(members, side)
    assert sorted((m.band, bytes(m.node), m.what) for m in joined.collect()) == [(b, n, "xy"[b]) for b, n in bands[:-1]]
    sets = [(n, *linking.pack(np.arange(k // 3 * 50, k // 3 * 50 + 20, dtype=np.uint64), np.ones(20))) for k, n in enumerate(names)]
    found = linking.link(members, linking.materialise(spark.createDataFrame(sets, "node binary, shingles binary, weights binary"), "sets"), 0.2)
    assert {bytes(x.node): bytes(x.root) for x in found.collect()} == {n: names[k // 3 * 3] for k, n in enumerate(names)}
