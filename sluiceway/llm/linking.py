"""From bands to classes: candidate buckets, exact verification, connected components.

Nodes are distinct texts, named by a digest.  In each bucket of a band one node leads and the
others are compared with it, exactly.  Then the leader is done there, and so is every node that
the triangle inequality of the Jaccard distance (weighted or not, it is a metric) lets nobody
link to who is not in its class already; the rest go on with the next leader.  What is left
after ROUNDS of these, buckets of many texts that are not alike, is parted further: two sets
that are alike share one of the rarest elements of either, so nodes are dealt by those, and only
they are compared, block by block inside tasks, which return links only.  No pair that a bucket
holds is left out.

A bucket may hold a third of all nodes.  What there is once for a band is broadcast up to
MOST_BUCKETS rows, counted first; beyond that the members of a hot band, one of more than HOT of
them, are spread over SALTS tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcastable, hashed, materialise, scratch, slices

ROUNDS = 2
#: Nodes in a block of the last comparison.
BLOCK = 128
MOST_BUCKETS = 50_000
#: Members of a band beyond which it is hot, and tasks that those of a hot one are spread over.
HOT, SALTS = 256, 16
#: Edges whose components one task finds.
MOST_EDGES = 500_000


def pack(shingles: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted 64-bit shingles, and their weights unless all are one."""
    return shingles.astype("<u8").tobytes(), b"" if (weights == 1).all() else weights.astype("<u4").tobytes()


def distance(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
    """1 - weighted Jaccard similarity of two packed sets; two empty ones are alike."""
    x, y = np.frombuffer(a[0], "<u8"), np.frombuffer(b[0], "<u8")
    if not len(x) or not len(y):
        return float(len(x) != len(y))
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = y[at] == x
    if not a[1] and not b[1]:
        both = int(common.sum())
        return 1 - both / (len(x) + len(y) - both)
    u = np.frombuffer(a[1], "<u4").astype(np.int64) if a[1] else np.ones(len(x), np.int64)
    v = np.frombuffer(b[1], "<u4").astype(np.int64) if b[1] else np.ones(len(y), np.int64)
    both = int(np.minimum(u[common], v[at[common]]).sum())
    return 1 - both / int(u.sum() + v.sum() - both)


def with_band(members: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """members joined with `side`, a written table of one row a band (its key named _b), so that no
    task gets all of a hot band.  `hot` of a member and `_hot` of its band say the same."""
    if broadcastable(side, MOST_BUCKETS):
        return members.join(F.broadcast(side), F.col("band") == F.col("_b"), how).drop("_b", "_hot")
    all_, one = F.sequence(F.lit(0), F.lit(SALTS - 1)), F.array(F.lit(0))
    spread = side.withColumn("_t", F.explode(F.when(F.col("_hot"), all_).otherwise(one)))
    salted = members.withColumn("_s", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0))
    return salted.join(hashed(spread), (F.col("band") == F.col("_b")) & (F.col("_s") == F.col("_t")), how).drop("_b", "_hot", "_s", "_t")


def _marked(members: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members with `hot`, as `_hot` of the written table `side` has it, and side: all are hot if
    too many are for a broadcast."""
    hot = side.where("_hot").select(F.col("_b").alias("_h"), F.col("_hot").alias("hot"))
    if not broadcastable(hot, MOST_BUCKETS):
        return members.withColumn("hot", F.lit(True)), side.withColumn("_hot", F.lit(True))
    marked = members.join(F.broadcast(hot), F.col("band") == F.col("_h"), "left").drop("_h")
    return marked.withColumn("hot", F.coalesce("hot", F.lit(False))), side


def bucket_members(bands: DataFrame) -> DataFrame:
    """(band, node, hot) of the buckets that more than one node has; `bands` is (band, node), distinct."""
    many = materialise(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("band").alias("_b"), (F.col("n") > HOT).alias("_hot")), "buckets")
    return materialise(with_band(*_marked(bands, many), "left_semi"), "members")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, d) for every pair (a, b): the distance of their sets."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"), F.col("weights").alias("v"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"), F.col("weights").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [distance((s, v), (t, w)) for s, v, t, w in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64())], ["a", "b", "d"])

    return pairs.join(hashed(one), "a").join(hashed(two), "b").select("a", "b", "s", "v", "t", "w").mapInArrow(run, "a binary, b binary, d double")


def components(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(node, root) of every node of an edge: the least node that it is connected with.

    Up to most_edges edges, counted first, go through one task; more of them through large-star
    and small-star steps in turn, each of which writes its edges.  Both give the same rows."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if broadcastable(now, most_edges):
        return materialise(now.coalesce(1).mapInArrow(_united, "node binary, root binary"), "roots")
    mark = _mark(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = materialise(both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(down.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of one task's edges, by union-find."""
    ends: list[list[bytes]] = [[], []]
    for batch in batches:
        for k in range(2):
            ends[k] += batch.column(k).to_pylist()
    names = sorted({*ends[0], *ends[1]})
    place = {x: k for k, x in enumerate(names)}
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(*ends, strict=True):
        x, y = find(place[a]), find(place[b])
        parent[max(x, y)] = min(x, y)
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([names[find(k)] for k in range(len(names))], pa.binary())], ["node", "root"])


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("node"))
    side = roots.select(F.col("node").alias("_n"), "root")
    side = F.broadcast(side) if broadcastable(side, MOST_BUCKETS) else hashed(side)
    return members.join(side, F.col("node") == F.col("_n"), "left").select(*members.columns, F.coalesce("root", "node").alias("root"))


def _mixed(members: DataFrame) -> DataFrame:
    """Members (band, node, root, hot) of buckets that hold more than one class."""
    root = F.xxhash64("root")  # a number, which aggregates without sorting
    several = materialise(members.groupBy("band").agg((F.min(root) != F.max(root)).alias("_mixed"), F.max("hot").alias("_hot")).where("_mixed").select(F.col("band").alias("_b"), "_hot"), "mixed")
    return materialise(with_band(members, several, "left_semi"), "rooted")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The classes with more links; what was known stands for the links that made it."""
    if not links.limit(1).count():
        return roots
    return components(links if roots is None else links.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def link(members: DataFrame, sets: DataFrame, most: float, rounds: int = ROUNDS) -> DataFrame | None:
    """Roots (node, root) of the classes of nodes that are joined by links of distance `most` or
    less within buckets; None if there is no link.

    `members` is (band, node) and maybe hot, `sets` (node, shingles, weights); both must be written tables.
    Nodes without a set have no links.  Without members, or if each bucket has one node, there is none."""
    spark, roots = members.sparkSession, None
    left = members if "hot" in members.columns else members.withColumn("hot", F.lit(True))
    with scratch(spark):
        for _ in range(rounds):
            # while there are no classes, every bucket of several nodes is mixed; one alone is its own leader
            now = _rooted(left, None) if roots is None else _mixed(_rooted(left, roots))
            if not now.limit(1).count():
                break
            with scratch(spark):
                roots, left = _round(now, roots, sets, most)
        now = _mixed(_rooted(left, roots))
        if now.limit(1).count():
            with scratch(spark):
                rare = materialise(_rare(now, sets, most), "rare", keep=True)
            roots = _merged(roots, materialise(_blocks(rare, now, sets, most), "links"))
        return None if roots is None else materialise(roots, "roots", keep=True)


def _round(now: DataFrame, roots: DataFrame | None, sets: DataFrame, most: float) -> tuple[DataFrame | None, DataFrame]:
    """One leader for every bucket: the classes after it, and the members that are not done."""
    lead = now.groupBy("band").agg(F.min(F.struct("node", "root")).alias("lead"), F.max("hot").alias("_hot")).select(F.col("band").alias("_b"), "_hot", F.col("lead.node").alias("leader"), F.col("lead.root").alias("leader_root"))
    led = materialise(with_band(now, materialise(lead, "leaders")).where("node <> leader"), "led")
    # those of the leader's class too: a class grows by chains, so only the true distance says who may be done
    found = materialise(verify(led.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), sets), "verified")
    roots = _merged(roots, found.where(F.col("d") <= most + 1e-12).select("a", "b"))
    judged = led.join(hashed(found.select("a", "b", F.col("d").alias("dist"))), (F.col("node") == F.col("a")) & (F.col("leader") == F.col("b")))
    judged = materialise(judged.select("band", "node", "hot", "dist", (F.col("root") != F.col("leader_root")).alias("stranger")), "judged")
    far = judged.where(F.col("stranger") & (F.col("dist") > most + 1e-12)).groupBy("band").agg(F.min("dist").alias("nearest"), F.max("hot").alias("_hot")).withColumnRenamed("band", "_b")
    left = with_band(judged, materialise(far, "far")).where(F.col("dist") >= F.col("nearest") - most - 1e-9).select("band", "node", "hot")
    return None if roots is None else materialise(roots, "roots", keep=True), materialise(left, "left", keep=True)


def _rare(members: DataFrame, sets: DataFrame, most: float) -> DataFrame:
    """(band, node, root, hot) for every element of a node's set that another like it must share one of:
    the band here is the element.

    Elements stand in the order of how many of these nodes have them, rare ones first.  Let e be
    the first that two sets share: all that they have in common stands at e or after it, so what a
    set weighs from e on is the share 1 - most of its whole weight or more.  Of those who meet at e
    one goes if the lightest of them is too heavy for it: both weights from e on must reach
    (1 - most) / (2 - most) of the sum of both whole weights."""
    t = 1 - most - 1e-9
    nodes = materialise(members.select("node", "root").distinct(), "nodes")
    own = nodes.select(F.col("node").alias("_n"), "root")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                nodes, s, w = (c.to_pylist() for c in part.columns)
                n = [len(x) // 8 for x in s]
                weights = [np.frombuffer(x, "<u4").astype(np.int64) if x else np.ones(k, np.int64) for x, k in zip(w, n, strict=True)]
                own = part.column(0).take(pa.array(np.repeat(np.arange(len(nodes)), n)))
                total = np.repeat(np.array([x.sum() for x in weights], np.int64), n)
                yield pa.RecordBatch.from_arrays([own, pa.array(np.frombuffer(b"".join(s), "<i8")), pa.array(np.concatenate([np.empty(0, np.int64), *weights])), pa.array(total)], ["node", "e", "w", "total"])

    elements = materialise(sets.join(hashed(own.select("_n")), F.col("node") == F.col("_n"), "left_semi").select("node", "shingles", "weights").mapInArrow(parts, "node binary, e long, w long, total long"), "elements")
    shared = materialise(elements.groupBy("e").count().where("count > 1").select(F.col("e").alias("_e"), F.col("count").alias("n")), "shared")
    side = F.broadcast(shared) if broadcastable(shared, MOST_BUCKETS) else hashed(shared)
    # an element of one node alone joins nobody, but it has its weight before all others
    known = elements.join(side, F.col("e") == F.col("_e")).select("node", "w", "total", F.struct("n", "e", "w").alias("x"))
    known = known.groupBy("node").agg(F.sort_array(F.collect_list("x")).alias("list"), F.sum("w").alias("all"), F.max("total").alias("total"))
    # nobody meets a set in which too little is shared at all
    known = known.where(F.col("all") >= F.col("total") * t)
    known = known.select("node", "total", F.col("list.e").alias("e"), F.col("list.w").alias("w"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, w = batch.column(2), batch.column(3)
            edges = np.asarray(e.offsets)
            values, weight = np.asarray(e.values), np.asarray(w.values)
            own, keep, rests = [], [], []
            for k, (a, b, all_) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), batch.column(1).to_pylist(), strict=True)):
                rest = np.cumsum(weight[a:b][::-1])[::-1]
                n = int(np.count_nonzero(rest >= t * all_))
                own.append(np.full(n, k))
                keep.append(np.arange(a, a + n))
                rests.append(rest[:n])
            own, keep, rests = (np.concatenate([np.empty(0, np.int64), *x]) for x in (own, keep, rests))
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(values[keep]), batch.column(0).take(take), batch.column(1).take(take), pa.array(rests)], ["band", "node", "total", "rest"])

    first = materialise(known.mapInArrow(prefixes, "band long, node binary, total long, rest long"), "prefixes")
    lightest = materialise(first.groupBy("band").agg(F.min("total").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("band").alias("_b"), "least", (F.col("k") > HOT).alias("_hot")), "lightest")
    met = with_band(*_marked(first, lightest)).where(F.col("rest") * (1 + t) >= (F.col("total") + F.col("least")) * t - 1e-6).select("band", "node", "hot")
    return _mixed(met.join(hashed(own), F.col("node") == F.col("_n")).select("band", "node", "root", "hot"))


def _blocks(members: DataFrame, of: DataFrame, sets: DataFrame, most: float) -> DataFrame:
    """Links between nodes of different classes that meet in `members` (band, node, root, hot) and share
    a band of `of`, found block against block.

    The largest class of a bucket has blocks of its own, which meet only those of the others, so
    that a few strangers to a large class cost no more than one look at it each.  A pair that meets
    in several buckets is compared in the first alone, and not at all once both are known to be in
    one class."""
    counts = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("count"), F.max("hot").alias("_hot"))
    counts = counts.groupBy("band").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("n"), F.max("_hot").alias("_hot"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sized = materialise(counts.select(F.col("band").alias("_b"), "_hot", F.col("top.root").alias("top"), blocks(F.col("n") - F.col("top.count")).alias("few"), blocks(F.col("top.count")).alias("many")), "sized")
    lists = lambda df, name: df.groupBy(F.col("node").alias(f"_{name}")).agg(F.collect_list("band").alias(name))  # noqa: E731  no more than a set has elements, or bands
    held = sets.join(lists(members, "met"), F.col("node") == F.col("_met")).join(lists(of, "bands"), F.col("node") == F.col("_bands"))
    held = materialise(held.select("node", "shingles", "weights", "met", "bands"), "held")
    h, at_top = F.xxhash64("node"), F.col("root") == F.col("top")
    dealt = with_band(members, sized).withColumn("block", F.when(at_top, F.col("few") + F.pmod(h, "many")).otherwise(F.pmod(h, "few")).cast("int"))
    # blocks of the others meet every block, those of the largest class only the others': a row for each meeting
    meets = F.when(at_top, F.col("few")).otherwise(F.col("few") + F.col("many"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1))).select("band", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    full = pairs.join(hashed(held), "node").select("band", "i", "j", "block", "node", "root", "shingles", "weights", "met", "bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, parent, a, b = None, [], {}, [], []

        def find(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for batch in batches:
            for band, i, j, block, node, root, s, w, met, bands in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, i, j) != key:
                    key, seen, parent = (band, i, j), [], {}
                met, bands, size = set(met), set(bands), int(np.frombuffer(w, "<u4").sum()) if w else len(s) // 8
                for other, its_root, its_block, its_met, its_bands, its_size, its in seen:
                    if (i != j and its_block == block) or min(size, its_size) < (1 - most - 1e-12) * max(size, its_size):
                        continue
                    if find(its_root) != find(root) and min(met & its_met) == band and not bands.isdisjoint(its_bands) and distance(its, (s, w)) <= most + 1e-12:
                        parent[find(root)] = find(its_root)
                        a.append(node)
                        b.append(other)
                seen.append((node, root, block, met, bands, size, (s, w)))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []

    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return full.repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j", "block", "node").mapInArrow(run, "a binary, b binary")
