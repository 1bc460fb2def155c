import hashlib
import random
from collections import defaultdict

import pytest

from sluiceway.llm import exact_dedup

from .awkward import TEXTS, awkward, empty


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    for key, text in rows:
        groups[norm(text)].append((-len(text or ""), key is not None, key or 0, key))
    out = []
    for key, text in rows:
        own = groups[norm(text)]
        best = min(own)
        out.append((key, best[3], len(own), (-len(text or ""), key) == (best[0], best[3]), hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("max_bits", [1 << 29, 1 << 5])
def test_awkward_rows(spark, max_bits):
    assert rows_of(exact_dedup.exact_dedup(awkward(spark), max_bits=max_bits)) == brute(TEXTS)


def test_random_rows(spark):
    r = random.Random(3)
    rows = [(k, " " * r.randrange(3) + f"text {r.randrange(150)}" if k % 3 else "a hot text") for k in range(900)]
    assert rows_of(exact_dedup.exact_dedup(awkward(spark, rows).repartition(5))) == brute(rows)


@pytest.mark.parametrize("max_bits", [1 << 29, 1 << 5])
def test_drop_copies_keeps_what_is_kept(spark, max_bits):
    docs = awkward(spark)
    left = exact_dedup.drop_copies(docs, max_bits=max_bits)
    assert left.columns == docs.columns
    expected = {(r[0], r[4]) for r in brute(TEXTS) if r[3]}
    norm = lambda t: hashlib.sha256("".join((t or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None}).encode()).hexdigest()
    got = [(r.doc_id, norm(r.text)) for r in left.collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


def test_filter_is_never_wrongly_negative():
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(500)]
    import numpy as np

    bits = 1 << 12
    seen, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for part in (digests, digests[:50]):
        exact_dedup._or_counts(seen, twice, exact_dedup._positions(part, bits))
    assert exact_dedup._test(digests[:50], twice, bits).all()
