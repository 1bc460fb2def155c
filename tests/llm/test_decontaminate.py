import hashlib
import random
import re

import pytest

from sluiceway.llm import decontaminate as d

from .awkward import LONG, TEXTS, awkward, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = []
    spans = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            spans.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(s) for s in spans}
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (own := spans.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string")


ITEMS = [(1, "Lazy dog, again"), (2, "brown fox jumps over the lazy dog again and again until night"), (3, None), (4, ""), (5, "!!"), (6, "one"), (7, "ünïcödé ﬁNE"), (8, "one"), (8, "one"), (None, "control"), (10, "word3 et3 word4 et4"), (11, LONG[-300:])]


@pytest.mark.parametrize("most", [200_000, 20])
def test_awkward_rows(spark, most):
    found = d.digests(d.search(awkward(spark), items(spark, ITEMS), max_windows=most))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(TEXTS, ITEMS)
    left = d.drop_contaminated(awkward(spark), items(spark, ITEMS), max_windows=most)
    assert left.columns == awkward(spark).columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((r[0] for r in brute(TEXTS, ITEMS) if not r[5]), key=str)


def test_random_texts_of_few_words(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(["a", "b", "cc", "Ddd", "eeee", "fffff"]) + r.choice(["", ",", "-"]) for _ in range(n))
    rows = [(k, text(r.randrange(200))) for k in range(60)]
    own = [(k, text(r.choice([1, 2, 3, 5, 9, 10, 11, 14]))) for k in range(12)] + [(50 + k, " ".join(rows[k][1].split()[3:16])) for k in range(20)]
    found = d.digests(d.search(awkward(spark, rows), items(spark, own)))
    assert sorted((tuple(x) for x in found.collect()), key=str) == brute(rows, own)


def test_nothing_on_either_side(spark):
    none = items(spark, ITEMS).limit(0)
    assert not d.digests(d.search(awkward(spark), none)).where("contaminated").count()
    assert d.drop_contaminated(awkward(spark), none).count() == len(TEXTS)
    assert d.digests(d.search(empty(spark), items(spark, ITEMS))).count() == 0
