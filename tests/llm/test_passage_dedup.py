import random

import numpy as np
import pytest

from sluiceway.llm import passage_dedup as p

from .awkward import TEXTS, awkward, empty


def planted(seed=11):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, inner, near = text(80), text(60), text(120).split()
    rows, wanted = [], {}
    for k in range(40):
        parts = [text(r.randrange(60, 200)) for _ in range(3)]
        if k % 4 == 0:
            parts.insert(1, line)
            wanted[k] = line
        elif k % 4 == 1:
            parts[1] = f"{text(30)} {inner} {text(25)}"
            wanted[k] = inner
        elif k % 4 == 2:
            own = list(near)
            own[r.randrange(len(own))] = word()
            parts.append(" ".join(own))
            wanted[k] = parts[-1]
        rows.append((k, "\n".join(parts)))
    return rows, wanted


def test_planted_passages(spark):
    rows, wanted = planted()
    docs = awkward(spark, rows).repartition(3)
    found = p.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == wanted.keys()
    texts = dict(rows)
    for key, passage in wanted.items():
        a = texts[key].index(passage)
        own = [(r.start, r.end) for r in found if r.doc_id == key]
        hit = set().union(*(range(max(s, a), min(e, a + len(passage))) for s, e in own))
        assert len(hit) > 0.75 * len(passage)
        assert all(s >= a - 40 and e <= a + len(passage) + 40 for s, e in own)
    assert {0, 1, 2} <= {r.first_id for r in found} <= {0, 1, 2, 6} and all(r.removed == (r.doc_id != r.first_id) for r in found)
    left = p.remove_passages(docs, p.repeated_passages(docs))
    assert left.columns == docs.columns
    out = {r.doc_id: r.text for r in left.collect()}
    for key, text in rows:
        if key not in wanted or key < 3:
            assert out[key] == text
        elif key % 4 == 0:
            assert out[key] == text.replace(wanted[key], "")
        else:
            assert len(out[key]) < len(text) - 0.75 * len(wanted[key])
    assert p.repeated_passages(left).count() == 0


def test_lines_of_awkward_rows(spark):
    docs = awkward(spark)
    found = p.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == {9, 10}
    assert any(r.kind == "line" and r.doc_id == 10 and r.removed for r in found)
    texts = dict(TEXTS)
    left = p.remove_passages(docs, p.repeated_passages(docs)).collect()
    assert len(left) == len(TEXTS) and all(r.text == texts[r.doc_id] or r.doc_id == 10 for r in left if r.doc_id is not None)


@pytest.mark.parametrize("same", [True, False])
def test_within_one_document_nothing_repeats(spark, same):
    line = " ".join(f"x{k}" for k in range(70))
    rows = [(1, f"{line}\n{line}"), (1 if same else 2, line)]
    assert bool(p.repeated_passages(awkward(spark, rows)).count()) != same


def test_empty_table(spark):
    assert p.repeated_passages(empty(spark)).count() == 0


def text(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_the_keeper_has_a_row_though_an_earlier_document_has_a_part(spark):
    r = random.Random(13)
    passage = text(r, 80)
    part = " ".join(passage.split()[30:50])
    keeper, other, chance = (f"{text(r, 30)} {x} {text(r, 30)}" for x in (passage, passage, part))
    found = p.repeated_passages(awkward(spark, [(0, chance), (1, keeper), (2, other)])).collect()
    assert sorted((q.doc_id, q.first_id, q.removed) for q in found if q.kind == "inner") == [(1, 1, False), (2, 1, True)]
    assert all(q.n_words == 80 for q in found if q.kind == "inner")
    assert {(1, 1), (2, 1)} == {(q.doc_id, q.first_id) for q in found}


def brute(rows):
    """Longest runs of words that a document shares with another: (id, other, first word, words)."""
    split = {k: t.split() for k, t in rows}
    out = []
    for a, x in split.items():
        for b, y in split.items():
            if a == b:
                continue
            before = [0] * (len(y) + 1)
            for i, w in enumerate([*x, None]):
                now = [0] * (len(y) + 1)
                for j, v in enumerate(y):
                    if w == v:
                        now[j + 1] = before[j] + 1
                    elif before[j] >= p.PASSAGE_WORDS:
                        out.append((a, b, i - before[j], before[j]))
                if before[len(y)] >= p.PASSAGE_WORDS:
                    out.append((a, b, i - before[len(y)], before[len(y)]))
                before = now
    return out


def mosaic(seed, n):
    """Texts of shared passages of 30 to 90 words, whole or cut, between own words; some line breaks."""
    r = random.Random(seed)
    pool = [text(r, r.randrange(30, 90)).split() for _ in range(8)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts += text(r, r.randrange(0, 25)).split()
            own = r.choice(pool)
            parts += own[r.choice([0, 0, 0, 7]) : len(own) - r.choice([0, 0, 0, 9])]
        rows.append((k, "".join(w + r.choice([" ", " ", " ", " ", "\n"]) for w in parts)))
    return rows


def test_against_all_runs_of_words(spark):
    rows = mosaic(17, 60)
    found = [q for q in p.repeated_passages(awkward(spark, rows).repartition(3)).collect() if q.kind == "inner"]
    texts, runs = dict(rows), brute(rows)
    word_at = lambda t, c: len(t[:c].split())
    spans = [(q.doc_id, word_at(texts[q.doc_id], q.start), q.n_words, q.first_id, q.removed) for q in found]
    words = {k: t.split() for k, t in texts.items()}
    kept = {q.class_id: texts[q.doc_id][q.start : q.end].split() for q in found if not q.removed}
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for q, (key, at, n, first, removed) in zip(found, spans, strict=True):  # what is reported, the keeper has as a whole
        own, theirs = words[key][at : at + n], kept[q.class_id]
        x, y = shingles(own), shingles(theirs)
        assert n >= p.PASSAGE_WORDS and texts[key][q.start : q.end].split() == own and (first < key) == removed
        assert own == theirs or (len(own) > 60 and len(x & y) >= 0.8 * len(x | y))
        assert " ".join(theirs) in " ".join(words[first])
        assert removed or any(z.removed and z.class_id == q.class_id for z in found)
    covered = {}
    for key, at, n, *_ in spans:
        covered.setdefault(key, set()).update(range(at, at + n))
    # a passage that documents share is reported in all but the first of them
    total = missed = 0
    for a, b, at, n in runs:
        if b < a:
            total += n
            missed += len(set(range(at, at + n)) - covered.get(a, set()))
    assert total > 2000 and missed <= 0.03 * total  # windows that an earlier document has too are compared with that one alone


def test_every_exact_passage_of_51_words_is_found_and_50_is_not(spark):
    r = random.Random(19)
    rows, wanted = [], set()
    for k in range(120):
        n = 51 if k % 2 else 50
        own = text(r, n)
        for i in range(2):
            rows.append((2 * k + i, f"{text(r, r.randrange(0, 30))} {own} {text(r, r.randrange(0, 30))}"))
            wanted |= {2 * k + i} if n == 51 else set()
    found = p.repeated_passages(awkward(spark, rows).repartition(2)).collect()
    assert {q.doc_id for q in found} == wanted and {q.n_words for q in found if q.kind == "inner"} == {51}
    assert all(q.first_id == q.doc_id - q.doc_id % 2 and q.removed == bool(q.doc_id % 2) for q in found)


def test_altered_passages_are_joined_or_left(spark):
    r = random.Random(23)
    own = text(r, 120).split()
    one, far = list(own), list(own)
    one[60] = "changed"
    for k in range(40, 80, 3):
        far[k] = f"other{k}"
    rows = [(k, f"{text(r, 20)} {' '.join(x)} {text(r, 20)}") for k, x in enumerate((own, one, far))]
    found = [q for q in p.repeated_passages(awkward(spark, rows)).collect() if q.kind == "inner"]
    assert sorted((q.doc_id, q.n_words) for q in found) == [(0, 120), (1, 120)]


def test_ties_and_different_partners(spark):
    r = random.Random(29)
    one, two = text(r, 70), text(r, 70)
    rows = [(3, f"{one} {text(r, 20)}"), (5, f"{text(r, 9)} {two}"), (7, f"{one} {two}"), (9, f"{two}\n{one}")]
    found = [q for q in p.repeated_passages(awkward(spark, rows)).collect() if q.kind == "inner" and q.removed]
    assert sorted((q.doc_id, q.first_id, q.n_words) for q in found) == [(7, 3, 70), (7, 5, 70), (9, 3, 70), (9, 5, 70)]


def test_a_line_with_the_ends_of_an_inner_passage_is_listed_if_the_keeper_has_it(spark):
    r = random.Random(31)
    whole, one = text(r, 9), text(r, 70)
    rows = [(1, f"{whole} {one}"), (2, one), (3, f"{whole} {one}")]
    found = p.repeated_passages(awkward(spark, rows)).collect()
    assert sorted((q.doc_id, q.n_words, q.kind) for q in found if q.removed) == [(2, 70, "inner"), (3, 79, "line")]
    inner, own, alike = ([1, 0, 9, 9, *k] for k in ((0, 9, 9, None, None), (None, None, None, 5, True), (None, None, None, 5, False)))
    assert p._outermost([alike, inner]) == [inner] and p._outermost([inner, own]) == p._outermost([own, inner]) == [own]


def test_a_word_said_over_and_over(spark):
    rows = [(1, "echo " * 5000), (2, "echo " * 3000), (3, "la di " * 400), (4, "echo " * 40)]
    found = p.repeated_passages(awkward(spark, rows)).collect()
    assert {q.doc_id for q in found} == {1, 2} and {q.first_id for q in found} == {1}


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_slide(n):
    x = np.random.default_rng(n).integers(0, 100, 50)
    got = p._slide(x, n, np.minimum)
    assert all(got[k] == x[k : k + n].min() for k in range(50 - n + 1))


def test_filters_are_let_go(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    r, made, gone = random.Random(5), [], []
    build, destroy = p.build, Broadcast.destroy
    monkeypatch.setattr(p, "build", lambda *a: made.append(1) or build(*a))
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: gone.append(1) or destroy(self, *a))
    one = text(r, 70)
    found = p.repeated_passages(spark.createDataFrame([(1, f"{text(r, 9)} {one}"), (2, f"{one} {text(r, 9)}")], "doc_id long, text string")).collect()
    assert sorted((q.doc_id, q.n_words, q.removed) for q in found) == [(1, 70, False), (2, 70, True)]
    assert len(gone) == len(made) == 4
