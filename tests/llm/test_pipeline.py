import pyarrow as pa
import pytest

import corpus_pipeline
from sluiceway.llm import byte_bpe, toxicity
from sluiceway.llm.common import read_table

from .awkward import awkward, empty
from .test_byte_bpe import TABLE
from .test_decontaminate import brute as contaminated
from .test_exact_dedup import brute as exact
from .test_near_dedup import brute as near

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    scores = {r.doc_id: r.score for r in toxicity.tag(docs, toxicity.train(docs, read_table(spark, SF, "labels"))).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] < 0.5]
    assert 0.5 * len(scores) < len(rows) < len(scores)
    for kept in (lambda x: {r[0] for r in exact(x) if r[3]}, lambda x: {r[0] for r in near(x) if r[3]}, lambda x: {r[0] for r in contaminated(x, items) if not r[5]}):
        items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
        left = kept(rows)
        assert len(left) < len(rows)
        rows = [r for r in rows if r[0] in left]
    got = {r.doc_id: (r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {k: (len(i := TABLE.encode_ordinary(t)), i) for k, t in rows}


def test_each_stage_takes_awkward_rows_and_none(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns == (["doc_id", "n_tokens", "ids", "starts"] if name == corpus_pipeline.STAGES[-1][0] else docs.columns)
            assert out.count() <= docs.count()


def test_the_last_stage_decodes_its_ids(monkeypatch):
    runs = []
    monkeypatch.setattr(byte_bpe, "map_arrow", lambda rows, run, schema, text: runs.append(run) or rows)
    corpus_pipeline.token_ids(None, Rows(), SF)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": ["naïve words, twice", None, "", "and words"]})
    out = next(iter(runs[0](batch)))
    assert out.column(2).to_pylist() == [TABLE.encode_ordinary(x or "") for x in batch.column(1).to_pylist()]
    right = byte_bpe.encode_batch

    def wrong(*args):
        ids, *rest = right(*args)
        return [[*ids[0][:-1], ids[0][-1] + 1], *ids[1:]], *rest

    monkeypatch.setattr(byte_bpe, "encode_batch", wrong)
    with pytest.raises(ValueError, match="decode"):
        next(iter(runs[0](batch)))


class Rows:
    """As much of a DataFrame as a stage touches before its rows are read."""

    schema = type("Schema", (), {"__getitem__": lambda self, k: type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda self: "bigint"})()})()})()
    select = withColumnRenamed = lambda self, *names: self
