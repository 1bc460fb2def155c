import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluiceway.llm import token_store as s
from sluiceway.llm.common import new_path, span_keys

from .awkward import TEXTS, awkward, empty

PATH = s.vocabulary()


@pytest.fixture(scope="module")
def table():
    return Tokenizer.from_file(PATH)


def test_awkward_rows(spark, table):
    rows = [*TEXTS, (20, "İstanbul'da ĞÜŞ don't STOP—now <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y"), (21, "é Å ǅ ß.-- 3,000.50% (a)b c's'd"), (22, "a b c​d\x85e\x1cf")]
    shards = s.write_shards(awkward(spark, rows), PATH, new_path(spark, "sst"), partitions=4)
    got = s.read_shards(shards).orderBy("start").collect()
    ids = {}
    for key, text in rows:
        ids.setdefault(key, []).append([*table.encode(text or "", add_special_tokens=False).ids, 1])
    at = 0
    assert [r.id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    for r in got:
        crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r.id]]
        assert r.start == at and r.ids_crc32 in crc and r.n_tokens == len(ids[r.id][crc.index(r.ids_crc32)])
        at += r.n_tokens
    assert sum(r.n_tokens for r in shards.collect()) == at


def test_the_encoder_as_the_library(spark, table):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()
    texts = [r.text for r in docs]
    own = s.Encoder(PATH)
    got = [np.frombuffer(x, f"<u{own.id_bytes}").tolist() for x in own.encode(pa.array(texts))]
    assert got == [x.ids for x in table.encode_batch(texts, add_special_tokens=False)]


def test_lookup(tmp_path):
    uri = f"file://{tmp_path}/a.sst"
    writer = s.ShardWriter(uri, 2)
    keys = [None, -5, *range(0, 9000, 3), 9000, 9000, 2**62]
    for k in keys:
        writer.add(s.key_of(k), np.arange((k or 0) % 50, dtype="<u2").tobytes())
    with pytest.raises(ValueError, match="descend"):
        writer.add(s.key_of(1), b"")
    writer.close()
    reader = s.ShardReader(uri)
    assert len(reader.blocks) > 1 and reader.docs == len(keys)
    assert [s.value_of(k, False) for k, _ in reader] == keys
    for k in (None, -5, 0, 3, 4500, 2**62):
        assert [x.tolist() for x in reader.lookup(k)] == [list(range((k or 0) % 50))]
    assert len(reader.lookup(9000)) == 2
    assert not any(reader.lookup(k) for k in (1, 2, 8999, -1, 2**62 + 1))
    data = bytearray((tmp_path / "a.sst").read_bytes())
    data[100] ^= 1
    (tmp_path / "b.sst").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(s.ShardReader(f"file://{tmp_path}/b.sst"))


def test_text_keys_sort_and_empty_table(spark, tmp_path):
    assert sorted([s.key_of(x) for x in ("b", "a", "aa", None)]) == [s.key_of(x) for x in (None, "a", "aa", "b")]
    assert s.read_shards(s.write_shards(empty(spark), PATH, new_path(spark, "sst"))).count() == 0


def test_cuts_and_forgetting_change_no_id(table):
    r = random.Random(31)
    signs = [*"abzAZ019'\"-.,;:!?()<|> \t\n\x0b\x1c\x7f_@$", "'s", "'re", "'LL", "don't", "é", "e\u0301", "\u0338", "=\u0338", "K", ";", "ß", "İ", "Σ", "漢", "½", "٣", "🙂", "\u00a0", "\u3000", "<|endoftext|>", "abcdefghijklmnop", "straße"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(3000)]
    expected = [x.ids for x in table.encode_batch(texts, add_special_tokens=False)]
    for most in (0, 20_000, 48 << 20):
        own = s.Encoder(PATH, most)
        for k in range(0, 3000, 500):
            got = [np.frombuffer(x, f"<u{own.id_bytes}").tolist() for x in own.encode(pa.array(texts[k : k + 500]))]
            assert got == expected[k : k + 500]
            assert own.bytes_held <= most


def test_hashes_that_two_parts_share(monkeypatch, table):
    monkeypatch.setattr(s, "span_keys", lambda data, start, size: (np.zeros(len(start), np.uint64), *span_keys(data, start, size)[1:]))
    own = s.Encoder(PATH)
    for text in ("one", "two words", "one two one"):
        assert np.frombuffer(own.encode(pa.array([text]))[0], "<u2").tolist() == table.encode(text, add_special_tokens=False).ids


def test_shards_are_read_by_many_tasks(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(500)], "doc_id long, text string")
    found = s.read_shards(s.write_shards(docs, PATH, new_path(spark, "sst"), partitions=9))
    tasks = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(tasks) == 9


def test_a_path_without_a_scheme_is_no_path_of_an_executor():
    with pytest.raises(ValueError, match="scheme"):
        s.ShardReader("/user/somebody/a.sst")
