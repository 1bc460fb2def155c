import threading

import numpy as np
import pyarrow as pa
import pytest

from sluiceway.llm import common


def test_tables_go_with_their_scratch_unless_kept(spark):
    there = lambda table: common.exists(spark, table.inputFiles()[0])
    with common.scratch(spark):
        with common.scratch(spark):
            gone, kept = (common.materialise(spark.range(5), "t", keep=k) for k in (False, True))
            assert there(gone) and there(kept)
            other: list = []
            thread = threading.Thread(target=lambda: other.append(common.materialise(spark.range(2), "other")))
            thread.start()
            thread.join()
        assert kept.count() == 5
        with pytest.raises(Exception, match="exist|FileNotFound"):
            gone.count()
    with pytest.raises(Exception, match="exist|FileNotFound"):
        kept.count()
    assert other[0].count() == 2, "what another thread writes is not of this scratch"
    common.discard(other[0])
    with pytest.raises(Exception, match="exist|FileNotFound"):
        other[0].count()


def test_discard_leaves_what_is_not_its_own(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    table = spark.read.parquet(str(tmp_path / "x"))
    common.discard(table)
    assert table.count() == 3


def test_each_thing_to_read_has_a_task(spark):
    listed = spark.range(37).withColumnRenamed("id", "k")
    assert common.dealt(listed, 37, "k").rdd.getNumPartitions() == 37
    assert common.dealt(listed.limit(0), 0, "k").count() == 0


def test_span_keys_tell_spans_apart():
    texts = [b"", b"a", b"\0", b"a\0", b"abcdefg", b"abcdefgh", b"abcdefghi" * 3, b"abcdefghi" * 2 + b"abcdefghj", b"xbcdefghi" * 3]
    data = np.frombuffer(b"".join(texts) + b"abcdefghi" * 3, np.uint8)
    size = np.array([*map(len, texts), 27])
    start = np.cumsum(size) - size
    keys, first, last = common.span_keys(data, start[1:], size[1:])
    assert len(set(keys.tolist())) == len(texts) - 1 and keys[-1] == keys[5] and first[-1] == first[5] and last[-1] == last[5]


def test_slices_hold_whole_rows():
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["a" * 50, None, "b" * 500, "", "c" * 30])})
    parts = list(common.slices(batch, 0, 100))
    assert sum(p.num_rows for p in parts) == 5 and max(p.num_rows for p in parts) < 5
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_the_drivers_garbage_goes_when_a_table_is_written(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAP_SHARE", 0, raising=False)
    full = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName())
    before = full()
    assert common.materialise(spark.range(3).toDF("id"), "few").count() == 3
    assert full() > before
    common._trim(spark)  # whether the JVM can or not
