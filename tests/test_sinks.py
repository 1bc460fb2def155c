import datetime
import json
from decimal import Decimal

import pytest

from sluiceway import ArrowDatasetWriter, BaseDatasetWriter, JsonDatasetWriter, ShardingStrategy, read_shards

SCHEMA = "i long, d double, s string, a array<struct<m:map<string,int>>>, b binary, n decimal(10,2), day date, at timestamp, naive timestamp_ntz"
ROWS = [
    (1, 1.5, "é日", [({"x": 1},)], b"\x00\xff", Decimal("1.25"), datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 3, 4, 5), datetime.datetime(2021, 1, 2, 3, 4, 5, 6)),
    (None,) * 9,
]


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_arrow_types(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    ArrowDatasetWriter(str(tmp_path / "x"), disable_tqdm=True).write(df)
    back = read_shards(spark, str(tmp_path / "x"))
    assert back.schema == df.schema and same(back, df)


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 2.5, "ü")], "k long, d double, s string").coalesce(1)
    JsonDatasetWriter(str(tmp_path / "x"), disable_tqdm=True).write(df)
    lines = (tmp_path / "x/shard-00000.json").read_text().splitlines()
    assert [json.loads(x) for x in lines] == [{"k": 1, "d": None, "s": None}, {"k": 2, "d": 2.5, "s": "ü"}]
    assert same(read_shards(spark, str(tmp_path / "x")), spark.createDataFrame([(1, None, None), (2, 2.5, "ü")], df.schema))


@pytest.mark.parametrize("kind", [ArrowDatasetWriter, JsonDatasetWriter])
def test_limits(spark, tmp_path, kind):
    df = spark.range(20).coalesce(1)
    write = lambda name, **k: [s["rows"] for s in kind(str(tmp_path / name), disable_tqdm=True, **k).write(df)]
    assert write("a", sharding_strategy=ShardingStrategy.SAMPLE_COUNT, max_shard_size=8, write_batch_size=4) == [8, 8, 4]
    assert write("b", sharding_strategy=ShardingStrategy.SAMPLE_ITEM, max_shard_size=30, sample_size_key="id", write_batch_size=1) == [9, 3, 3, 2, 2, 1]
    assert write("c", sharding_strategy=ShardingStrategy.NONE, write_batch_size=1) == [20]
    assert write("d", max_shard_size="1B", write_batch_size=7) == [7, 7, 6]
    assert sorted(r.id for r in read_shards(spark, str(tmp_path / "d")).collect()) == list(range(20))


def test_files_and_numbers(spark, tmp_path):
    manifest = ArrowDatasetWriter(str(tmp_path / "x"), num_proc=3, disable_tqdm=True).write(spark.range(9).coalesce(1))
    assert [s["file"] for s in manifest] == [f"shard-{k:05}.arrow" for k in range(len(manifest))]
    assert {p.name for p in (tmp_path / "x").iterdir()} == {s["file"] for s in manifest} | {"state.json", "dataset_info.json", "manifest.json"}
    state = json.loads((tmp_path / "x/state.json").read_text())
    assert [f["filename"] for f in state["_data_files"]] == [s["file"] for s in manifest]
    assert [p.name for p in tmp_path.iterdir()] == ["x"]


def test_empty_table_keeps_its_schema(spark, tmp_path):
    for kind in (ArrowDatasetWriter, JsonDatasetWriter):
        kind(str(tmp_path / kind.extension), disable_tqdm=True).write(spark.createDataFrame([], "a int, b string"))
        back = read_shards(spark, str(tmp_path / kind.extension))
        assert back.count() == 0 and back.columns == ["a", "b"]


def test_overwrite(spark, tmp_path):
    path = str(tmp_path / "x")
    ArrowDatasetWriter(path, disable_tqdm=True).write(spark.range(3))
    with pytest.raises(FileExistsError):
        ArrowDatasetWriter(path, disable_tqdm=True).write(spark.range(4))
    bad = spark.range(4).selectExpr("assert_true(id < 2) as x", "id")
    with pytest.raises(Exception):  # noqa: B017
        ArrowDatasetWriter(path, overwrite=True, disable_tqdm=True).write(bad.select("id", "x"))
    assert read_shards(spark, path).count() == 3, "what was there stays until all is written"
    ArrowDatasetWriter(path, overwrite=True, disable_tqdm=True).write(spark.range(5))
    assert read_shards(spark, path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["x"]


def test_splits(spark, tmp_path):
    path = str(tmp_path / "x")
    JsonDatasetWriter(path, disable_tqdm=True).write({"train": spark.range(10), "test": spark.range(10, 20)})
    assert json.loads((tmp_path / "x/dataset_dict.json").read_text()) == {"splits": ["train", "test"]}
    assert {k: sorted(r.id for r in d.collect()) for k, d in read_shards(spark, path).items()} == {"train": list(range(10)), "test": list(range(10, 20))}


def test_capabilities():
    with pytest.raises(TypeError):

        class Neither(BaseDatasetWriter):
            pass

    class Both(BaseDatasetWriter):
        def write_batch_py(self, batch):
            return 0

        def write_batch_arrow(self, batch):
            return 0

    assert Both.SUPPORTED_FORMATS == ("python", "arrow")


def test_own_format(spark, tmp_path):
    class Lines(BaseDatasetWriter):
        extension = "txt"

        def initialize(self, info):
            (tmp_path / "began").touch()

        def initialize_shard(self, path, info):
            self.out = open(path, "w")

        def write_batch_py(self, batch):
            return self.out.write("".join(f"{x}\n" for x in batch["id"]))

        def finalize_shard(self, info):
            self.out.close()

    manifest = Lines(str(tmp_path / "x"), disable_tqdm=True).write(spark.range(10).coalesce(2))
    assert (tmp_path / "began").exists()
    assert sorted(int(x) for s in manifest for x in (tmp_path / "x" / s["file"]).read_text().split()) == list(range(10))
    with pytest.raises(ValueError):
        read_shards(spark, str(tmp_path / "x"))


def test_stream(spark, tmp_path):
    from sluiceway.streaming.sink import write_stream

    source, path = tmp_path / "in", str(tmp_path / "x")
    spark.range(20).write.parquet(str(source))
    for more in (0, 5):
        if more:
            spark.range(20, 25).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long").parquet(str(source))
        write_stream(stream, ArrowDatasetWriter(path, disable_tqdm=True), str(tmp_path / "checkpoint")).awaitTermination()
        assert sorted(r.id for r in read_shards(spark, path).collect()) == list(range(20 + more))
    from sluiceway.sources.shards import data_files

    assert data_files(path) == [f"shard-{k:05}.arrow" for k in range(len(data_files(path)))]
    assert len(list((tmp_path / "x/batches").iterdir())) == 2 and json.loads((tmp_path / "x/head.json").read_text())["batch"] == 1


@pytest.mark.parametrize("split", [False, True])
def test_where_moves_are_dear_no_file_is_moved(spark, tmp_path, monkeypatch, split):
    from sluiceway.sources import files

    monkeypatch.setattr(files, "moves_are_cheap", lambda uri: False)
    path = tmp_path / "x"
    write = lambda df: ArrowDatasetWriter(str(path), overwrite=True, num_proc=2, disable_tqdm=True).write({"a": df, "b": df} if split else df)
    read = lambda: read_shards(spark, str(path))["b"] if split else read_shards(spark, str(path))
    folder = path / "b" if split else path
    write(spark.range(7))
    assert sorted(r.id for r in read().collect()) == list(range(7))
    with pytest.raises(Exception, match="'id'|assert|big"):
        write(spark.range(9).repartition(2).selectExpr("assert_true(id < 8, 'big') as x", "id"))
    assert sorted(r.id for r in read().collect()) == list(range(7)), "what was there stays until all is written"
    out = write(spark.range(5))
    assert sorted(r.id for r in read().collect()) == list(range(5))
    manifest = out["b"] if split else out
    assert {p.name for p in folder.iterdir()} == {s["file"] for s in manifest} | {"state.json", "dataset_info.json", "manifest.json"}


def test_a_path_without_scheme_is_on_the_default_file_system(spark, tmp_path):
    from sluiceway.sources import files

    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./data", f"file://{tmp_path}")
    try:
        assert files.qualified(spark, "/data/x") == "viewfs://store/data/x"
        assert files.qualified(spark, f"file://{tmp_path}/x") == f"{tmp_path}/x"
    finally:
        conf.set("fs.defaultFS", before)
    assert files.qualified(spark, str(tmp_path)) == str(tmp_path)
