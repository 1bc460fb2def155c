"""Sharded sinks, and the reader for what they write.

A writer is bound into a data source of Spark.  Where moving a file is cheap, tasks write under a
staging folder with names of their own and report them; the commit numbers them in the order of
partitions, moves them many at a time, adds the metadata and puts the folder in its place.  In an
object store, where each move would copy the data, tasks write in place under names that last, and
the commit publishes the list of them.  A failed job leaves nothing, and a task that ran twice
nothing twice.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.consume import spread
from ..operators.progress import Callback, CallbackManager, ProgressMonitor, TqdmReporterCallback, Watch
from ..operators.sharding import ShardingController, ShardingStrategy
from ..operators.transforms import rebatched
from . import files

#: Files that a commit moves at a time.
MOVERS = 32
STATE, INFO, MANIFEST, SPLITS = "state.json", "dataset_info.json", "manifest.json", "dataset_dict.json"
#: Of a stream: a file for each micro-batch, and how far it has come.
LOG, HEAD = "batches", "head.json"


@dataclass
class DatasetInfo:
    """What a format is told of the table."""

    schema: pa.Schema
    path: str
    split: str | None = None


@dataclass
class Written(WriterCommitMessage):
    partition: int
    shards: list[dict[str, Any]] = field(default_factory=list)
    rows: int = 0
    secs: float = 0.0


class BaseDatasetWriter:
    """Writes a table, or a dictionary of named ones, as numbered shards.

    A subclass has write_batch_arrow (a pyarrow table) or write_batch_py (a dictionary of lists),
    or both, which return the bytes written, and initialize_shard and finalize_shard; `shard_name`
    says how files are called.  Those run inside tasks, on a copy of the writer.  initialize and
    finalize run once for each table, on the driver."""

    SUPPORTED_FORMATS: tuple[str, ...] = ()
    extension = "bin"

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        found = [name for name, method in (("python", "write_batch_py"), ("arrow", "write_batch_arrow")) if getattr(cls, method) is not getattr(BaseDatasetWriter, method)]
        # a class that is unpickled in a worker is made empty (by types.new_class) and filled afterwards
        if not found and sys._getframe(1).f_globals.get("__name__") != "types":
            raise TypeError(f"{cls.__name__} has neither write_batch_py nor write_batch_arrow")
        cls.SUPPORTED_FORMATS = tuple(found)

    def __init__(self, save_dir: str, overwrite: bool = False, num_proc: int | None = None, prefetch_factor: int = 128, write_batch_size: int = 256, tqdm_update_interval: float = 0.5, disable_tqdm: bool = False, sharding_strategy: ShardingStrategy = ShardingStrategy.FILE_SIZE, max_shard_size: int | str | None = None, sample_size_key: str | None = None, callbacks: list[Callback] | None = None):
        ShardingController(sharding_strategy, max_shard_size, sample_size_key)  # raises for what cannot be
        self.save_dir, self.overwrite, self.num_proc = files.absolute(save_dir), overwrite, num_proc
        self.prefetch_factor, self.write_batch_size = prefetch_factor, write_batch_size
        self.limits = (sharding_strategy, max_shard_size, sample_size_key)
        self.moves = files.moves_are_cheap(self.save_dir)
        self.callbacks = list(callbacks or [])
        if not disable_tqdm:
            self.callbacks.append(TqdmReporterCallback(tqdm_update_interval))

    # what a format defines
    def write_batch_py(self, batch: dict[str, list[Any]]) -> int:
        raise NotImplementedError

    def write_batch_arrow(self, batch: pa.Table) -> int:
        raise NotImplementedError

    def initialize_shard(self, path: str, info: DatasetInfo) -> None:
        raise NotImplementedError

    def finalize_shard(self, info: DatasetInfo) -> None:
        raise NotImplementedError

    def initialize(self, info: DatasetInfo) -> None:
        """Before a table is written."""

    def finalize(self, info: DatasetInfo) -> None:
        """After a table is committed."""

    def prepare(self, df: DataFrame) -> DataFrame:
        """The table as the sink gets it."""
        return df

    def shard_name(self, number: int) -> str:
        return f"shard-{number:05}.{self.extension}"

    def write_batch(self, batch: pa.RecordBatch) -> int:
        """Arrow where the format takes it, as Spark's batches are."""
        if "arrow" in self.SUPPORTED_FORMATS:
            return self.write_batch_arrow(pa.Table.from_batches([batch]))
        return self.write_batch_py(batch.to_pydict())

    def write(self, ds: DataFrame | dict[str, DataFrame]) -> list[dict[str, Any]] | dict[str, list[dict[str, Any]]]:
        """Write it; returns the manifest: a row per shard with file, partition, rows and bytes.

        A folder that exists is an error unless overwrite is set, and then stays as it is until
        all is written.  Each split of a dictionary has its own folder and numbers; splits are
        written one after another, each by all of the cluster."""
        spark = next(iter(ds.values())).sparkSession if isinstance(ds, dict) and ds else ds.sparkSession if not isinstance(ds, dict) else None
        if spark is not None:
            self.save_dir = files.qualified(spark, self.save_dir)
            self.moves = self.moves and files.moves_are_cheap(self.save_dir)
        if files.exists(self.save_dir) and not self.overwrite:
            raise FileExistsError(self.save_dir)
        return self._write_moved(ds) if self.moves else self._write_in_place(ds)

    def _write_in_place(self, ds: DataFrame | dict[str, DataFrame]) -> Any:
        """No file is moved: readers go by the state file, which changes last; then old files go."""
        split = isinstance(ds, dict)
        folders = {name: f"{self.save_dir}/{name}" for name in ds} if split else {None: self.save_dir}
        before = {folder: set(files.names(folder)) for folder in [self.save_dir, *folders.values()]}
        out = {name: self._write_one(ds[name] if split else ds, folder, name) for name, folder in folders.items()}
        if split:
            _dump(f"{self.save_dir}/{SPLITS}", {"splits": list(ds)})
        for name, folder in folders.items():
            for old in before[folder] - {STATE, INFO, MANIFEST, SPLITS, *(s["file"] for s in out[name]), *(str(x) for x in folders if x)}:
                files.remove_file(f"{folder}/{old}") if "." in old else files.remove_dir(f"{folder}/{old}")
        return out if split else out[None]

    def _write_moved(self, ds: DataFrame | dict[str, DataFrame]) -> Any:
        staging = f"{self.save_dir}.staging-{uuid.uuid4().hex}"
        try:
            if isinstance(ds, dict):
                files.make_dir(staging)
                out: Any = {name: self._write_one(df, f"{staging}/{name}", name) for name, df in ds.items()}
                _dump(f"{staging}/{SPLITS}", {"splits": list(ds)})
            else:
                out = self._write_one(ds, staging, None)
            old = f"{self.save_dir}.old-{uuid.uuid4().hex}"
            if files.exists(self.save_dir):
                files.move(self.save_dir, old)
            else:
                files.make_dir(os.path.dirname(self.save_dir))
            files.move(staging, self.save_dir)
            files.remove_dir(old)
        finally:
            files.remove_dir(staging)
        return out

    def _write_one(self, df: DataFrame, path: str, split: str | None) -> list[dict[str, Any]]:
        from ..ship import ship

        spark = df.sparkSession
        ship(spark)
        schema = df.schema
        out = self.prepare(spread(df, self.num_proc) if self.num_proc else df)
        info = DatasetInfo(_arrow(schema), path, split)
        files.make_dir(path)
        self.initialize(info)
        parts = out.rdd.getNumPartitions()
        monitor, manager = ProgressMonitor(parts, parts), CallbackManager(self.callbacks)
        name = f"shards_{uuid.uuid4().hex}"
        spark.dataSource.register(_bound(name, _without_callbacks(self), schema.json()))
        manager.on_start(monitor, df)
        try:
            with Watch(spark, monitor, manager) as watch:
                watch.run(out.write.format(name).option("path", path).option("split", split or "").mode("append").save)
                watch.finish([_Status(**r) for r in _load(f"{path}/{MANIFEST}")["tasks"]])
        finally:
            monitor.stopping()
            manager.on_stopping(monitor)
            monitor.done()
            manager.on_done(monitor)
        self.finalize(info)
        return _load(f"{path}/{MANIFEST}")["shards"]


@dataclass
class _Status:
    partition: int
    rows: int
    secs: float


def _without_callbacks(writer: BaseDatasetWriter) -> BaseDatasetWriter:
    import copy

    out = copy.copy(writer)
    out.callbacks = []
    return out


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _dump(path: str, value: Any) -> None:
    with files.open_write(path) as out:
        out.write(json.dumps(value, indent=2, sort_keys=True).encode())


def _load(path: str) -> Any:
    with files.open_read(path) as f:
        return json.loads(f.read())


def _bound(name: str, format_: BaseDatasetWriter, declared: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
            return ShardWriter(format_, self.options["path"], self.options.get("split") or None, declared, schema)

    return Source


class ShardWriter(DataSourceArrowWriter):
    """One per write; `write` runs in each task, `commit` and `abort` on the driver."""

    def __init__(self, format_: BaseDatasetWriter, path: str, split: str | None, schema: str, given: T.StructType):
        self.format, self.path, self.split, self.schema = format_, path, split, schema
        self.given = _arrow(given)
        self.write_id = uuid.uuid4().hex[:12]
        self.staging = f"{path}/_staging-{self.write_id}"

    @property
    def info(self) -> DatasetInfo:
        return DatasetInfo(self.given, self.path, self.split)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        message, limits, info = Written(context.partitionId()), ShardingController(*self.format.limits), self.info
        begun = time.perf_counter()
        for batch in rebatched(iterator, self.format.write_batch_size):
            if limits.full():
                self.format.finalize_shard(info)
                limits.finalize()
            if not limits.open:
                files.make_dir(self.staging if self.format.moves else self.path)
                own = f"{context.partitionId():05}-{len(message.shards):05}-{context.taskAttemptId()}"
                path = f"{self.staging}/{own}-{uuid.uuid4().hex}" if self.format.moves else f"{self.path}/shard-{self.write_id}-{own}.{self.format.extension}"
                self.format.initialize_shard(path, info)
                limits.initialize()
                message.shards.append({"path": path, "rows": 0, "bytes": 0})
            item = limits.item(batch)
            n = self.format.write_batch(batch)
            limits.update(batch.num_rows, item, n)
            message.shards[-1]["rows"] += batch.num_rows
            message.shards[-1]["bytes"] += n
            message.rows += batch.num_rows
        if limits.open:
            self.format.finalize_shard(info)
        message.secs = time.perf_counter() - begun
        return message

    def _publish(self, messages: list[Written | None], first: int = 0, empty: bool = True) -> dict[str, Any]:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        found = [(m.partition, s) for m in done for s in m.shards]
        names = [self.format.shard_name(first + k) if self.format.moves else os.path.basename(s["path"]) for k, (_, s) in enumerate(found)]
        if self.format.moves:
            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(lambda x: files.move(x[0][1]["path"], f"{self.path}/{x[1]}"), zip(found, names, strict=True)))
        shards = [{"file": name, "partition": p, "rows": s["rows"], "bytes": s["bytes"]} for name, (p, s) in zip(names, found, strict=True)]
        if not shards and empty:  # so that the schema is there
            name = self.format.shard_name(first) if self.format.moves else f"shard-{self.write_id}-00000.{self.format.extension}"
            self.format.initialize_shard(f"{self.path}/{name}", self.info)
            self.format.finalize_shard(self.info)
            shards.append({"file": name, "partition": 0, "rows": 0, "bytes": 0})
        self._clear({s["file"] for s in shards})
        return {"shards": shards, "tasks": [{"partition": m.partition, "rows": m.rows, "secs": m.secs} for m in done]}

    def _clear(self, kept: set[str]) -> None:
        """Removes what attempts have left that did not count."""
        files.remove_dir(self.staging)
        if not self.format.moves:
            for name in files.names(self.path):
                if name.startswith(f"shard-{self.write_id}-") and name not in kept:
                    files.remove_file(f"{self.path}/{name}")

    def _describe(self, manifest: dict[str, Any]) -> None:
        columns = T.StructType.fromJson(json.loads(self.schema)).names
        _dump(f"{self.path}/{MANIFEST}", manifest)
        _dump(f"{self.path}/{INFO}", {"schema": json.loads(self.schema), "file_format": self.format.extension, "num_rows": sum(s["rows"] for s in manifest["shards"])})
        _dump(f"{self.path}/{STATE}", {"_data_files": [{"filename": s["file"]} for s in manifest["shards"]], "_fingerprint": uuid.uuid4().hex, "_format_columns": columns, "_format_kwargs": {}, "_format_type": None, "_output_all_columns": False, "_split": self.split})

    def commit(self, messages: list[Written | None]) -> None:
        self._describe(self._publish(messages))

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(set())


class ArrowDatasetWriter(BaseDatasetWriter):
    """Arrow streams, shard-00000.arrow and on."""

    extension = "arrow"

    def initialize_shard(self, path: str, info: DatasetInfo) -> None:
        self._file = files.open_write(path)
        self._schema = info.schema
        self._stream = pa.ipc.new_stream(self._file, info.schema)

    def write_batch_arrow(self, batch: pa.Table) -> int:
        before = self._file.tell()
        self._stream.write_table(batch.cast(self._schema))
        return self._file.tell() - before

    def finalize_shard(self, info: DatasetInfo) -> None:
        self._stream.close()
        self._file.close()


class JsonDatasetWriter(BaseDatasetWriter):
    """A JSON object per line, shard-00000.json and on.  Rows become text in the plan, by Spark's
    own functions; nulls are written, and numbers that JSON lacks are null."""

    extension = "json"
    _ROW = "json"

    def __init__(self, *args: Any, **kwargs: Any):
        super().__init__(*args, **kwargs)
        if self.limits[0] == ShardingStrategy.SAMPLE_ITEM:
            self._size = self.limits[2]
            self.limits = (self.limits[0], self.limits[1], "size")
        else:
            self._size = None

    def prepare(self, df: DataFrame) -> DataFrame:
        finite = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c) for c in (f"{x}" for x in df.columns)]
        row = F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias(self._ROW)
        return df.select(row, *([F.col(self._size).cast("double").alias("size")] if self._size else []))

    def initialize_shard(self, path: str, info: DatasetInfo) -> None:
        self._file = files.open_write(path)

    def write_batch_arrow(self, batch: pa.Table) -> int:
        lines = batch.column(self._ROW).to_pylist()
        data = "".join(f"{x}\n" for x in lines).encode()
        self._file.write(data)
        return len(data)

    def finalize_shard(self, info: DatasetInfo) -> None:
        self._file.close()


def data_files(path: str) -> list[str]:
    """Files of a table that are committed: those of its state, and of the log of a stream."""
    out = [x["filename"] for x in _load(f"{path}/{STATE}")["_data_files"]]
    for name in sorted(files.names(f"{path}/{LOG}")):
        out += [s["file"] for s in _load(f"{path}/{LOG}/{name}")["shards"]]
    return out


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: T.StructType):
        self.paths, self.arrow = paths, _arrow(schema)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with files.open_read(partition.path) as f, pa.ipc.open_stream(f) as stream:
            for batch in stream:
                yield from pa.Table.from_batches([batch]).cast(self.arrow).to_batches()


class ShardSource(DataSource):
    """spark.read.format("sluiceway_shards").load(folder): the Arrow shards that its state names."""

    @classmethod
    def name(cls) -> str:
        return "sluiceway_shards"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(_load(f"{self.options['path']}/{INFO}")["schema"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        path = self.options["path"]
        return _ArrowReader([f"{path}/{x}" for x in data_files(path)], schema)


def read_shards(spark: SparkSession, path: str) -> DataFrame | dict[str, DataFrame]:
    """What a writer has written: a table, or a dictionary of them where there are splits.
    Only files that the state names are read, in a task each."""
    from ..ship import ship

    path = files.qualified(spark, path)
    if files.exists(f"{path}/{SPLITS}"):
        return {name: read_shards(spark, f"{path}/{name}") for name in _load(f"{path}/{SPLITS}")["splits"]}
    if not files.exists(f"{path}/{INFO}"):
        warnings.warn(f"{path} has no metadata", UserWarning, stacklevel=2)
        raise FileNotFoundError(f"{path}/{INFO}")
    info = _load(f"{path}/{INFO}")
    if info["file_format"] == "json":
        names = [f"{path}/{x}" for x in data_files(path)]
        return spark.read.schema(T.StructType.fromJson(info["schema"])).json(names)
    if info["file_format"] != "arrow":
        raise ValueError(f"no reader for {info['file_format']}")
    ship(spark)
    spark.dataSource.register(ShardSource)
    return spark.read.format("sluiceway_shards").load(path)
