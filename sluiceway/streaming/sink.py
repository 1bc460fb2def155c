"""The same shards from a stream: every micro-batch adds its files to a folder."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter

from ..sources import files
from ..sources.shards import HEAD, INFO, LOG, BaseDatasetWriter, ShardWriter, Written, _dump, _load, _without_callbacks


class StreamShardWriter(ShardWriter, DataSourceStreamArrowWriter):
    """Commits each micro-batch once, as a file of its own in the log, so that a commit costs what the
    batch holds, however long the stream has run.  The head says which batch was the last and what the
    next shard's number is; a batch that it has is not added again."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        head: dict[str, Any] = _load(f"{self.path}/{HEAD}") if files.exists(f"{self.path}/{HEAD}") else {"batch": -1, "shards": 0}
        if batchId <= head["batch"]:
            self._clear(set())
            return
        first = not files.exists(f"{self.path}/{INFO}")
        if first:
            self._describe({"shards": [], "tasks": []})
        entry = self._publish(messages, head["shards"], empty=first)
        files.make_dir(f"{self.path}/{LOG}")
        _dump(f"{self.path}/{LOG}/{batchId:012}.json", entry)
        _dump(f"{self.path}/{HEAD}", {"batch": batchId, "shards": head["shards"] + len(entry["shards"])})

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._clear(set())


def write_stream(df: DataFrame, writer: BaseDatasetWriter, checkpoint: str, **trigger: Any) -> Any:
    """Start a query that writes shards with the format and limits of `writer` into its folder;
    by default it takes what is there and ends.  Its folder is added to, not replaced."""
    from ..ship import ship

    spark = df.sparkSession
    ship(spark)
    name, declared, bare = f"shards_{uuid.uuid4().hex}", df.schema.json(), _without_callbacks(writer)
    files.make_dir(writer.save_dir)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
            return StreamShardWriter(bare, self.options["path"], None, declared, schema)

    spark.dataSource.register(Source)
    return writer.prepare(df).writeStream.format(name).option("path", writer.save_dir).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
