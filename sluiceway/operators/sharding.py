"""Where one output file ends and the next begins."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from enum import Enum

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import parse_size
from .numbering import numbered


class ShardingStrategy(str, Enum):
    """SAMPLE_COUNT: rows; SAMPLE_ITEM: the sum of a column; FILE_SIZE: bytes; NONE: one file a task."""

    SAMPLE_COUNT = "sample_count"
    SAMPLE_ITEM = "sample_item"
    FILE_SIZE = "file_size"
    NONE = "none"


DEFAULT_SIZE = "5GB"


class ShardingController:
    """Limits of a write, and the state of the file that a task has open.

    A limit is tested before each batch, so a file ends with the batch that reaches it.
    No limit, or strategy NONE, never ends a file."""

    def __init__(self, strategy: ShardingStrategy = ShardingStrategy.FILE_SIZE, max_shard_size: int | str | None = None, sample_size_key: str | None = None):
        self.strategy = ShardingStrategy(strategy)
        if max_shard_size is None and self.strategy is ShardingStrategy.FILE_SIZE:
            max_shard_size = DEFAULT_SIZE
        if sample_size_key is not None and self.strategy is not ShardingStrategy.SAMPLE_ITEM:
            warnings.warn(f"sample_size_key is of no use with {self.strategy.value}", UserWarning, stacklevel=2)
        if sample_size_key is None and self.strategy is ShardingStrategy.SAMPLE_ITEM:
            raise ValueError("sample_item needs a sample_size_key")
        if isinstance(max_shard_size, str) and self.strategy is not ShardingStrategy.FILE_SIZE:
            raise ValueError(f"{self.strategy.value} takes a number, not {max_shard_size!r}")
        self.limit = parse_size(max_shard_size) if isinstance(max_shard_size, str) else max_shard_size
        self.key, self.size, self.open = sample_size_key, 0, False

    @property
    def is_active(self) -> bool:
        return self.strategy is not ShardingStrategy.NONE and self.limit is not None

    def full(self) -> bool:
        return self.is_active and self.size >= self.limit

    def initialize(self) -> None:
        if self.open:
            raise AssertionError("a shard is open already")
        self.open, self.size = True, 0

    def finalize(self) -> None:
        """Without an open shard, nothing."""
        self.open, self.size = False, 0

    def update(self, rows: int, item: float, written: int) -> None:
        self.size += {ShardingStrategy.SAMPLE_COUNT: rows, ShardingStrategy.SAMPLE_ITEM: item, ShardingStrategy.FILE_SIZE: written, ShardingStrategy.NONE: 0}[self.strategy]

    def item(self, batch: pa.RecordBatch | pa.Table) -> float:
        return (pc.sum(batch.column(self.key)).as_py() or 0) if self.strategy is ShardingStrategy.SAMPLE_ITEM else 0


def shards_by_count(df: DataFrame, rows: int, order_by: str | list[str], to: str = "shard") -> DataFrame:
    """The file of each row if files take `rows` rows, all in one order."""
    return numbered(df, order_by).withColumn(to, F.floor(F.col("_n") / rows).cast("long")).drop("_n")


def shards_by_item(df: DataFrame, stream: str, order_by: str, key: str, limit: float, to: str = "shard") -> DataFrame:
    """The file of each row of every stream if a file ends with the row that brings the sum of
    `key` to the limit.  A sum that starts again cannot be a window; rows of a stream go through
    one task in order, which holds a batch of them only."""
    kind = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, total = object(), 0, 0.0
        for batch in batches:
            out = []
            for name, size in zip(batch.column(stream).to_pylist(), batch.column(key).to_pylist(), strict=True):
                if name != now:
                    now, shard, total = name, 0, 0.0
                if total >= limit:
                    shard, total = shard + 1, 0.0
                total += size or 0
                out.append(shard)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, to])

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, stream).sortWithinPartitions(stream, order_by).mapInArrow(run, kind.add(to, "long") if to not in kind.names else kind)
