"""Partition-wise consumption: a function for every row or batch, for what it does, not for what it returns."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..functions.averages import EMA
from .progress import Callback, CallbackManager, ProgressMonitor, TqdmReporterCallback, Watch
from .transforms import rebatched

STATUS = "partition int, batches long, rows long, secs double, stream double, transform double, finalize double, failed_batches long, failed_rows long, error string"
_NAMES = ["partition", "batches", "rows", "secs", "stream", "transform", "finalize", "failed_batches", "failed_rows", "error"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]


def _nothing() -> None:
    """The default hook."""


class Timed:
    """An iterator that counts the seconds spent waiting for what it yields, and averages them."""

    def __init__(self, items: Iterator[Any], smoothing: float = 0.1):
        self._items, self.total_time, self._average = iter(items), 0.0, EMA(smoothing)

    @property
    def smooth_time(self) -> float:
        return self._average.value

    def __iter__(self) -> Timed:
        return self

    def __next__(self) -> Any:
        begun = time.perf_counter()
        out = next(self._items)
        seconds = time.perf_counter() - begun
        self.total_time += seconds
        self._average.update(seconds)
        return out


def _items(batches: Iterator[pa.RecordBatch], batch_size: int | None, formatting: str | None) -> Iterator[tuple[Any, int]]:
    """What the function gets, with the number of rows in it."""
    if batch_size is None and formatting != "arrow":
        for batch in batches:
            for row in batch.to_pylist():
                yield row, 1
        return
    for batch in rebatched(batches, 1 if batch_size is None else batch_size):
        yield (pa.Table.from_batches([batch]) if formatting == "arrow" else batch.to_pydict()), batch.num_rows


def consume(df: DataFrame, fn: Callable[[Any], Any], batch_size: int | None = None, formatting: str | None = None, on_start: Callable[[], Any] = _nothing, on_finish: Callable[[], Any] = _nothing, on_error: str = "fail") -> DataFrame:
    """One status row per partition: rows done, seconds (waiting for input: stream; making the items that
    fn gets: transform; inside fn: finalize, also as secs), what failed.  Lazy.

    fn gets a dictionary per row, a dictionary of lists per batch_size rows, or with formatting
    "arrow" a pyarrow table.  on_start and on_finish run once for each partition, on_finish after
    errors too.  on_error "fail" ends the job; "skip_batch" counts what fails and goes on, with the
    first error kept; "skip_rest" counts the item that fails and leaves the rest of its partition, whose
    rows are not counted, as other partitions go on.  A task that Spark runs again repeats what fn does."""
    if on_error not in ("fail", "skip_batch", "skip_rest"):
        raise ValueError("on_error is fail, skip_batch or skip_rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = rows = bad = bad_rows = 0
        secs, error = 0.0, None
        stream = Timed(batches)
        items = Timed(_items(stream, batch_size, formatting))
        on_start()
        try:
            for item, n in items:
                begun = time.perf_counter()
                try:
                    fn(item)
                    done, rows = done + 1, rows + n
                except Exception as e:
                    if on_error == "fail":
                        raise
                    bad, bad_rows, error = bad + 1, bad_rows + n, error or f"{type(e).__name__}: {e}"
                    if on_error == "skip_rest":
                        break
                secs += time.perf_counter() - begun
        finally:
            on_finish()
        row = [TaskContext.get().partitionId(), done, rows, secs, stream.total_time, max(0.0, items.total_time - stream.total_time), secs, bad, bad_rows, error]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], _NAMES)

    return df.mapInArrow(run, STATUS)


def spread(df: DataFrame, num_proc: int) -> DataFrame:
    """At least num_proc partitions; a table that has them is left alone."""
    return df.repartition(num_proc) if df.rdd.getNumPartitions() < num_proc else df


class DatasetConsumer:
    """Consumes a table in num_proc partitions or more, with hooks and progress."""

    def __init__(self, num_proc: int | None = None, prefetch_factor: int = 128, on_start: Callable[[], Any] = _nothing, on_finish: Callable[[], Any] = _nothing, progress_report_interval: float = 0.5, disable_tqdm: bool = False, callbacks: list[Callback] | None = None, on_error: str = "fail"):
        self.num_proc = num_proc or os.cpu_count() or 1
        self.prefetch_factor, self.on_start, self.on_finish, self.on_error = prefetch_factor, on_start, on_finish, on_error
        self.callbacks = list(callbacks or [])
        if not disable_tqdm:
            self.callbacks.append(TqdmReporterCallback(progress_report_interval))

    def consume(self, ds: DataFrame, finalizer: Callable[[Any], Any] = lambda x: x, batch_size: int | None = None, formatting: str | None = None) -> list[Any]:
        """Run it; returns the status rows, one per partition.  Callbacks hear of shards while they
        run.  An error or an interrupt cancels the job, and shards that have not ended count as canceled."""
        df = spread(ds, self.num_proc)
        parts = df.rdd.getNumPartitions()
        monitor, manager = ProgressMonitor(parts, min(parts, self.num_proc)), CallbackManager(self.callbacks)
        manager.on_start(monitor, ds)
        try:
            with Watch(ds.sparkSession, monitor, manager) as watch:
                rows = watch.run(consume(df, finalizer, batch_size, formatting, self.on_start, self.on_finish, self.on_error).collect)
                watch.finish(rows)
        finally:
            monitor.stopping()
            manager.on_stopping(monitor)
            monitor.done()
            manager.on_done(monitor)
        return rows
