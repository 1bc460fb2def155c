"""Queries that use writers, consumers and callbacks as a program would, over whole tables.

What they return is a row for each event, file or task, or the table that was written."""

from __future__ import annotations

import json
import os
import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.averages import time_weighted_ema
from ..functions.compose import RunAll, chdir
from ..functions.sizes import parse_size
from ..operators.consume import DatasetConsumer, Timed, consume, spread
from ..operators.progress import STAGES, Callback, CallbackManager, ProgressMonitor, ProgressReport, WorkerRole
from ..operators.sharding import ShardingController, ShardingStrategy
from ..sources import files
from ..sources.shards import ArrowDatasetWriter, BaseDatasetWriter, JsonDatasetWriter, read_shards


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _new_folder(spark: SparkSession) -> str:
    from .queries import scratch

    return scratch(spark)


class Tally(Callback):
    """Counts what it hears, by event."""

    def __init__(self) -> None:
        self.heard: Counter[str] = Counter()

    def on_start(self, monitor: ProgressMonitor, ds: DataFrame) -> None:
        self.heard["start"] += 1

    def on_shard_in_progress(self, monitor: ProgressMonitor, shard_id: int) -> None:
        self.heard["shard_in_progress"] += 1

    def on_shard_completed(self, monitor: ProgressMonitor, shard_id: int) -> None:
        self.heard["shard_completed"] += 1

    def on_shard_canceled(self, monitor: ProgressMonitor, shard_id: int) -> None:
        self.heard["shard_canceled"] += 1

    def on_stopping(self, monitor: ProgressMonitor) -> None:
        self.heard["stopping"] += 1

    def on_done(self, monitor: ProgressMonitor) -> None:
        self.heard["done"] += 1
        self.heard["samples"] = monitor.num_processed_samples
        self.heard["shards_left"] = len(monitor.pending_shards) + len(monitor.busy_workers)


def _tallied(spark: SparkSession, tally: Tally) -> DataFrame:
    return spark.createDataFrame(sorted(tally.heard.items()), "event string, n long")


def consumer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What callbacks hear while orders are consumed in three shards, by way of a manager."""
    tally = Tally()
    orders = _table(spark, sf_dir, "orders").select("o_orderkey").repartition(3)
    DatasetConsumer(num_proc=3, disable_tqdm=True, callbacks=[CallbackManager([tally])]).consume(orders, lambda batch: None, 1000, "arrow")
    return _tallied(spark, tally)


def consumer_events_of_a_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the function fails: the job is canceled, and so is its shard."""
    tally = Tally()

    def refuse(row: dict) -> None:
        raise ValueError(row["n_name"])

    try:
        DatasetConsumer(num_proc=1, disable_tqdm=True, callbacks=[tally]).consume(_table(spark, sf_dir, "nation").coalesce(1), refuse)
    except Exception:
        tally.heard["raised"] += 1
    tally.heard.pop("shard_in_progress", None)  # it may fail before it is seen to run
    return _tallied(spark, tally)


def consumer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches and rows by the shards of a split source, and whether their stages were timed."""
    parts = spread(_table(spark, sf_dir, "supplier").coalesce(1), 4)
    rows = DatasetConsumer(num_proc=4, disable_tqdm=True).consume(parts, lambda batch: None, 10**9, "arrow")
    timed = all(r[stage] >= 0 for r in rows for stage in STAGES)
    return spark.createDataFrame([(len(rows), sum(r.batches for r in rows), sum(r.rows for r in rows), timed)], "shards int, batches long, rows long, timed boolean")


def consume_skip_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard is left at the first row that fails."""

    def refuse(row: dict) -> None:
        if row["n_nationkey"] == 7:
            raise ValueError("seven")

    status = consume(_table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey"), refuse, on_error="skip_rest")
    return status.select("rows", "failed_rows", "error")


def hooks_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks run once a shard, in the folder that they are given: files that they leave."""
    folder = _new_folder(spark).removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def leave(kind: str) -> Callable[[], None]:
        def run() -> None:
            from pyspark import TaskContext

            with chdir(folder), open(f"{kind}-{TaskContext.get().partitionId()}", "w") as out:
                out.write(kind)

        return run

    DatasetConsumer(num_proc=3, disable_tqdm=True, on_start=RunAll(leave("start"), leave("also")), on_finish=leave("finish")).consume(_table(spark, sf_dir, "region").repartition(3), lambda row: None)
    found = Counter(name.partition("-")[0] for name in os.listdir(folder))
    return spark.createDataFrame(sorted(found.items()), "hook string, n long")


class Plain(BaseDatasetWriter):
    """A format of one's own, in plain Python: a JSON list for each row."""

    extension = "rows"

    def initialize(self, info) -> None:
        self.begun = info.schema.names

    def initialize_shard(self, path: str, info) -> None:
        self._file, self._names = files.open_write(path), info.schema.names

    def write_batch_py(self, batch: dict[str, list]) -> int:
        rows = list(zip(*(batch[name] for name in self._names), strict=True))
        return self._file.write("".join(json.dumps(r, default=str) + "\n" for r in rows).encode())

    def finalize_shard(self, info) -> None:
        self._file.close()


def sink_own_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by a format that takes Python batches alone, and read as text."""
    path = _new_folder(spark)
    writer = Plain(path, disable_tqdm=True)
    manifest = writer.write(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    lines = spark.read.text([f"{writer.save_dir}/{s['file']}" for s in manifest])
    fields = F.from_json("value", "array<string>")
    return lines.select(fields[0].cast("long").alias("n_nationkey"), fields[1].alias("n_name"), F.lit(",".join(writer.begun)).alias("columns"), F.lit(",".join(Plain.SUPPORTED_FORMATS)).alias("formats"))


def sink_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that is there is refused, then written over."""
    path, refused = _new_folder(spark), False
    ArrowDatasetWriter(path, disable_tqdm=True).write(_table(spark, sf_dir, "customer").select("c_custkey"))
    try:
        ArrowDatasetWriter(path, disable_tqdm=True).write(_table(spark, sf_dir, "region"))
    except FileExistsError:
        refused = True
    JsonDatasetWriter(path, overwrite=True, disable_tqdm=True).write(_table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return read_shards(spark, path).withColumn("refused", F.lit(refused))


def sink_shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and rows of files by count: numbers run over all, in the order of the rows."""
    part = _table(spark, sf_dir, "part").select("p_partkey").coalesce(1)
    manifest = ArrowDatasetWriter(_new_folder(spark), disable_tqdm=True, sharding_strategy=ShardingStrategy.SAMPLE_COUNT, max_shard_size=300, write_batch_size=100).write(part)
    return spark.createDataFrame([(s["file"], s["rows"]) for s in manifest], "file string, rows long")


def sink_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally = Tally()
    ArrowDatasetWriter(_new_folder(spark), num_proc=2, disable_tqdm=True, callbacks=[tally]).write(_table(spark, sf_dir, "supplier").coalesce(1))
    return _tallied(spark, tally)


def sharding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which settings are refused, which limits are in force, and a shard from its beginning to its end."""
    import warnings

    def outcome(*args) -> str:
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            try:
                made = ShardingController(*args)
            except ValueError:
                return "refused"
        return ("warned, " if said else "") + ("active" if made.is_active else "inactive") + f", {made.limit}"

    cases = {
        "size": ("file_size", "2KB"), "size by default": ("file_size", None), "rows": ("sample_count", 5), "rows as text": ("sample_count", "5MB"), "rows without limit": ("sample_count", None),
        "sum": ("sample_item", 9, "n"), "sum of nothing": ("sample_item", 9), "none": ("none", 5), "key of no use": ("sample_count", 5, "n"),
    }
    found = [(name, outcome(*args)) for name, args in cases.items()]
    shard = ShardingController("file_size", parse_size("1KB"))
    shard.initialize()
    shard.update(1, 0, 1000)
    before = shard.full()
    shard.update(1, 0, 24)
    found.append(("full", f"{before}, {shard.full()}"))
    shard.finalize()
    found.append(("closed", str(shard.open)))
    return spark.createDataFrame(found, "setting string, outcome string")


def monitor_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a monitor makes of reports, one a region: rates, rows by role, states."""
    m, keys = ProgressMonitor(5, 6), [r.r_regionkey for r in _table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").toLocalIterator()]
    began = m._reported[WorkerRole.STANDALONE]
    for k in keys:
        m.worker_ready(k)
        m.worker_busy(k, k, WorkerRole.PRODUCER if k == 4 else WorkerRole.STANDALONE)
        m.report(k, ProgressReport(began + 1 + k, 1.0, 100, {"stream": 0.5, "transform": 0.25, "finalize": 0.125 * (k + 1)}))
    rows = [("rate", m.throughput(began + 4)), ("samples", float(m.num_processed_samples)), ("buffered", float(m.num_buffered_samples)), *m.elapsed_time_averages([0, 1]).items()]
    rows += [(role.value, float(n)) for role, n in m.role_counts().items()]
    m.worker_completed(0)
    m.worker_canceled(1)
    rows += [("completed", float(len(m.completed_shards))), ("canceled", float(len(m.canceled_shards))), ("idle", float(len(m.idle_workers))), ("alive", float(len(m.alive_workers)))]
    return spark.createDataFrame([(k, round(v, 6)) for k, v in rows], "what string, value double")


def timed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An iterator that counts the seconds that its source takes."""
    wait = threading.Event()
    names = Timed(wait.wait(0.002) or r.n_name for r in _table(spark, sf_dir, "nation").toLocalIterator())
    n = sum(1 for _ in names)
    return spark.createDataFrame([(n, names.total_time >= 0.002 * n, names.smooth_time >= 0.002)], "n long, total boolean, smooth boolean")


def stage_time_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of stages from reports of workers: for each stage (event type), every worker's (user's)
    average weighed by time, then those in the order of the workers' last reports, as a monitor folds them."""
    events = _table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    own = time_weighted_ema(events, ["event_type", "user_id"], ["ts", "event_id"], F.col("at"), "value", 0.0001).withColumnRenamed("ema", "x")
    last = events.groupBy("event_type", "user_id").agg(F.max("at").alias("last"))
    both = own.join(last, ["event_type", "user_id"])
    return time_weighted_ema(both, ["event_type"], ["last", "user_id"], F.col("last"), "x", 0.0001).select("event_type", F.round("ema", 6).alias("average"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (consumer_events, consumer_events_of_a_failure, consumer_status, consume_skip_rest, hooks_by_shard, sink_own_format, sink_overwrite, sink_shard_names, sink_events, sharding_rules, monitor_of_reports, timed_stream, stage_time_averages)
}

ORACLE_SQL: dict[str, str] = {
    "consumer_events": "SELECT * FROM (VALUES ('start', 1), ('shard_in_progress', 3), ('shard_completed', 3), ('stopping', 1), ('done', 1), ('shards_left', 0)) AS t(event, n) UNION ALL SELECT 'samples', count(*) FROM orders",
    "consumer_events_of_a_failure": "SELECT * FROM (VALUES ('start', CAST(1 AS BIGINT)), ('shard_canceled', 1), ('stopping', 1), ('done', 1), ('samples', 0), ('shards_left', 0), ('raised', 1)) AS t(event, n)",
    "consumer_status": "SELECT CAST(4 AS INT) AS shards, CAST(4 AS BIGINT) AS batches, count(*) AS rows, true AS timed FROM supplier",
    "consume_skip_rest": "SELECT count(*) FILTER (WHERE n_nationkey < 7) AS rows, count(*) FILTER (WHERE n_nationkey = 7) AS failed_rows, 'ValueError: seven' AS error FROM nation",
    "hooks_by_shard": "SELECT * FROM (VALUES ('start', CAST(3 AS BIGINT)), ('also', 3), ('finish', 3)) AS t(hook, n)",
    "sink_own_format": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, 'n_nationkey,n_name' AS columns, 'python' AS formats FROM nation",
    "sink_overwrite": "SELECT r_regionkey, r_name, true AS refused FROM region",
    "sink_shard_names": "SELECT 'shard-' || lpad(CAST(k AS VARCHAR), 5, '0') || '.arrow' AS file, least(300, n - 300 * k) AS rows FROM (SELECT n, unnest(range(0, (n + 299) // 300)) AS k FROM (SELECT count(*) AS n FROM part))",
    "sink_events": "SELECT * FROM (VALUES ('start', 1), ('shard_in_progress', 2), ('shard_completed', 2), ('stopping', 1), ('done', 1), ('shards_left', 0)) AS t(event, n) UNION ALL SELECT 'samples', count(*) FROM supplier",
    "sharding_rules": """SELECT * FROM (VALUES ('size', 'active, 2048'), ('size by default', 'active, 5368709120'), ('rows', 'active, 5'), ('rows as text', 'refused'), ('rows without limit', 'inactive, None'),
  ('sum', 'active, 9'), ('sum of nothing', 'refused'), ('none', 'inactive, 5'), ('key of no use', 'warned, active, 5'), ('full', 'False, True'), ('closed', 'False')) AS t(setting, outcome)""",
    # three reports of 100 rows a second apart of which the last came a second before, and so on by hand
    "monitor_of_reports": """
WITH RECURSIVE s AS (SELECT 1 AS n, CAST(100 AS DOUBLE) AS rows, CAST(1 AS DOUBLE) AS secs UNION ALL SELECT n + 1, 0.3 * 100 + 0.7 * rows, 0.3 * 1 + 0.7 * secs FROM s WHERE n < (SELECT count(*) - 1 FROM region)),
l AS (SELECT * FROM s ORDER BY n DESC LIMIT 1)
SELECT what, round(CAST(value AS DOUBLE), 6) AS value FROM (
  SELECT 'rate' AS what, (rows / (1 - power(0.7, n))) / greatest((0.3 * 0 + 0.7 * secs) / (1 - power(0.7, n + 1)), 1e-5) AS value FROM l
  UNION ALL SELECT 'samples', 100 * (SELECT count(*) - 1 FROM region)
  UNION ALL SELECT * FROM (VALUES ('buffered', 0), ('stream', 0.5), ('transform', 0.25), ('finalize', 0.5 * 0.25 + 0.5 * 0.125), ('standalone', 4), ('producer', 1), ('consumer', 0), ('completed', 1), ('canceled', 1), ('idle', 3), ('alive', 5)) AS t(what, value))""",
    "timed_stream": "SELECT count(*) AS n, true AS total, true AS smooth FROM nation",
    "stage_time_averages": """
WITH w AS (
  SELECT event_type, user_id, list_reduce(list({'x': value, 's': epoch_us(ts) / 1e6} ORDER BY ts, event_id),
    lambda a, b: {'x': exp(-0.0001 * (b.s - a.s)) * b.x + (1 - exp(-0.0001 * (b.s - a.s))) * a.x, 's': b.s}) AS r
  FROM events GROUP BY event_type, user_id)
SELECT event_type, round(list_reduce(list(r ORDER BY r.s, user_id),
  lambda a, b: {'x': exp(-0.0001 * (b.s - a.s)) * b.x + (1 - exp(-0.0001 * (b.s - a.s))) * a.x, 's': b.s}).x, 6) AS average
FROM w GROUP BY event_type""",
}
