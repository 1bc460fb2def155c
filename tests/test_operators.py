import io
import logging
import time

import pyarrow as pa
import pytest

from sluiceway import DatasetConsumer, ShardingStrategy, setup_logging
from sluiceway.operators import transforms as t
from sluiceway.operators.consume import consume
from sluiceway.operators.progress import Callback, CallbackManager, ProgressMonitor, ProgressReport, TqdmReporterCallback, WorkerRole
from sluiceway.operators.sharding import ShardingController, shards_by_count, shards_by_item

README = [(0, [1, 2, 3, 4]), (1, [5, 6]), (1, [7, 8, 9, 10])]


def test_flagship(spark):
    df = spark.createDataFrame(README, "a long, b array<long>")
    rows = t.map_rows(df, lambda x: {"max(b)": max(x["b"])}, "a long, b array<long>, `max(b)` long").collect()
    assert sorted(r["max(b)"] for r in rows) == [4, 6, 10]


@pytest.mark.parametrize(("size", "drop", "sizes"), [(8, False, [8, 8, 4]), (8, True, [8, 8]), (None, False, [20]), (0, True, [20]), (20, True, [20]), (30, True, []), (7, False, [7, 7, 6])])
def test_rebatch(size, drop, sizes):
    for cut in (1, 3, 20):
        batches = [pa.record_batch({"n": list(range(k, min(20, k + cut)))}) for k in range(0, 20, cut)]
        out = list(t.rebatched(iter(batches), size, drop))
        assert [b.num_rows for b in out] == sizes
        assert [x for b in out for x in b.column(0).to_pylist()] == list(range(sum(sizes)))
    assert list(t.rebatched(iter([]), size, drop)) == []


def test_row_order_operators(spark):
    df = spark.range(100).repartition(7)
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(t.skip(df, 90, "id")) == list(range(90, 100))
    assert ids(t.take(df, 5, "id")) == [0, 1, 2, 3, 4]
    assert ids(t.step(df, 30, "id", 5)) == [5, 35, 65, 95]
    assert ids(t.shuffle(df, 3)) == list(range(100))
    assert [r["count"] for r in t.batch_ids(df, 30, "id").groupBy("batch").count().orderBy("batch").collect()] == [30, 30, 30, 10]
    assert t.batch_ids(df, 30, "id", drop_last=True).count() == 90
    assert t.step(spark.range(0), 3, "id").count() == 0


def test_map_filter_cast(spark):
    df = spark.range(10)
    out = t.map_batches(df, lambda b: {"id": b["id"] + b["id"]}, "id long", 4, "python")
    assert out.count() == 20
    pipe = t.Pipeline(lambda d: t.filter_rows(d, lambda r: r["id"] > 2), lambda d: t.filter_rows(d, "id < 8"))
    assert [r.id for r in pipe(df).orderBy("id").collect()] == [3, 4, 5, 6, 7]
    assert pipe.copy().steps == pipe.steps and str(t.Pipeline()) == "nothing"
    with pytest.raises(ValueError):
        t.cast_to(df, "other long")
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow"):
        t.cast_to(spark.createDataFrame([(300,)], "id long"), "id tinyint").collect()


def test_native_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).withColumn("x", t.F.lit(1)).write.parquet(str(tmp_path / "p"))
    plan = t.filter_rows(spark.read.parquet(str(tmp_path / "p")), t.F.col("id") > 3).select("id")._jdf.queryExecution().toString()
    assert "GreaterThan(id,3)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_sharding_controller():
    for strategy, update, fits in ((ShardingStrategy.SAMPLE_COUNT, (1, 0, 0), 8), (ShardingStrategy.SAMPLE_ITEM, (0, 42, 0), 4), (ShardingStrategy.FILE_SIZE, (0, 0, 42), 4)):
        c = ShardingController(strategy, 8 if strategy is ShardingStrategy.SAMPLE_COUNT else 153, "key" if strategy is ShardingStrategy.SAMPLE_ITEM else None)
        for _ in range(3):  # the first batch of a later file counts too
            c.initialize()
            for _ in range(fits):
                assert not c.full()
                c.update(*update)
            assert c.full()
            c.finalize()
    c.finalize()
    c.initialize()
    with pytest.raises(AssertionError):
        c.initialize()
    assert not ShardingController(ShardingStrategy.NONE).is_active
    assert ShardingController(ShardingStrategy.FILE_SIZE).limit == 5 << 30


def test_sharding_validation():
    with pytest.raises(ValueError):
        ShardingController(ShardingStrategy.SAMPLE_ITEM, 5)
    with pytest.raises(ValueError):
        ShardingController(ShardingStrategy.SAMPLE_COUNT, "5GB")
    with pytest.warns(UserWarning):
        ShardingController(ShardingStrategy.FILE_SIZE, "5GB", "key")


def test_shard_queries(spark):
    rows = shards_by_count(spark.range(20).repartition(3), 8, "id").groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in rows] == [8, 8, 4]
    df = spark.createDataFrame([("a", k, 4) for k in range(10)] + [("b", k, None if k == 1 else 10) for k in range(4)], "s string, k int, n int")
    got = [(r.s, r.shard) for r in shards_by_item(df, "s", "k", "n", 10).orderBy("s", "k").collect()]
    assert got == [("a", k // 3) for k in range(10)] + [("b", 0), ("b", 1), ("b", 1), ("b", 2)]


class Recorder(Callback):
    def __init__(self):
        self.seen = []

    def on_start(self, monitor, ds):
        self.seen.append("start")

    def on_shard_in_progress(self, monitor, shard_id):
        self.seen.append(("go", shard_id))

    def on_shard_completed(self, monitor, shard_id):
        self.seen.append(("end", shard_id))

    def on_shard_canceled(self, monitor, shard_id):
        self.seen.append(("no", shard_id))

    def on_stopping(self, monitor):
        self.seen.append("stopping")

    def on_done(self, monitor):
        self.seen.append(("done", monitor.num_processed_samples))


def test_consume(spark):
    rows = consume(spark.range(20).repartition(3), lambda x: None).collect()
    assert sum(r.rows for r in rows) == 20 and {r.partition for r in rows} == {0, 1, 2}
    rows = consume(spark.range(20).coalesce(1), lambda x: None, 8, "arrow").collect()
    assert [(r.batches, r.rows) for r in rows] == [(3, 20)]

    def bad(row):
        if row["id"] == 7:
            raise KeyError("seven")

    row = consume(spark.range(20).coalesce(1), bad, on_error="skip_batch").collect()[0]
    assert (row.rows, row.failed_rows, row.error) == (19, 1, "KeyError: 'seven'")
    row = consume(spark.range(20).coalesce(1), bad, on_error="skip_rest").collect()[0]
    assert (row.rows, row.failed_rows, row.error) == (7, 1, "KeyError: 'seven'")
    with pytest.raises(Exception, match="seven"):
        consume(spark.range(20), bad).collect()
    with pytest.raises(ValueError):
        consume(spark.range(20), bad, on_error="ignore")


def test_hooks_run_once_per_partition(spark, tmp_path):
    def mark(kind):
        def write():
            import uuid

            (tmp_path / f"{kind}-{uuid.uuid4().hex}").touch()

        return write

    consume(spark.range(9).repartition(3), lambda x: None, on_start=mark("start"), on_finish=mark("finish")).collect()
    assert len(list(tmp_path.glob("start-*"))) == len(list(tmp_path.glob("finish-*"))) == 3


def test_consumer_and_callbacks(spark):
    one, two = Recorder(), Recorder()
    DatasetConsumer(num_proc=2, disable_tqdm=True, callbacks=[one, two]).consume(spark.range(10).coalesce(1), lambda b: None, batch_size=4)
    assert one.seen == two.seen and one.seen[0] == "start" and one.seen[-2:] == ["stopping", ("done", 10)]
    assert sorted(one.seen[1:-2]) == [("end", 0), ("end", 1), ("go", 0), ("go", 1)] and all(one.seen.index(("go", k)) < one.seen.index(("end", k)) for k in range(2))

    def fail(x):
        raise RuntimeError("no")

    three = Recorder()
    with pytest.raises(Exception, match="no"):
        DatasetConsumer(num_proc=1, disable_tqdm=True, callbacks=[three]).consume(spark.range(3).coalesce(1), fail)
    assert [x for x in three.seen if x != ("go", 0)] == ["start", ("no", 0), "stopping", ("done", 0)]
    assert [type(c) for c in DatasetConsumer().callbacks] == [TqdmReporterCallback]


def test_monitor():
    m = ProgressMonitor(5, 6)
    for shard in (0, 2):
        m.worker_ready(shard)
        m.worker_busy(shard, shard)
    assert m.busy_workers == {0, 2} and m.get_worker_shard(2) == 2 and m.get_worker_role(2) is WorkerRole.STANDALONE
    m.worker_completed(2)
    assert (m.pending_shards, m.completed_shards, m.idle_workers) == ({1, 3, 4}, {2}, {1, 2, 3, 4, 5})
    with pytest.raises(AssertionError):
        m.worker_done(0)
    with pytest.raises(AssertionError):
        m.worker_busy(5, 1)
    m.worker_canceled(0)
    m.worker_done(0)
    assert m.canceled_shards == {0} and m.alive_workers == {2} and m.get_worker_role(0) is None
    assert not m.is_done and not m.is_stopping
    m.stopping()
    m.done()
    assert m.is_done and m.is_stopping


def test_reports_are_averaged():
    m = ProgressMonitor(5, 6)
    now = m._reported[WorkerRole.STANDALONE]
    m.worker_ready(0)
    m.worker_busy(0)
    m.report(0, ProgressReport(now + 1, 1.0, 100, {"stream": 0.5, "transform": 0.3, "finalize": 0.4}))
    m.report(0, ProgressReport(now + 2, 1.0, 120, {"stream": 0.4, "transform": 0.35, "finalize": 0.1}))
    assert m.num_processed_samples == 220 and m.throughput(now + 3) == pytest.approx(136.5, rel=1e-2)
    assert m.elapsed_time_averages([0]) == pytest.approx({"stream": 0.45, "transform": 0.325, "finalize": 0.25})
    assert m.elapsed_time_averages([1]) == {"stream": 0, "transform": 0, "finalize": 0}
    m.report(1, ProgressReport(now + 3, 1.0, 10, {"stream": 0.9}))
    assert m.elapsed_time_averages()["stream"] == pytest.approx(0.5 * 0.9 + 0.5 * 0.45)


def test_roles():
    m = ProgressMonitor(5, 6)
    for rank, role in ((1, WorkerRole.CONSUMER), (2, WorkerRole.PRODUCER)):
        m.worker_ready(rank)
        m.worker_busy(rank, role=role)
    assert (m.idle_workers, m.busy_workers) == ({0, 3, 4, 5}, {1, 2})
    assert m.get_workers_with_role(WorkerRole.CONSUMER) == {1} and m.get_workers_with_role(WorkerRole.PRODUCER) == {2}
    assert m.role_counts() == {WorkerRole.STANDALONE: 0, WorkerRole.PRODUCER: 1, WorkerRole.CONSUMER: 1}
    m.report(2, ProgressReport(1.0, 1.0, 50))
    m.report(1, ProgressReport(1.0, 1.0, 40))
    assert m.num_processed_samples == 40, "what a producer hands on is counted where it is consumed"
    m.worker_idling(1)
    assert m.get_worker_role(1) is None and m.alive_workers == {1, 2}


def test_reporter():
    out, m = io.StringIO(), ProgressMonitor(3, 2)
    r = TqdmReporterCallback(0.01, file=out)
    m.worker_ready(0)
    m.worker_busy(0, 1)
    CallbackManager([r]).on_start(m, None)
    m.worker_completed(0)
    CallbackManager([r]).on_done(m)
    assert "1/3" in out.getvalue() and "ex/s" in out.getvalue() and out.getvalue().endswith("\n")
    assert TqdmReporterCallback.description(m) == "Workers 1/2 (S=0, P=0, C=0)"
    quiet = io.StringIO()
    r = TqdmReporterCallback(0.01, file=quiet, disable=True)
    r.on_start(m, None)
    r.on_done(m)
    assert quiet.getvalue() == ""


class Live(Callback):
    """What is heard before the job has ended."""

    def __init__(self, spark):
        self.spark, self.heard = spark, []

    def _hear(self, what, shard):
        tracker = self.spark.sparkContext.statusTracker()
        self.heard.append((what, shard, bool(tracker.getActiveJobsIds())))

    def on_shard_in_progress(self, monitor, shard_id):
        self._hear("go", shard_id)

    def on_shard_completed(self, monitor, shard_id):
        self._hear("end", shard_id)


def test_shards_are_heard_of_while_the_job_runs(spark):
    live = Live(spark)

    def slow(row):
        import time

        time.sleep(3.0 if row["id"] == 0 else 0.01)

    rows = DatasetConsumer(num_proc=1, disable_tqdm=True, callbacks=[live]).consume(spark.range(0, 8, 1, 4), slow)
    assert ("go", 0, True) in live.heard and any(what == "end" and active for what, _, active in live.heard)
    assert sorted(x[:2] for x in live.heard) == sorted([(w, k) for w in ("go", "end") for k in range(4)])
    assert all(r.finalize == r.secs and r.stream >= 0 and r.transform >= 0 for r in rows) and max(r.finalize for r in rows) >= 3.0


def test_an_interrupt_cancels_the_job(spark):
    import _thread
    import threading

    seen = Recorder()

    def endless(row):
        import time

        time.sleep(120)

    threading.Timer(4.0, _thread.interrupt_main).start()
    begun = time.time()
    with pytest.raises(KeyboardInterrupt):
        DatasetConsumer(num_proc=1, disable_tqdm=True, callbacks=[seen]).consume(spark.range(2).coalesce(1), endless)
    assert time.time() - begun < 60
    assert seen.seen[0] == "start" and ("no", 0) in seen.seen and seen.seen[-2:] == ["stopping", ("done", 0)]
    for _ in range(100):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_logging(tmp_path):
    logger = setup_logging(logging.INFO, str(tmp_path / "log"))
    logger.info("hello")
    setup_logging()
    assert "INFO sluiceway: hello" in (tmp_path / "log").read_text()


def test_logging_from_the_environment(tmp_path, monkeypatch):
    from sluiceway.operators.logs import setup_from_environment

    monkeypatch.setenv("LOG_LEVEL", "debug")
    monkeypatch.setenv("LOG_FILE", str(tmp_path / "log"))
    setup_from_environment()
    logging.getLogger("sluiceway").debug("deep")
    setup_logging()
    assert "DEBUG sluiceway: deep" in (tmp_path / "log").read_text()
