"""Progress: what runs, what is done, how fast; and who is told.

Spark schedules the work, so a worker here is a task, which reads, transforms and finalizes its own
partition (the standalone role), and a shard is a partition.  `Watch` follows the tasks of an action
while it runs; what they return in the end is the truth.  All of this lives on the driver.
"""

from __future__ import annotations

import math
import sys
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark import InheritableThread

from ..functions.averages import EMA, TimeWeightedEMA

STAGES = ("stream", "transform", "finalize")
#: Averages of stages: the half-life is a second.
_HALF = math.log(2)


class WorkerRole(str, Enum):
    STANDALONE = "standalone"
    PRODUCER = "producer"
    CONSUMER = "consumer"


class ShardState(str, Enum):
    PENDING = "pending"
    IN_PROGRESS = "in_progress"
    COMPLETED = "completed"
    CANCELED = "canceled"


@dataclass
class ProgressReport:
    timestamp: float
    elapsed_time: float
    num_samples: int
    average_elapsed_time: dict[str, float] = field(default_factory=dict)
    total_elapsed_time: dict[str, float] = field(default_factory=dict)


class ProgressMonitor:
    """States of shards and workers, rows done, and rates."""

    def __init__(self, num_shards: int, num_workers: int):
        self._shards = [ShardState.PENDING] * num_shards
        self._workers = num_workers
        self._alive: set[int] = set()
        self._roles: dict[int, WorkerRole] = {}
        self._at: dict[int, int] = {}
        self._samples: Counter[WorkerRole] = Counter()
        self._rates = {role: (EMA(0.3), EMA(0.3)) for role in WorkerRole}  # rows by report, seconds by report
        now = time.time()
        self._reported = dict.fromkeys(WorkerRole, now)
        self._times: dict[tuple[int, str], TimeWeightedEMA] = {}
        self._stopping, self._done = threading.Event(), threading.Event()

    num_shards = property(lambda self: len(self._shards))
    num_workers = property(lambda self: self._workers)
    is_stopping = property(lambda self: self._stopping.is_set())
    is_done = property(lambda self: self._done.is_set())

    def _with(self, state: ShardState) -> set[int]:
        return {k for k, s in enumerate(self._shards) if s is state}

    pending_shards = property(lambda self: self._with(ShardState.PENDING))
    completed_shards = property(lambda self: self._with(ShardState.COMPLETED))
    canceled_shards = property(lambda self: self._with(ShardState.CANCELED))
    any_pending_shards = property(lambda self: bool(self.pending_shards))
    any_worker_alive = property(lambda self: bool(self._alive))
    alive_workers = property(lambda self: set(self._alive))
    busy_workers = property(lambda self: set(self._roles))
    idle_workers = property(lambda self: set(range(self._workers)) - self._roles.keys(), doc="Ranks without a role.")
    num_buffered_samples = property(lambda self: 0, doc="There is no queue between tasks.")
    num_processed_samples = property(lambda self: self._samples[WorkerRole.STANDALONE] + self._samples[WorkerRole.CONSUMER], doc="What producers hand on is counted where it is consumed.")

    def get_worker_shard(self, rank: int) -> int | None:
        return self._at.get(rank)

    def get_worker_role(self, rank: int) -> WorkerRole | None:
        return self._roles.get(rank)

    def get_workers_with_role(self, role: WorkerRole) -> set[int]:
        return {rank for rank, own in self._roles.items() if own is role}

    def role_counts(self) -> dict[WorkerRole, int]:
        """How many workers have each role."""
        found = Counter(self._roles.values())
        return {role: found[role] for role in WorkerRole}

    @property
    def samples_per_second(self) -> float:
        return self.throughput(time.time())

    def throughput(self, now: float) -> float:
        """Rows by report over seconds by report, both averaged for each role, the time since its last
        report counted as if it were the next; of those that finish rows."""
        total = 0.0
        for role in (WorkerRole.STANDALONE, WorkerRole.CONSUMER):
            rows, seconds = self._rates[role]
            total += rows.value / max(seconds.peek(now - self._reported[role]), 1e-5)
        return total

    def elapsed_time_averages(self, ranks: Iterable[int] | None = None) -> dict[str, float]:
        """For each stage, the averages of the workers, folded in the order of their last reports."""
        chosen = None if ranks is None else set(ranks)
        out = {}
        for stage in STAGES:
            own = [x for (rank, of), x in self._times.items() if of == stage and (chosen is None or rank in chosen)]
            fold = TimeWeightedEMA(_HALF)
            for x in sorted(own, key=lambda x: x.timestamp):
                fold.update(x.value, x.timestamp)
            out[stage] = fold.value
        return out

    def report(self, rank: int, report: ProgressReport) -> None:
        """Takes in what a worker has done since its last report; one without a role counts as standalone."""
        role = self._roles.get(rank, WorkerRole.STANDALONE)
        for stage, seconds in report.average_elapsed_time.items():
            self._times.setdefault((rank, stage), TimeWeightedEMA(_HALF)).update(seconds, report.timestamp)
        self._samples[role] += report.num_samples
        rows, seconds = self._rates[role]
        rows.update(report.num_samples)
        seconds.update(report.timestamp - self._reported[role])
        self._reported[role] = report.timestamp

    def worker_ready(self, rank: int) -> None:
        self._alive.add(rank)

    def worker_done(self, rank: int) -> None:
        if rank in self._roles:
            raise AssertionError("a busy worker is not done")
        self._alive.discard(rank)

    def worker_idling(self, rank: int) -> None:
        if rank not in self._alive:
            raise AssertionError("only a worker that is alive can idle")
        self._roles.pop(rank, None)

    def worker_busy(self, rank: int, shard: int | None = None, role: WorkerRole = WorkerRole.STANDALONE) -> None:
        if rank not in self._alive:
            raise AssertionError("only a worker that is alive gets a shard")
        self._roles[rank] = role
        if shard is not None:
            self._at[rank], self._shards[shard] = shard, ShardState.IN_PROGRESS

    def worker_completed(self, rank: int) -> None:
        """The worker's shard is done, if it has one, and it has no role any more."""
        if (shard := self._at.pop(rank, None)) is not None:
            self._shards[shard] = ShardState.COMPLETED
        self._roles.pop(rank, None)

    def worker_canceled(self, rank: int) -> None:
        if (shard := self._at.pop(rank, None)) is not None:
            self._shards[shard] = ShardState.CANCELED
        self._roles.pop(rank, None)

    def shard_in_progress(self, shard: int) -> None:
        self._shards[shard] = ShardState.IN_PROGRESS

    def shard_completed(self, shard: int) -> None:
        self._shards[shard] = ShardState.COMPLETED

    def shard_canceled(self, shard: int) -> None:
        self._shards[shard] = ShardState.CANCELED

    def stopping(self) -> None:
        self._stopping.set()

    def done(self) -> None:
        self._done.set()


class Callback:
    """Hooks that do nothing unless overridden.  They run on the driver, one at a time."""

    def on_start(self, monitor: ProgressMonitor, ds: Any) -> None: ...

    def on_shard_in_progress(self, monitor: ProgressMonitor, shard_id: int) -> None: ...

    def on_shard_completed(self, monitor: ProgressMonitor, shard_id: int) -> None: ...

    def on_shard_canceled(self, monitor: ProgressMonitor, shard_id: int) -> None: ...

    def on_stopping(self, monitor: ProgressMonitor) -> None: ...

    def on_done(self, monitor: ProgressMonitor) -> None: ...


class CallbackManager(Callback):
    """Tells each callback, in order."""

    def __init__(self, callbacks: list[Callback]):
        self.callbacks = list(callbacks)

    def _tell(self, hook: str, *args: Any) -> None:
        for callback in self.callbacks:
            getattr(callback, hook)(*args)

    def on_start(self, monitor: ProgressMonitor, ds: Any) -> None:
        self._tell("on_start", monitor, ds)

    def on_shard_in_progress(self, monitor: ProgressMonitor, shard_id: int) -> None:
        self._tell("on_shard_in_progress", monitor, shard_id)

    def on_shard_completed(self, monitor: ProgressMonitor, shard_id: int) -> None:
        self._tell("on_shard_completed", monitor, shard_id)

    def on_shard_canceled(self, monitor: ProgressMonitor, shard_id: int) -> None:
        self._tell("on_shard_canceled", monitor, shard_id)

    def on_stopping(self, monitor: ProgressMonitor) -> None:
        self._tell("on_stopping", monitor)

    def on_done(self, monitor: ProgressMonitor) -> None:
        self._tell("on_done", monitor)


class _TextBar:
    """As much of a tqdm bar as the reporter needs, where tqdm is not installed: one line, rewritten."""

    def __init__(self, total: int, desc: str = "", unit: str = "it", file: Any = None, disable: bool = False, **_: Any):
        self.total, self.desc, self.unit, self.file, self.disable = total, desc, unit, file, disable
        self.n, self.postfix = 0, ""

    def set_postfix_str(self, text: str, refresh: bool = True) -> None:
        self.postfix = text

    def set_description(self, text: str, refresh: bool = True) -> None:
        self.desc = text

    def update(self, n: int) -> None:
        self.n += n
        self._write()

    def _write(self, end: str = "") -> None:
        if not self.disable:
            out = self.file or sys.stderr
            out.write(f"\r{self.desc}: {self.n}/{self.total} {self.unit}, {self.postfix}{end}")
            out.flush()

    def close(self) -> None:
        self._write("\n")


def _bar(**options: Any) -> Any:
    try:
        from tqdm.auto import tqdm
    except ModuleNotFoundError:
        return _TextBar(**options)
    return tqdm(**options)


class TqdmReporterCallback(Callback):
    """A bar of shards with rows, rate and workers by role, renewed by a thread while the work goes on.
    Further arguments are those of the bar (`ncols`, `file`, `disable`, ...)."""

    def __init__(self, update_interval: float = 0.1, **tqdm_kwargs: Any):
        self.update_interval, self.options = update_interval, tqdm_kwargs
        self._thread: threading.Thread | None = None
        self._end = threading.Event()

    @staticmethod
    def description(monitor: ProgressMonitor) -> str:
        roles = monitor.role_counts()
        return f"Workers {len(monitor.alive_workers)}/{monitor.num_workers} (S={roles[WorkerRole.STANDALONE]}, P={roles[WorkerRole.PRODUCER]}, C={roles[WorkerRole.CONSUMER]})"

    @staticmethod
    def postfix(monitor: ProgressMonitor) -> str:
        rows = monitor.num_processed_samples
        return f"{monitor.num_buffered_samples}q, {monitor.samples_per_second:.2f}ex/s, {rows if rows < 10**6 else f'{rows:.2e}'}ex"

    def _renew(self, bar: Any, monitor: ProgressMonitor) -> None:
        bar.set_postfix_str(self.postfix(monitor), refresh=False)
        bar.set_description(self.description(monitor), refresh=True)
        bar.update(len(monitor.completed_shards) - bar.n)

    def on_start(self, monitor: ProgressMonitor, ds: Any) -> None:
        bar = _bar(total=monitor.num_shards, desc=self.description(monitor), unit="sh", **self.options)

        def run() -> None:
            while not self._end.wait(self.update_interval):
                self._renew(bar, monitor)
            self._renew(bar, monitor)
            bar.close()

        self._end.clear()
        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def on_done(self, monitor: ProgressMonitor) -> None:
        self._end.set()
        if self._thread is not None:
            self._thread.join()
            self._thread = None


class Watch:
    """Follows an action of Spark while it runs, and cancels it if it is left by an error.

    Jobs of the action carry a tag.  A thread asks Spark's status store which tasks of the stage with
    a task for every shard run or have ended, and tells; for stages of more than MOST_TASKS tasks, of
    which asking would take long, all is told at the end.  `finish` tells what is still untold, from
    the status rows, which alone have rows and seconds."""

    MOST_TASKS = 2000

    def __init__(self, spark: Any, monitor: ProgressMonitor, manager: Callback, interval: float = 0.1):
        self.spark, self.monitor, self.manager, self.interval = spark, monitor, manager, interval
        self.tag, self.started = f"sluiceway-{uuid.uuid4().hex}", time.time()
        self._begun: set[int] = set()
        self._ended: set[int] = set()
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._follow, daemon=True)

    def __enter__(self) -> Watch:
        self.spark.sparkContext.addJobTag(self.tag)
        self._thread.start()
        return self

    def __exit__(self, kind: Any, error: Any, trace: Any) -> None:
        context = self.spark.sparkContext
        if kind is not None:
            context.cancelJobsWithTag(self.tag)
        context.removeJobTag(self.tag)
        self._over.set()
        self._thread.join()
        if kind is not None:
            for shard in range(self.monitor.num_shards):
                if shard not in self._ended:
                    if self.monitor.get_worker_shard(shard) is not None:
                        self.monitor.worker_canceled(shard)
                    self.monitor.shard_canceled(shard)
                    self.manager.on_shard_canceled(self.monitor, shard)

    def run(self, action: Callable[[], Any]) -> Any:
        """What the action returns.  It runs in a thread of its own, so that an interrupt does not meet
        this one in the midst of a call to Spark."""
        out: list[Any] = []
        errors: list[BaseException] = []

        def body() -> None:
            try:
                # sources are looked up in the session that is active in the thread
                self.spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(self.spark._jsparkSession)
                out.append(action())
            except BaseException as e:
                errors.append(e)

        thread = InheritableThread(target=body, daemon=True)
        thread.start()
        while thread.is_alive():
            thread.join(0.2)
        if errors:
            raise errors[0]
        return out[0]

    def _follow(self) -> None:
        while not self._over.wait(self.interval):
            try:
                running, ended = self._tasks()
            except Exception:  # what is shown meanwhile must not end the work: the store is not public, and it forgets old stages
                return
            for shard in sorted(running | ended):
                self._begin(shard)
            for shard in sorted(ended):
                self._end(shard)

    def _tasks(self) -> tuple[set[int], set[int]]:
        """Partitions of which a task runs, and those of which one has ended well."""
        context = self.spark.sparkContext._jsc.sc()
        jobs, running, ended = list(context.statusTracker().getJobIdsForTag(self.tag)), set(), set()
        info = self.spark.sparkContext.statusTracker().getJobInfo(max(jobs)) if jobs else None
        stage = max(info.stageIds) if info is not None and info.stageIds else None
        seen = self.spark.sparkContext.statusTracker().getStageInfo(stage) if stage is not None else None
        if seen is None or seen.numTasks != self.monitor.num_shards or seen.numTasks > self.MOST_TASKS:
            return running, ended
        tasks = context.statusStore().taskList(stage, seen.currentAttemptId, self.MOST_TASKS)
        for k in range(tasks.size()):
            task = tasks.apply(k)
            if (state := task.status()) in ("RUNNING", "SUCCESS"):
                (running if state == "RUNNING" else ended).add(task.partitionId())
        return running, ended

    def _begin(self, shard: int) -> None:
        if shard not in self._begun:
            self._begun.add(shard)
            self.monitor.worker_ready(shard)
            self.monitor.worker_busy(shard, shard)
            self.manager.on_shard_in_progress(self.monitor, shard)

    def _end(self, shard: int) -> None:
        if shard not in self._ended:
            self._ended.add(shard)
            self.monitor.worker_completed(shard)
            self.manager.on_shard_completed(self.monitor, shard)
            self.monitor.worker_done(shard)

    def finish(self, rows: list[Any]) -> None:
        """Tell of every shard that is still to be told of, and take in what its task reports: rows, and
        seconds in all (`secs`) or by stage (`stream`, `transform`, `finalize`)."""
        self._over.set()
        self._thread.join()
        for r in sorted(rows, key=lambda r: r.partition):
            self._begin(r.partition)
            total = {stage: seconds for stage in STAGES if (seconds := getattr(r, stage, None)) is not None} or {"finalize": r.secs}
            self.monitor.report(r.partition, ProgressReport(max(time.time(), self.started + 1e-6), sum(total.values()), r.rows, {k: x / r.rows if r.rows else 0.0 for k, x in total.items()}, total))
            self._end(r.partition)
