"""Moving averages: objects for telemetry, and columns for tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class EMA:
    """Exponential average; the first value seeds it, and it is divided by 1 - (1 - a)**n."""

    def __init__(self, smoothing: float = 0.3):
        self.smoothing, self.count, self._state = smoothing, 0, 0.0

    def _after(self, x: float) -> float:
        return x if not self.count else self.smoothing * x + (1 - self.smoothing) * self._state

    def _corrected(self, state: float, count: int) -> float:
        return state / (1 - (1 - self.smoothing) ** count) if count else 0.0

    @property
    def value(self) -> float:
        return self._corrected(self._state, self.count)

    def update(self, x: float) -> None:
        self._state, self.count = self._after(x), self.count + 1

    def peek(self, x: float) -> float:
        """The value after x, which is not taken in."""
        return self._corrected(self._after(x), self.count + 1)

    def __call__(self, x: float) -> float:
        self.update(x)
        return self.value


class TimeWeightedEMA:
    """A new value weighs exp(-rate * seconds since the last one)."""

    def __init__(self, decay_rate: float):
        self.decay_rate, self.timestamp, self._state = decay_rate, None, 0.0

    @property
    def value(self) -> float:
        return self._state

    def update(self, x: float, timestamp: float) -> None:
        if self.timestamp is None:
            self._state = x
        else:
            weight = math.exp(-self.decay_rate * (timestamp - self.timestamp))
            self._state = weight * x + (1 - weight) * self._state
        self.timestamp = timestamp

    def __call__(self, x: float, timestamp: float) -> float:
        self.update(x, timestamp)
        return self.value


def _folded(df: DataFrame, keys: list[str], order: list[str], x: Column, weight: Callable[[Column, Column], Column], seconds: Column) -> DataFrame:
    """keys, n (values) and the state of an average for each key: the first value, then for each one
    weight * value + (1 - weight) * state, where `weight` is of the seconds of a row and of the row before.

    Such steps compose: a stretch of rows turns a state s into left * s + right.  So the rows of a
    key are dealt out by range, each stretch is folded by itself, and one row for each stretch is
    brought together: no task gets all of a key that many rows have.  Null values are left out."""
    rows = df.where(x.isNotNull()).select(*keys, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], x.cast("double").alias("_x"), seconds.cast("double").alias("_t"))
    names = [f"_o{k}" for k in range(len(order))]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *keys, *names).withColumn("_p", F.spark_partition_id())
    ahead = Window.partitionBy("_p", *keys).orderBy(*names)
    after = ahead.rowsBetween(1, Window.unboundedFollowing)
    steps = dealt.withColumn("_k", F.row_number().over(ahead)).withColumn("_w", F.when(F.col("_k") > 1, weight(F.col("_t"), F.lag("_t").over(ahead))))
    # what later rows of the stretch leave of a row: the product of 1 - weight, by logarithms
    gone = F.sum(F.when(F.col("_w") >= 1.0, F.lit(-1e6)).otherwise(F.log1p(-F.col("_w")))).over(after)
    steps = steps.withColumn("_left", F.exp(F.coalesce(gone, F.lit(0.0))))
    first = lambda c: F.max(F.when(F.col("_k") == 1, F.col(c)))
    stretch = steps.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("n"), first("_t").alias("a"), first("_x").alias("x"), F.max_by("_t", "_k").alias("z"), first("_left").alias("left"), F.coalesce(F.sum(F.when(F.col("_k") > 1, F.col("_x") * F.col("_w") * F.col("_left"))), F.lit(0.0)).alias("right"))
    lists = stretch.groupBy(*keys).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("_p", "a", "x", "z", "left", "right"))).alias("_s"))  # no more than there are partitions

    def step(state: Column, s: Column) -> Column:
        w = weight(s["a"], state["z"])
        begun = F.when(state["z"].isNull(), s["x"]).otherwise(w * s["x"] + (1 - w) * state["v"])
        return F.struct((s["left"] * begun + s["right"]).alias("v"), s["z"].alias("z"))

    nothing = F.struct(F.lit(0.0).alias("v"), F.lit(None).cast("double").alias("z"))
    return lists.select(*keys, "n", F.aggregate("_s", nothing, step)["v"].alias("_v"))


def ema(df: DataFrame, keys: list[str], order: list[str], x: str, smoothing: float = 0.3) -> DataFrame:
    """keys and ema, the value of EMA after all values of the key in the given order."""
    found = _folded(df, keys, order, F.col(x), lambda t, before: F.lit(smoothing), F.lit(0.0))
    return found.select(*keys, (F.col("_v") / (1 - F.pow(F.lit(1 - smoothing), F.col("n")))).alias("ema"))


def time_weighted_ema(df: DataFrame, keys: list[str], order: list[str], seconds: Column, x: str, decay_rate: float) -> DataFrame:
    """keys and ema, the value of TimeWeightedEMA after all values of the key in the given order."""
    found = _folded(df, keys, order, F.col(x), lambda t, before: F.exp(-F.lit(decay_rate) * (t - before)), seconds)
    return found.select(*keys, F.col("_v").alias("ema"))
