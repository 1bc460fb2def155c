"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, order_by: str | list[str], to: str = "_n") -> DataFrame:
    """df with the number of each row, from 0, in the order given.

    Rows are range-partitioned and sorted; rows of each partition are counted, and a row's number
    is that of the partitions before plus its place.  What comes to the driver is a count for each
    partition.  The sorted rows are kept while both passes read them."""
    order = [order_by] if isinstance(order_by, str) else order_by
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r.p: r["count"] for r in ranged.groupBy(F.shiftright("_id", 33).alias("p")).count().collect()}
    before, total = [], 0
    for p in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(p, 0)
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), (F.shiftright("_id", 33) + 1).cast("int"))
    return ranged.withColumn(to, start + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
