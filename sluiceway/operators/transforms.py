"""Lazy transforms.  Expressions where they can say it, vectorised Python where not."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import numbered


def rebatched(batches: Iterator[pa.RecordBatch], size: int | None, drop_last: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of exactly `size` rows in the order they come; the last may be smaller, or is
    dropped.  Without a size, or with 0 or less, there is one batch of all rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while size and size > 0 and rows + batch.num_rows >= size:
            need = size - rows
            yield _joined([*held, batch.slice(0, need)])
            batch, held, rows = batch.slice(need), [], 0
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if rows and not (drop_last and size and size > 0):
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def map_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """New columns, or others in place of old ones, by expressions."""
    return df.withColumns(columns)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _as_schema(df: DataFrame, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def map_rows(df: DataFrame, fn: Callable[[dict[str, Any]], dict[str, Any] | None], schema: T.StructType | str) -> DataFrame:
    """fn gets each row as a dictionary, and what it returns is merged into the row.
    `schema` is that of the result; columns outside it are dropped."""
    schema = _as_schema(df, schema)
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row | (fn(row) or {}) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in arrow.names} for r in rows], arrow)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[Any], Any], schema: T.StructType | str, batch_size: int | None = 1000, formatting: str = "arrow") -> DataFrame:
    """fn gets batches of batch_size rows, as pyarrow tables or as a dictionary of lists, and
    returns the like; it may change the number of rows."""
    schema = _as_schema(df, schema)
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, batch_size):
            if formatting == "arrow":
                table = fn(pa.Table.from_batches([batch]))
            else:
                table = pa.table(fn(batch.to_pydict()), arrow)
            yield from table.select(arrow.names).cast(arrow).to_batches()

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, keep: Column | str | Callable[[dict[str, Any]], bool]) -> DataFrame:
    """Rows for which an expression (which reaches the scan) or a Python function holds."""
    if not callable(keep) or isinstance(keep, Column):
        return df.where(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(keep(row)) for row in batch.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def select_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def skip(df: DataFrame, n: int, order_by: str | list[str]) -> DataFrame:
    return df.orderBy(order_by).offset(n)


def take(df: DataFrame, n: int, order_by: str | list[str]) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def step(df: DataFrame, every: int, order_by: str | list[str], start: int = 0) -> DataFrame:
    """Rows start, start + every, ... in the order given."""
    return numbered(df, order_by).where((F.col("_n") >= start) & ((F.col("_n") - start) % every == 0)).drop("_n")


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed))


def batch_ids(df: DataFrame, size: int, order_by: str | list[str], drop_last: bool = False, to: str = "batch") -> DataFrame:
    """df with the number of the batch of `size` rows that each row falls in."""
    rows = numbered(df, order_by)
    if drop_last:
        rows = rows.where(F.col("_n") < F.lit(rows.count() // size * size))
    return rows.withColumn(to, F.floor(F.col("_n") / size).cast("long")).drop("_n")


def cast_to(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Columns by name and in place, cast as declared; overflow raises, and so do other names."""
    schema = _as_schema(df, schema)
    if schema.names != df.columns:
        raise ValueError(f"columns are {df.columns}, declared are {schema.names}")
    return df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


class Pipeline:
    """Transforms, applied in order to any table."""

    def __init__(self, *steps: Callable[[DataFrame], DataFrame]):
        self.steps = list(steps)

    def copy(self) -> Pipeline:
        return Pipeline(*self.steps)

    def __call__(self, df: DataFrame) -> DataFrame:
        for one in self.steps:
            df = df.transform(one)
        return df

    def __str__(self) -> str:
        return " -> ".join(getattr(s, "__name__", type(s).__name__) for s in self.steps) or "nothing"
