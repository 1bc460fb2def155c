"""The query catalogue: each operator over whole tables, and the SQL that it is held against."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.averages import ema, time_weighted_ema
from ..functions.compose import Compose
from ..functions.sizes import size_column
from ..operators import transforms as t
from ..operators.consume import consume
from ..operators.sharding import ShardingStrategy, shards_by_count, shards_by_item
from ..sources.shards import ArrowDatasetWriter, JsonDatasetWriter, read_shards
from ..streaming.sink import write_stream
from . import usage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
        base = tempfile.mkdtemp(prefix="sluiceway-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_sluiceway"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def map_array_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_max("embedding").cast("double").alias("max_embedding")).where("max_embedding is not null")


def map_row_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return t.map_columns(items, revenue=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).select("l_orderkey", "l_linenumber", "revenue")


def map_row_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return t.map_rows(part, lambda row: {"label": f"{row['p_name']}/{row['p_size']}"}, "p_partkey long, label string")


def map_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def lengths(batch: pa.Table) -> pa.Table:
        return pa.table({"doc_id": batch["doc_id"], "length": pc.cast(pc.utf8_length(batch["text"]), pa.int64())})

    return t.map_batches(docs, lengths, "doc_id long, length long", 1000)


def map_batched_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes the number of rows: each order gives a row for each word of its priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")

    def split(batch: dict[str, list]) -> dict[str, list]:
        rows = [(k, w) for k, p in zip(batch["o_orderkey"], batch["o_orderpriority"], strict=True) for w in p.split(" ")]
        return {"o_orderkey": [k for k, _ in rows], "word": [w for _, w in rows]}

    return t.map_batches(orders, split, "o_orderkey long, word string", 5000, "python")


def map_overwrite_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return t.map_columns(docs, n_chars=F.col("n_chars") * 2)


def filter_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.filter_rows(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 200000).select("o_orderkey", "o_custkey")


def filter_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return t.filter_rows(customers, lambda row: row["c_custkey"] % 3 == 1)


def filter_map_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = t.Pipeline(lambda d: t.filter_rows(d, F.col("p_size") > 10), lambda d: t.map_columns(d, price=F.round(F.col("p_retailprice") * 2, 4)), lambda d: t.filter_rows(d, F.col("price") > 1000))
    return steps(table(spark, sf_dir, "part")).select("p_partkey", "price")


def compose_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Compose(lambda d: d.select("s_suppkey", "rounded"), lambda d: t.map_columns(d, rounded=F.floor("s_acctbal").cast("long")))(table(spark, sf_dir, "supplier"))


def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.select_columns(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


def skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.skip(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id")


def take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.take(table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, "doc_id")


def step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.step(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 7, "o_orderkey", 3)


def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.shuffle(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), 42)


def rebatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.batch_ids(table(spark, sf_dir, "orders").select("o_orderkey"), 256, "o_orderkey").groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"))


def rebatch_drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.batch_ids(table(spark, sf_dir, "orders").select("o_orderkey"), 256, "o_orderkey", drop_last=True).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))


def shard_sample_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_by_count(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), 1000, ["l_orderkey", "l_linenumber"])


def shard_sample_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_by_item(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 20000).select("doc_id", "source", "shard")


def shard_item_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("total"))


def parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("KB", "MB", " gb", "TB", "B", "XYZ"))), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("size"))
    return texts.select("p_partkey", "size", F.coalesce(size_column(F.col("size")), F.lit(-1)).alias("bytes"))


def cast_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.cast_to(table(spark, sf_dir, "nation"), "n_nationkey long, n_name string, n_regionkey string")


def _round_trip(spark: SparkSession, df: DataFrame, kind: type, **limits) -> DataFrame:
    path = scratch(spark)
    kind(path, disable_tqdm=True, **limits).write(df)
    return read_shards(spark, path)


def sink_arrow_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "customer"), ArrowDatasetWriter)


def sink_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf_dir, "supplier"), JsonDatasetWriter)


def sink_file_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files end by their bytes; all rows come back."""
    return _round_trip(spark, table(spark, sf_dir, "part"), ArrowDatasetWriter, sharding_strategy=ShardingStrategy.FILE_SIZE, max_shard_size="64KB")


def sink_split_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang"), scratch(spark)
    ArrowDatasetWriter(path, disable_tqdm=True).write({"train": docs.where("doc_id % 10 <> 0"), "test": docs.where("doc_id % 10 = 0")})
    splits = read_shards(spark, path)
    return splits["train"].withColumn("split", F.lit("train")).unionByName(splits["test"].withColumn("split", F.lit("test")))


def sink_manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest has a row for each file, not for each row of the table."""
    manifest = ArrowDatasetWriter(scratch(spark), disable_tqdm=True, sharding_strategy=ShardingStrategy.SAMPLE_COUNT, max_shard_size=10000).write(table(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(s["file"], s["rows"]) for s in manifest], "file string, n long").agg(F.sum("n").alias("rows"))


def sink_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream into Arrow shards, read again."""
    source, path, checkpoint = f"{sf_dir}/events.parquet", scratch(spark), scratch(spark)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source if _is_folder(spark, source) else sf_dir, **({} if _is_folder(spark, source) else {"pathGlobFilter": "events.parquet"}))
    write_stream(stream, ArrowDatasetWriter(path, disable_tqdm=True), checkpoint).awaitTermination()
    return read_shards(spark, path).select("event_id", "user_id", "event_type", "value")


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def consume_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = consume(table(spark, sf_dir, "lineitem"), lambda batch: None, 1000, "arrow")
    return status.agg(F.sum("rows").alias("rows"))


def consume_skip_bad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def picky(row: dict) -> None:
        if row["o_orderstatus"] == "F":
            raise ValueError("finished")

    return consume(table(spark, sf_dir, "orders").select("o_orderstatus"), picky, on_error="skip_batch").agg(F.sum("rows").alias("rows"), F.sum("failed_rows").alias("failed"))


def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ema(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", F.round("ema", 6).alias("ema"))


def time_weighted_ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return time_weighted_ema(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], seconds, "value", 0.001).select("user_id", F.round("ema", 6).alias("ema"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        map_array_max, map_row_expr, map_row_python, map_batched, map_batched_python, map_overwrite_column, filter_native, filter_python, filter_map_chain, compose_steps,
        select_columns, skip, take, step, shuffle_rows, rebatch, rebatch_drop_last, shard_sample_count, shard_sample_item, shard_item_totals, parse_size, cast_schema,
        sink_arrow_roundtrip, sink_json_roundtrip, sink_file_size, sink_split_dict, sink_manifest_rows, sink_stream, consume_counts, consume_skip_bad_batches, ema_fold, time_weighted_ema_fold,
    )
}

ORACLE_SQL: dict[str, str] = {
    "map_array_max": "SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS max_embedding FROM embeddings WHERE list_max(embedding) IS NOT NULL",
    "map_row_expr": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem",
    "map_row_python": "SELECT p_partkey, p_name || '/' || p_size AS label FROM part",
    "map_batched": "SELECT doc_id, length(text) AS length FROM documents",
    "map_batched_python": "SELECT o_orderkey, unnest(string_split(o_orderpriority, ' ')) AS word FROM orders",
    "map_overwrite_column": "SELECT doc_id, n_chars * 2 AS n_chars FROM documents",
    "filter_native": "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000",
    "filter_python": "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 1",
    "filter_map_chain": "SELECT p_partkey, round(p_retailprice * 2, 4) AS price FROM part WHERE p_size > 10 AND round(p_retailprice * 2, 4) > 1000",
    "compose_steps": "SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS rounded FROM supplier",
    "select_columns": "SELECT n_nationkey, n_name FROM nation",
    "skip": "SELECT doc_id, lang FROM documents ORDER BY doc_id OFFSET 100",
    "take": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50",
    "step": "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n >= 3 AND (n - 3) % 7 = 0",
    "shuffle_rows": "SELECT s_suppkey, s_nationkey FROM supplier",
    "rebatch": "SELECT n // 256 AS batch, count(*) AS rows, min(o_orderkey) AS first_key FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY 1",
    "rebatch_drop_last": "SELECT n // 256 AS batch, count(*) AS rows FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY 1 HAVING count(*) = 256",
    "shard_sample_count": "SELECT l_orderkey, l_linenumber, (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // 1000 AS shard FROM lineitem",
    "shard_sample_item": """
WITH RECURSIVE o AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (
  SELECT doc_id, source, n, CAST(0 AS BIGINT) AS shard, CAST(n_chars AS BIGINT) AS total FROM o WHERE n = 1
  UNION ALL
  SELECT o.doc_id, o.source, o.n, r.shard + CASE WHEN r.total >= 20000 THEN 1 ELSE 0 END, CASE WHEN r.total >= 20000 THEN 0 ELSE r.total END + o.n_chars
  FROM r JOIN o ON o.source = r.source AND o.n = r.n + 1)
SELECT doc_id, source, shard FROM r""",
    "shard_item_totals": "SELECT source, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY source",
    "parse_size": """
WITH s AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || ['KB', 'MB', ' gb', 'TB', 'B', 'XYZ'][p_partkey % 6 + 1] AS size FROM part)
SELECT p_partkey, size, coalesce(CAST(CAST(regexp_extract(size, '^[0-9]+') AS DOUBLE) * CASE upper(regexp_extract(size, '[A-Za-z]+$'))
  WHEN 'B' THEN 1 WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 WHEN 'TB' THEN 1099511627776 END AS BIGINT), -1) AS bytes FROM s""",
    "cast_schema": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
    "sink_arrow_roundtrip": "SELECT * FROM customer",
    "sink_json_roundtrip": "SELECT * FROM supplier",
    "sink_file_size": "SELECT * FROM part",
    "sink_split_dict": "SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents",
    "sink_manifest_rows": "SELECT count(*) AS rows FROM lineitem",
    "sink_stream": "SELECT event_id, user_id, event_type, value FROM events",
    "consume_counts": "SELECT count(*) AS rows FROM lineitem",
    "consume_skip_bad_batches": "SELECT count(*) FILTER (WHERE o_orderstatus <> 'F') AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders",
    "ema_fold": "SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.3 * x + 0.7 * a) / (1 - power(0.7, count(*))), 6) AS ema FROM events GROUP BY user_id",
    "time_weighted_ema_fold": """
SELECT user_id, round(list_reduce(list({'x': value, 's': epoch_us(ts) / 1e6} ORDER BY ts, event_id),
  lambda a, b: {'x': exp(-0.001 * (b.s - a.s)) * b.x + (1 - exp(-0.001 * (b.s - a.s))) * a.x, 's': b.s}).x, 6) AS ema FROM events GROUP BY user_id""",
}

QUERIES |= usage.QUERIES
ORACLE_SQL |= usage.ORACLE_SQL
