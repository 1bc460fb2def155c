"""Spark-first dataset processing: lazy transforms, sharded sinks, partition-wise
consumption and progress reports, all over ordinary DataFrames."""

from .operators.consume import DatasetConsumer
from .operators.logs import setup_from_environment, setup_logging
from .operators.progress import Callback, TqdmReporterCallback
from .operators.sharding import ShardingStrategy
from .sources.shards import ArrowDatasetWriter, BaseDatasetWriter, JsonDatasetWriter, read_shards

__all__ = ["ArrowDatasetWriter", "BaseDatasetWriter", "Callback", "DatasetConsumer", "JsonDatasetWriter", "ShardingStrategy", "TqdmReporterCallback", "read_shards", "setup_logging"]

setup_from_environment()
