"""Queries op1 to op10, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, exact_dedup, near_dedup, passage_dedup, quality, token_store, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_quality": quality.query,
    "op3_warc": warc.query,
    "op4_toxicity": toxicity.query,
    "op5_byte_bpe": byte_bpe.query,
    "op6_decontaminate": decontaminate.query,
    "op7_near_dedup": near_dedup.query,
    "op8_token_store": token_store.query,
    "op9_passage_dedup": passage_dedup.query,
    "op10_url_filter": url_filter.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_warc": warc.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op10_url_filter": url_filter.SQL,
}
