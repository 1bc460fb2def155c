"""The corpus pipeline: toxicity, exact copies, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and
returns a DataFrame, which run() writes as Parquet and reads again for the next.  All but the
last return the columns of documents; what a stage rejects is gone from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import byte_bpe, decontaminate, exact_dedup, near_dedup, toxicity
from sluiceway.llm.common import discard, materialise, read_table, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted to the labelled rows among them, scores below one half.
    Null and empty texts have the score of a text without toxic words; rows that repeat are judged
    each; an empty table stays empty."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks the longest stays, then that of the least doc_id.
    Null counts as empty, and one empty text stays; an empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the least doc_id.
    Null counts as empty; null ids come first; an empty table stays empty."""
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs.  Null and empty texts have none and
    stay, as do all if the benchmark is empty; rows that repeat are judged each."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the bytes at which tokens begin, of every whole text;
    the ids are decoded here and held against the text, and a difference stops the run.
    Null and empty texts have no ids; rows that repeat have a row each; no rows give none."""
    return byte_bpe.encode(docs, byte_bpe.vocabulary(), decoded=True).select("doc_id", F.col("n_tokens"), "ids", "starts")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("byte-level BPE", token_ids),
]

#: A conditional random field, MinHash classes and BPE are beyond SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents that the stages leave.  What a stage writes for itself goes when it is
    done, and its result when the next is; the last result lasts as long as the application.
    Null and empty texts, repeats and an empty table are as each stage says."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            now = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        if before is not None:
            discard(before)
        docs = before = now
    return docs
