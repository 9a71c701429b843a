"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs; all but the last return the columns of documents, extra ones included. ``run`` applies them to documents.
SQL expresses none of stages 2 to 5 (sampling hashes, a trained field, drawing by hash, merges), so
ORACLE_SQL is None; tests hold each stage against a plain version.

Defined results of every stage: a null or empty text is no error (the quality rules reject it); a null source is a
source; texts may have any length; repeated rows are judged alike, of those that near-duplicates keep one stays; rows of a
null id stay, each on its own; an empty table gives an empty table; columns may have the names of results (``kept``, ``ids``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, near_dup, pii, quality
from .common import materialize, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject, by themselves or by their host, go."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id."""
    return near_dup.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind; n_chars follows; a null text stays null."""
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each document of the mix; a null text has no ids."""
    return bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path()).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", keep_good), ("near-duplicates", drop_near_copies), ("personal data", mask_personal_data), ("mixing", mix_sources), ("encoding", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
