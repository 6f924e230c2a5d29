"""The corpus pipeline: from the documents table to tokens, by five operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the
shared folder and reads it again as the next stage's docs. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxmere.llm.bpe import tokenize
from fluxmere.llm.common import table, written
from fluxmere.llm.language import reject_unknown
from fluxmere.llm.lines import dedup_lines
from fluxmere.llm.mixing import mixed
from fluxmere.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go; a null language is filled in."""
    return reject_unknown(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly, go; so do documents that lose all their lines. n_chars follows the text."""
    return dedup_lines(docs, drop_emptied=True).withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link one stays."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and decoded text."""
    return tokenize(docs, public_tokenizers.path("word_bpe_49k.json")).drop("decoded")


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mix), ("BPE", encode)]

#: No SQL: trained models, MinHash, fingerprints, random rounding and merges are beyond it; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
