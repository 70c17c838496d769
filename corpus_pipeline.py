"""A corpus from raw documents: quality, toxicity, near-duplicates, packing. Each stage's rows are written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm import minhash, packing, quality, toxicity
from tabularium.llm.store import kept
from tabularium.tables import Tables

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more)."""
    model = quality.fit(docs, Tables(spark, sf_dir).labels)
    return docs.where(model.column("text") >= 0.5)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    model = toxicity.fit(docs, Tables(spark, sf_dir).labels)
    return docs.where(model.column("text") < 0.7)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 on five words), the one with the smallest doc_id; of
    rows that repeat an id, the one whose text (then whose columns) has the smallest hash; all rows without an id. 44 bands of
    6 rows miss a pair at 0.8 with probability 1.6e-6."""
    first = minhash.near_duplicates(docs, threshold_pct=80, bands=44, rows=6).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    one = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns)))
    named = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi").groupBy("doc_id").agg(one.alias("row")).select("row.*")
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality", good), ("toxicity", clean), ("near_dedup", distinct), ("packing", windows)]
#: SQL can express none of the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
