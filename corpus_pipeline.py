"""A corpus from raw documents to packed sequences, in stages; each works on all rows that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import minhash, mixing, packing, quality, toxicity
from wayline.llm.shared import clear, cut, fold_of, recorded


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model of trusted text doesn't reject."""
    return quality.accepted(docs, _labels(spark, sf_dir), fold_of(F.col("doc_id")) == 2, stored=True)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't judged toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, _labels(spark, sf_dir), fold_of(F.col("doc_id")) != 2))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8."""
    return minhash.keep_one(docs, k=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the mixture stands in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("quality", good), ("toxicity", civil), ("near_dedup", distinct), ("mixing", mixed), ("packing", packed)]

#: No stage can be said in SQL: models are trained, hashes drawn, texts tokenised. tests/llm holds the operators against brute force where there is one
#: (near duplicates, perplexities, targets, deals, places), and the stages against the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of the corpus stands, after all stages.

    Rows with nulls, empty or very long texts, repeated rows and other columns go through as each stage's operator defines; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        with recorded() as mine:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear(spark, [*mine[:-1], *before])  # what this stage wrote on its way, and the result of the stage before
        before = mine[-1:]
    return docs
