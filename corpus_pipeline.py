"""A training-data pipeline over ``documents``: toxicity, near copies, benchmark leaks, mixing, token files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.llm.decontaminate import clean_documents
from tabulon.llm.mixing import mixed_documents
from tabulon.llm.near_duplicates import near_duplicates
from tabulon.llm.queries import domain_labels, public_tokenizer, toxicity_model
from tabulon.llm.tables import freeze, small_batches, table
from tabulon.llm.tokens import tokenize_documents
from tabulon.llm.toxicity import score_toxicity

#: Shingle sets that agree to this percentage make near copies.
SIMILAR = 80
#: Shares of tokens after mixing, and how much the corpus may grow; no document falls below one copy.
TARGETS, GROWTH, LEAST_RATE = {"high": 0.9, "low": 0.1}, 1.25, 1.0


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose score stays below one half."""
    small_batches(spark)
    return score_toxicity(docs, toxicity_model(spark, folder)).where("toxic_score < 0.5").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group, the one with the smallest id; of repeated rows one stays, rows without an id all do."""
    small_batches(spark)
    kept = near_duplicates(docs, size=5, percent=SIMILAR).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    named = named.join(kept, named["doc_id"] == kept["kept_id"], "left_semi")
    return named.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return clean_documents(docs, table(spark, folder, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as its rate says."""
    small_batches(spark)
    labels = domain_labels(spark, folder).where(F.col("domain").isin(list(TARGETS)))
    return mixed_documents(docs, labels, TARGETS, GROWTH, LEAST_RATE)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token files of what is left, and one row per document read back from them."""
    small_batches(spark)
    held = tokenize_documents(docs, public_tokenizer("word_bpe_49k.json"), end_id=2)
    return held.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("near_duplicates", near_copies), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens),
]
#: The first, second, fourth and fifth stage are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each writes its result, which the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = freeze(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
