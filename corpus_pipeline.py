"""From raw documents to packed training sequences.

Five stages, each over all that the one before kept: quality rules, quality
classifier, near copies, mixing to target weights, packing.  Every stage but
the last returns the columns of ``documents``; each result is written as
Parquet in the shared folder and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placebook.llm import mixing, near_copies, packing, quality_classifier, quality_rules
from placebook.llm._store import table, written


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the raw documents, as the rules leave few bad ones."""
    network = quality_classifier.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, network)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that words of a document are taken."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place there, and the path of the table that has their token ids; sequences() puts both together."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL expresses the classifier and the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def sequences(result: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, pieces): the token sequences to train on, out of what run() returns."""
    return packing.sequences(result)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
