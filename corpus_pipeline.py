"""The corpus pipeline: toxicity, exact duplicates, near duplicates, personal data, packing.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm import block_naming, ngram_join, packing, pii, toxicity
from tarnfold.llm.common import stage, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine learned from these documents and their labels calls toxic go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return block_naming.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group that shingles link the document with the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of its kinds; n_chars follows the text."""
    clean = pii.mask(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, neighbours on the curve together."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("exact duplicates", exact_duplicates), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", packed)]

#: A learned score, tokens and a curve are beyond SQL: the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "-"))
    return docs
