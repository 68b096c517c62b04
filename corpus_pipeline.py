"""The training-data pipeline: documents in, packed sequences out.

Every stage takes any documents table: null and empty texts, null and repeated doc_ids, repeated rows, very long texts, other
columns, no rows at all (which give no rows). `text` and `doc_id` are found whatever their case. What each stage makes of these
cases is said below."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import exact_dedup, simhash_copies, packing, substring_dedup, toxicity
from quillmill.llm.common import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; rows are judged each by their own text. A null or empty text has no
    features and stays or goes with the base rate, so it stays in practice; without labels nothing goes."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays, one row of it where it is repeated; a null doc_id comes after every other. Null
    and empty texts are equal to each other."""
    return exact_dedup.keep_first(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8 or more, and what these connect) the smallest doc_id stays; a null
    doc_id comes after every other. Fewer than five words are one shingle; texts without words are copies of each other."""
    return simhash_copies.keep_one(docs, width=5, per_cent=80)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that begin in a document of smaller doc_id go; n_chars is counted anew. No row goes, so a text
    may become empty; a null text stays null; rows of equal doc_id keep each other's passages."""
    return substring_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' pieces in sequences of 2048 tokens; a null text counts as empty and is its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_dedup", simhash_stage),
    ("substring_dedup", substring_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: Neither a trained classifier nor the packing can be said in SQL; the operators of the stages are held against brute force in
#: tests/llm, the chain of stages on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
