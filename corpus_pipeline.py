"""From documents to token ids: quality, line dedup, near-dedup, decontamination, encoding.

Each stage takes what the one before kept, as Parquet, and returns the columns of ``documents``; the
last returns token ids.  Nulls, empty texts, repeated rows, empty tables and further columns are
handled by the operators as their docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, line_dedup, near_texts, quality
from tracelake.llm.labelled import fold
from tracelake.storage import materialize, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from three quarters of the labelled ids."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return quality.keep_good(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their cross-site lines; the count of characters follows the text."""
    out = line_dedup.remove_boilerplate(docs).drop("n_lines", "n_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash near-dedup links: five-word shingles, similarity 0.8 or more."""
    return near_texts.keep_one(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their count, and digests of the ids and of what they decode to."""
    # Python workers that earlier stages have left large remember fewer pieces.
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered_bytes=64 << 20)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("encoding", encode),
]

#: The classifier, the fingerprints and the tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written as Parquet and read again; what a stage needed beside goes when it is written."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
            made.pop()
    return STAGES[-1][1](spark, docs, sf_dir)
