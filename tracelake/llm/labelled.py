"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n)).cast("int")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, max_labelled: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text, label) of at most ``max_labelled`` labelled ids that satisfy ``train``, one row each.

    A label is the majority of an id's rows, ties being 1; null ids and labels do not count.  Which ids
    are taken depends on a hash of the id only; of several texts of an id the one with the smallest hash
    stands for it.  The ids are few by the bound, so they are broadcast and the documents are scanned
    once; what is shuffled is one text per id and task.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & train)
        .groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
