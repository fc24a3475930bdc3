"""A bounded sample of labelled documents, on which a classifier is fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import crc_fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_fold: list[int], bound: int, keep: list[str]) -> DataFrame:
    """doc_id, label and the columns `keep` of at most `bound` labelled documents.

    Rows whose crc32 fold is in `held_fold` are never taken. Several labels of one
    document count by their mean, rounded up from a half; null labels and labels without
    a document do not count, nor do they use up the bound. The sample is the same for the
    same rows: the documents with the smallest hash of their id, and of rows that repeat an
    id the one with the smallest hash of its columns. The sample is bounded, so it may be
    broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna()
    known = known.where(~crc_fold("doc_id", folds).isin(held_fold)).groupBy("doc_id").agg(F.avg("label").alias("mean"))
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", (F.col("mean") >= 0.5).cast("int").alias("label"))
    rows = docs.select("doc_id", *keep).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min_by(F.struct(*keep), F.xxhash64(*keep)).alias("row"))
    return one.select("doc_id", "label", "row.*")
