"""Bounded, reproducible samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that training takes at most, half of them with each label where there are so many.
TRAINING_ROWS = 6000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, held: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == held, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = TRAINING_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out fold, and how many labelled rows one row of each label stands for.

    The ids with the smallest hashes are taken of each label, so the sample depends on nothing else. Of documents that
    share an id the first text counts, of labels the higher."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id"), folds, held)).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    stands_for = {v: max(1.0, counts.get(v, 0) / (rows // 2)) for v in (0, 1)}
    # At most ``rows`` rows of two numbers each are broadcast.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))
    return sample, stands_for
