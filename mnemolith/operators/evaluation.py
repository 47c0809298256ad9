"""Retrieval quality: exact match, token F1 and recall of the top k, per question and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import exact_match, token_f1


def score_candidates(retrieved: DataFrame) -> DataFrame:
    """(.., f1, exact) of (question_id, ground_truth, rank, content)."""
    return retrieved.withColumn("f1", token_f1(F.col("content"), F.col("ground_truth"))).withColumn("exact", exact_match(F.col("content"), F.col("ground_truth")))


def best_candidate(scored: DataFrame) -> DataFrame:
    """For each question the candidate with the largest F1, the first among equals."""
    return scored.withColumn("__n", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("f1"), "rank"))).where("__n = 1").drop("__n")


def results(questions: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """(question_id, category, exact_match, f1_score, recalled_at_k) of every question; one without candidates scores 0."""
    scored = score_candidates(retrieved.where(F.col("rank") <= k))
    best = best_candidate(scored).select("question_id", F.col("exact").alias("exact_match"), F.col("f1").alias("f1_score"))
    recalled = scored.groupBy("question_id").agg(F.max("exact").alias("recalled_at_k"))
    rows = questions.select("question_id", "category").join(best, "question_id", "left").join(recalled, "question_id", "left")
    return rows.select("question_id", "category", F.coalesce("exact_match", F.lit(False)).alias("exact_match"), F.coalesce("f1_score", F.lit(0.0)).alias("f1_score"), F.coalesce("recalled_at_k", F.lit(False)).alias("recalled_at_k"))


def _measures(k: int, k2: int) -> list:
    share = lambda c: F.avg(F.col(c).cast("double"))
    recall = share("recalled_at_k")
    return [F.count(F.lit(1)).alias("n"), share("exact_match").alias("exact_match"), F.avg("f1_score").alias("avg_f1"), recall.alias("recall_at_k"), (recall if k2 >= k else F.lit(0.0)).alias("recall_at_k2")]


def summarise(rows: DataFrame, k: int, k2: int) -> DataFrame:
    return rows.agg(*_measures(k, k2))


def by_category(rows: DataFrame, k: int, k2: int, blank: str = "uncategorized") -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(blank))
    return rows.groupBy(name.alias("category")).agg(*_measures(k, k2))


def compare(published: DataFrame, current: DataFrame) -> DataFrame:
    """Published scores with current ones beside them, by benchmark name in any case."""
    now = current.select(F.lower("benchmark").alias("__b"), F.col("score").alias("current"))
    return published.join(now, F.lower("benchmark") == F.col("__b"), "left").drop("__b")
