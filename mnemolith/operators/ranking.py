"""Rank fusion, the relevance score, and what is done with a ranked list."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import estimate_tokens
from ..schema import Weights
from ..session import cut_off

RRF = 60
VECTOR_SHARE, GRAPH_SHARE = 0.6, 0.4


def with_rank(ranked: DataFrame, *order: Column) -> DataFrame:
    """Rank from 1 over a short list (the result of a top-k)."""
    return ranked.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def rrf_merge(lists: list[DataFrame], limit: int = 0) -> DataFrame:
    """(id, score): sum over ranked lists (id, rank) of 1 / (60 + rank), best first; ``limit`` 0 keeps all."""
    every = reduce(DataFrame.unionByName, [x.select("id", (1.0 / (RRF + F.col("rank"))).alias("part")) for x in lists])
    merged = every.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id")
    return merged.limit(limit) if limit else merged


def hybrid_search(searches: list[Callable[[int], DataFrame]], limit: int) -> DataFrame:
    """Fuse the searches (id, rank), each asked for twice as many rows. They run side by side, each on its own, so one that fails, be it when it is
    planned or in a task, is left out; all failing is an error."""

    def run(search: Callable[[int], DataFrame]) -> DataFrame | Exception:
        try:
            return cut_off(search(2 * limit).select("id", "rank"))
        except Exception as e:  # noqa: BLE001  one search of several may be out of order
            return e

    with ThreadPoolExecutor(max(1, len(searches))) as pool:
        found = list(pool.map(run, searches))
    lists = [x for x in found if isinstance(x, DataFrame)]
    if not lists:
        raise RuntimeError("no search worked") from next(iter(found), None)
    return rrf_merge(lists, limit)


def rrf_blend(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """(id, rrf, similarity) of a vector list (id, rank, score) and a graph list (id, rank)."""
    v, g = vector.select("id", F.col("rank").alias("rank_v"), F.col("score").alias("similarity")), graph.select("id", F.col("rank").alias("rank_g"))
    part = lambda c, share: F.coalesce(share / (RRF + F.col(c)), F.lit(0.0))
    return v.join(g, "id", "full_outer").select("id", (part("rank_v", VECTOR_SHARE) + part("rank_g", GRAPH_SHARE)).alias("rrf"), "similarity")


def rank(results: DataFrame, query: str, now: datetime, project: str = "", weights: Weights | None = None, proximity: DataFrame | None = None) -> DataFrame:
    """Factors, penalties and ``final_score`` of a result set (memories with ``score`` and perhaps ``similarity``), best first.

    A row that another row of the same result set supersedes is penalised, as is one in an active conflict."""
    w = (weights or Weights()).checked()
    hops = F.lit(None).cast("int")
    if proximity is not None:
        results = results.join(proximity.select("id", F.col("hops").alias("__hops")), "id", "left")
        hops = F.col("__hops")
    superseded = results.where(F.coalesce(F.col("supersedes_id").cast("string"), F.lit("")) != "").select(F.col("supersedes_id").alias("id"), F.lit(True).alias("__superseded")).distinct()
    rows = results.join(superseded, "id", "left")
    similarity = F.coalesce(F.col("similarity"), F.col("score")) if "similarity" in results.columns else F.col("score")
    factors = {
        "similarity": similarity,
        "recency": S.recency(F.col("last_accessed"), now),
        "frequency": S.frequency(F.col("access_count")),
        "type_boost": S.type_boost(F.col("type")),
        "scope_boost": S.scope_boost(F.col("scope"), F.col("project"), project),
        "confidence": S.confidence(F.col("confidence")),
        "reinforcement": S.reinforcement(F.col("reinforced_count")),
        "tag_affinity": S.tag_affinity(F.col("tags"), query),
        "graph_proximity": S.graph_proximity(hops),
    }
    total = reduce(Column.__add__, [getattr(w, name) * value for name, value in factors.items()])
    supersession = F.when(F.col("__superseded"), S.SUPERSEDED).otherwise(1.0)
    conflict = F.when(F.col("conflict_status") == "active", S.CONFLICTED).otherwise(1.0)
    scored = rows.select(
        *[F.col(c) for c in results.columns if c not in ("similarity", "confidence", "__hops")],
        F.col("confidence").alias("stated_confidence"),
        *[value.alias(f"{name}_score") for name, value in factors.items()],
        supersession.alias("supersession_penalty"),
        conflict.alias("conflict_penalty"),
        (total * supersession * conflict).alias("final_score"),
    )
    return scored.orderBy(F.desc("final_score"), "id")


def within_budget(ranked: DataFrame, budget: int, order: list[Column], cost: Column | None = None) -> DataFrame:
    """The longest beginning of a ranked list whose costs (estimated tokens + 2) sum to ``budget`` at most."""
    cost = estimate_tokens(F.col("content")) + 2 if cost is None else cost
    so_far = F.sum("cost").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("cost", cost).withColumn("used", so_far).where(F.col("used") <= budget)


def format_list(kept: DataFrame, order: str = "rank") -> DataFrame:
    """(text, n): contents of a budgeted list end to end."""
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "content"))), lambda s: s["content"]), "\n---\n").alias("text"), F.count(F.lit(1)).alias("n"))


def annotate_conflicts(ranked: DataFrame) -> DataFrame:
    """``peers``: the first eight characters of the other ids of a row's active conflict group in the list."""
    grouped = F.when((F.col("conflict_status") == "active") & (F.coalesce("conflict_group_id", F.lit("")) != ""), F.col("conflict_group_id"))
    short = F.when(F.char_length(F.col("id").cast("string")) >= 8, F.left(F.col("id").cast("string"), F.lit(8)))
    members = F.collect_list(F.when(grouped.isNotNull(), short)).over(W.partitionBy(grouped))
    return ranked.withColumn("peers", F.when(grouped.isNotNull(), F.array_sort(F.array_except(members, F.array(short)))))


def needs_rerank(ranked: DataFrame, threshold: float) -> DataFrame:
    """One row (needed): four rows or more, and the first and fourth scores no further apart than the threshold."""
    top = ranked.orderBy(F.desc("final_score"), "id").limit(4)
    spread = F.max("final_score") - F.min("final_score")
    return top.agg(((F.count(F.lit(1)) >= 4) & (spread <= threshold) & F.lit(threshold > 0)).alias("needed"))


def apply_order(ranked: DataFrame, order: DataFrame, top: int = 10) -> DataFrame:
    """Reorder the first ``top`` rows of (.., rank) by (position from 0, place): unknown or repeated positions are ignored, rows left out follow."""
    usable = order.where((F.col("position") >= 0) & (F.col("position") < top)).groupBy("position").agg(F.min("place").alias("place"))
    placed = ranked.join(usable, (F.col("rank") - 1 == F.col("position")) & (F.col("rank") <= top), "left")
    group = F.when(F.col("place").isNotNull(), 0).when(F.col("rank") <= top, 1).otherwise(2)
    return placed.withColumn("rank", F.row_number().over(W.orderBy(group, "place", "rank"))).drop("position", "place")


def touch(memories: DataFrame, returned: DataFrame, now: datetime) -> DataFrame:
    """``memories`` with the returned ids counted as accessed now."""
    hit = returned.select("id", F.lit(True).alias("__hit")).distinct()
    return memories.join(hit, "id", "left").withColumn("access_count", F.col("access_count") + F.when(F.col("__hit"), 1).otherwise(0)).withColumn("last_accessed", F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("last_accessed"))).drop("__hit")


def community_sweep(results: DataFrame, query: str, seeds: DataFrame, labels: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, score, swept): ``results`` (id, score) and, if the query has fewer than ten words and meets just one entity of ``seeds`` (id), the other memories of its community, each as if first in a list."""
    base = results.select("id", "score", F.lit(False).alias("swept"))
    if len(query.split()) >= 10:
        return base
    single = seeds.select("id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("entity_id")).where("n = 1").select("entity_id")
    mine = labels.join(F.broadcast(single), "entity_id").select("community")
    members = labels.join(F.broadcast(mine), "community").select(F.col("entity_id").alias("id"))
    found = entities.join(members, "id").select(F.explode("memory_ids").alias("id")).distinct().join(results.select("id"), "id", "left_anti")
    return base.unionByName(found.select("id", F.lit(1.0 / (RRF + 1)).alias("score"), F.lit(True).alias("swept")))
