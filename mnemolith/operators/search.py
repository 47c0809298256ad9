"""Vector and text search over memories, facts and entities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitise_query, words
from ..functions.vectors import cosine_to
from .filters import SearchFilters, checked_threshold
from .vector_index import best_before, build_index, has_direction, matrix, most_alike_before, row_pairs_above, unit


def knn(memories: DataFrame, query: list[float], limit: int, filters: SearchFilters | None = None, *, candidate_window: int | None = None, post_filter: bool = False) -> DataFrame:
    """Memories with ``score``, best first. Filters come first; with ``post_filter`` they are applied to the nearest ``candidate_window`` rows."""
    filters = filters or SearchFilters()
    if post_filter:
        near = memories.where("size(embedding) > 0").withColumn("score", cosine_to(F.col("embedding"), query)).orderBy(F.desc("score"), "id").limit(candidate_window or limit)
        return filters.apply(near).orderBy(F.desc("score"), "id").limit(limit)
    return filters.apply(memories).where("size(embedding) > 0").withColumn("score", cosine_to(F.col("embedding"), query)).orderBy(F.desc("score"), "id").limit(limit)


def find_duplicates(memories: DataFrame, query: list[float], threshold: float, candidate_window: int | None = None) -> DataFrame:
    """All memories at or above the threshold, best first."""
    checked_threshold(threshold)
    near = memories.where("size(embedding) > 0").withColumn("score", cosine_to(F.col("embedding"), query)).where(F.col("score") >= threshold).orderBy(F.desc("score"), "id")
    return near.limit(candidate_window) if candidate_window else near


#: Up to so many vectors one task multiplies all with all; more are met through an index, which leaves out what cannot be alike.
BLOCK_ROWS = 2000


def _product(vectors: DataFrame, work: Callable, columns: str) -> DataFrame:
    """``work(cosines, ids)`` of all vectors (id, embedding) of one length in one task."""

    def product(group: pd.DataFrame) -> pd.DataFrame:
        u = unit(matrix(group["embedding"]))
        return work(u @ u.T, group["id"].to_numpy())

    rows = vectors.where(has_direction(F.col("embedding"))).select("id", "embedding", F.size("embedding").alias("length"))
    return rows.groupBy("length").applyInPandas(product, columns)


def _is_small(vectors: DataFrame, block_rows: int) -> bool:
    return vectors.where(has_direction(F.col("embedding"))).limit(block_rows + 1).count() <= block_rows


def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score), a < b, of every pair of (id, embedding) with a cosine above the threshold (0 or more). Vectors of different lengths, or without a direction, are not alike."""
    kind = vectors.schema["id"].dataType.simpleString()

    def above(scores: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero((scores > threshold) & (ids[:, None] < ids[None, :]))
        return pd.DataFrame({"a": ids[i], "b": ids[j], "score": scores[i, j]})

    if _is_small(vectors, block_rows):
        return _product(vectors, above, f"a {kind}, b {kind}, score double")
    return row_pairs_above(build_index(vectors, calibrate=False), threshold)


def nearest_before(vectors: DataFrame, at_least: float = 0.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, existing_id, score): for each of (id, embedding) the most alike of those with a smaller id, the first among equals (to nine digits), where its cosine is ``at_least``."""
    kind = vectors.schema["id"].dataType.simpleString()

    def best(scores: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        order = np.argsort(ids, kind="stable")
        scores, ids = np.round(scores, 9)[np.ix_(order, order)], ids[order]
        allowed = np.where(np.tri(len(ids), k=-1, dtype=bool), scores, -np.inf)
        at = allowed.argmax(axis=1)
        top = allowed[np.arange(len(ids)), at]
        return pd.DataFrame({"id": ids, "existing_id": ids[at], "score": top})[top >= at_least]

    if _is_small(vectors, block_rows):
        return _product(vectors, best, f"id {kind}, existing_id {kind}, score double")
    return best_before(build_index(vectors, calibrate=False), at_least)


def nearest_few_before(vectors: DataFrame, above: float, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, existing_id, score): for each of (id, embedding) the ``k`` most alike of those with a smaller id, the first among equals (to twelve digits), of a cosine above ``above`` (0 or more)."""
    kind = vectors.schema["id"].dataType.simpleString()

    def best(scores: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        scores = np.round(scores, 12)
        i, j = np.nonzero((scores > above) & (ids[None, :] < ids[:, None]))
        rows = pd.DataFrame({"id": ids[i], "existing_id": ids[j], "score": scores[i, j]})
        return rows.sort_values(["id", "score", "existing_id"], ascending=[True, False, True]).groupby("id").head(k)

    if _is_small(vectors, block_rows):
        return _product(vectors, best, f"id {kind}, existing_id {kind}, score double")
    return most_alike_before(build_index(vectors, calibrate=False, merge=False), above, k)


def search_facts(facts: DataFrame, limit: int, query: str = "", embedding: list[float] | None = None, candidate_window: int | None = None) -> DataFrame:
    """Facts that have not expired: by cosine if there is a query vector, else those whose text or relation has the query in it."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    active = facts.where(F.col("expired_at").isNull())
    if embedding is None:
        q = query.lower()
        hit = F.contains(F.lower("fact"), F.lit(q)) | F.contains(F.lower("relation_type"), F.lit(q))
        return active.where(hit).withColumn("score", F.lit(1.0)).orderBy("id").limit(limit)
    if candidate_window:
        active = active.orderBy("id").limit(max(candidate_window, 10 * limit))
    return active.withColumn("score", cosine_to(F.col("fact_embedding"), embedding)).orderBy(F.desc("score"), "id").limit(limit)


def search_entities(entities: DataFrame, name: str = "", kind: str = "", limit: int = 0, include_aliases: bool = True) -> DataFrame:
    """Entities whose name (or an alias) has the text in it, in any case."""
    q = F.lit(name.lower())
    hit = F.contains(F.lower("name"), q)
    if include_aliases:
        hit = hit | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), q)), F.lit(False))
    rows = entities.where(hit) if name else entities
    return (rows.where(F.col("type") == kind) if kind else rows).orderBy("name", "id").limit(limit or 100)


def seed_entities(entities: DataFrame, query: str, limit: int = 10, project: str = "") -> DataFrame:
    """Entities one of whose name's words is a word of the query."""
    rows = entities.where(F.col("project") == project) if project else entities
    asked = words(F.lower(sanitise_query(F.lit(query))))
    hit = rows.where(F.arrays_overlap(words(F.lower(sanitise_query(F.col("name")))), asked)) if query.strip() else rows
    return hit.withColumn("score", F.lit(1.0)).orderBy("id").limit(limit)
