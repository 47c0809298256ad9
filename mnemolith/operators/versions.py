"""Versions of memories: chains, supersession, validity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_off


def _followed(memories: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, id, depth): from each of (head) along ``supersedes_id`` to the end, to a missing link or to an id met before.

    Steps double in length, so a chain of n versions takes about log2(n) rounds."""
    links = memories.select("id", F.col("supersedes_id").alias("next")).where("next is not null")
    jumps = cut_off(links.join(memories.select(F.col("id").alias("next")), "next", "left_semi").select("id", "next"))
    reached, size = cut_off(heads.select("head", F.col("head").alias("id"), F.lit(0).alias("depth"))), 1
    while True:
        further = reached.join(jumps, "id").select("head", F.col("next").alias("id"), (F.col("depth") + size).alias("depth"))
        new = cut_off(further.join(reached.select("head", "id"), ["head", "id"], "left_anti").groupBy("head", "id").agg(F.min("depth").alias("depth")))
        if new.isEmpty():
            return reached
        reached, size = cut_off(reached.unionByName(new)), 2 * size
        jumps = cut_off(jumps.join(jumps.select(F.col("id").alias("next"), F.col("next").alias("last")), "next").select("id", F.col("last").alias("next")))


def chains(memories: DataFrame) -> DataFrame:
    """(head, id, depth): from every memory that nothing supersedes back along ``supersedes_id``, the newest at depth 0.

    Stops at missing links; a cycle has no head and gives no rows."""
    superseded = memories.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id")).distinct()
    heads = memories.where("supersedes_id is not null").join(superseded, "id", "left_anti").select(F.col("id").alias("head"))
    return _followed(memories, heads).select("head", "id", "depth")


def chain_of(memories: DataFrame, key) -> DataFrame:
    """One memory and what it supersedes, newest first; each id once."""
    chain = _followed(memories, memories.where(F.col("id") == key).select(F.col("id").alias("head")))
    return memories.join(chain.select("id", F.col("depth").alias("__depth")), "id").orderBy("__depth").select(*memories.columns)


def invalidate(memories: DataFrame, keys: list, now: datetime) -> DataFrame:
    """Unknown ids change nothing."""
    return memories.withColumn("valid_to", F.when(F.col("id").isin(keys), F.lit(now)).otherwise(F.col("valid_to")))


def supersede(memories: DataFrame, updates: DataFrame, now: datetime) -> DataFrame:
    """``memories`` with a new version for each of ``updates`` (id, new_id, content): it copies the old row, which ends now."""
    old = memories.join(updates.select("id", F.col("new_id").alias("__new"), F.col("content").alias("__content")), "id")
    new = old.withColumn("supersedes_id", F.col("id")).withColumn("id", F.col("__new")).withColumn("content", F.coalesce("__content", "content")).withColumn("created_at", F.lit(now)).withColumn("valid_from", F.lit(now)).withColumn("valid_to", F.lit(None).cast("timestamp"))
    ended = memories.join(updates.select("id", F.lit(True).alias("__ended")), "id", "left").withColumn("valid_to", F.when(F.col("__ended"), F.lit(now)).otherwise(F.col("valid_to")))
    return ended.select(*memories.columns).unionByName(new.select(*memories.columns))


def backfill_validity(memories: DataFrame) -> DataFrame:
    return memories.withColumn("valid_from", F.coalesce("valid_from", "created_at"))


def patch(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace the fields that ``changes`` (id, some fields) gives; ``content_changed`` tells which rows need a new embedding."""
    fields = [c for c in changes.columns if c != "id" and c in memories.columns]
    joined = memories.alias("m").join(changes.alias("c"), F.col("m.id") == F.col("c.id"), "left")
    out = [F.coalesce(f"c.{c}", f"m.{c}").alias(c) if c in fields else F.col(f"m.{c}") for c in memories.columns]
    changed = F.coalesce(F.col("c.content") != F.col("m.content"), F.lit(False)) if "content" in fields else F.lit(False)
    return joined.select(*out, changed.alias("content_changed"))
