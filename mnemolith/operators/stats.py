"""Statistics of a collection: all rows count, old versions and sensitive ones too."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MEMORY_TYPES, SCOPES

#: Bytes of a stored vector: 768 numbers of 4 bytes.
VECTOR_BYTES = 768 * 4
TIERS = ("0", "1-3", "4-10", "10+")


def count_by(memories: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """(column, n) for every one of ``keys``, 0 where there is none."""
    every = memories.sparkSession.createDataFrame([(k,) for k in keys], f"{column} string")
    counts = memories.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def by_type(memories: DataFrame) -> DataFrame:
    return count_by(memories, "type", MEMORY_TYPES)


def by_scope(memories: DataFrame) -> DataFrame:
    return count_by(memories, "scope", SCOPES)


def tier(column: str):
    n = F.coalesce(F.col(column), F.lit(0))
    return F.when(n <= 0, "0").when(n <= 3, "1-3").when(n <= 10, "4-10").otherwise("10+")


def tiers(memories: DataFrame) -> DataFrame:
    return count_by(memories.select(tier("reinforced_count").alias("tier")), "tier", TIERS)


def top_accessed(memories: DataFrame, n: int = 5, preview_bytes: int = 80) -> DataFrame:
    """The most accessed rows, with the first bytes of their contents."""
    head = F.regexp_replace(F.decode(F.substring(F.encode("content", "UTF-8"), 1, preview_bytes), "UTF-8"), "�+$", "")
    return memories.orderBy(F.desc("access_count"), F.desc("created_at"), "id").limit(n).select("id", "access_count", head.alias("preview"))


def summary(memories: DataFrame, now: datetime) -> DataFrame:
    soon = F.lit(now + timedelta(hours=24))
    return memories.agg(
        F.count(F.lit(1)).alias("total"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
        F.count_if(F.col("conflict_status") == "active").alias("active_conflicts"),
        F.count_if((F.col("scope") == "ttl") & (F.col("valid_until") < soon)).alias("pending_ttl"),
        F.count_if(F.col("embedding").isNull() | (F.size("embedding") <= 0)).alias("without_embedding"),
        (F.count(F.lit(1)) * VECTOR_BYTES).alias("storage_bytes"),
    )


def observed(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """``df`` and an observation that has the count of its rows once they have been used."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
