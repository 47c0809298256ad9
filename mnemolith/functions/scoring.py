"""Relevance factors of a memory, each from 0 to 1 (or 1 at most by its own scale), and penalties."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

# Fixed values of the score.
DECAY, HALF_LIFE_HOURS, NEVER_ACCESSED = 0.693, 168.0, 0.1
TYPE_BOOST = {"rule": 1.5, "procedure": 1.3, "fact": 1.0, "episode": 0.8, "preference": 0.7}
MOST_BOOST, OTHER_SCOPE, UNKNOWN_CONFIDENCE = 1.5, 0.8, 0.7
SUPERSEDED, CONFLICTED = 0.3, 0.8


def hours_between(start: Column, end: datetime) -> Column:
    return (F.unix_micros(F.lit(end)) - F.unix_micros(start)) / F.lit(3.6e9)


def recency(last_accessed: Column, now: datetime) -> Column:
    age = F.greatest(hours_between(last_accessed, now), F.lit(0.0))
    return F.when(last_accessed.isNull(), NEVER_ACCESSED).otherwise(F.exp(-DECAY * age / HALF_LIFE_HOURS))


def log_share(n: Column, scale: float) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log2(n + F.lit(1.0)) / scale))


def frequency(access_count: Column) -> Column:
    return log_share(access_count, 10.0)


def reinforcement(count: Column) -> Column:
    return log_share(count, 5.0)


def type_boost(kind: Column) -> Column:
    out = F.when(F.lit(False), 1.0)
    for name, boost in TYPE_BOOST.items():
        out = out.when(kind == name, boost / MOST_BOOST)
    return out.otherwise(1.0 / MOST_BOOST)


def scope_boost(scope: Column, memory_project: Column, project: str) -> Column:
    if not project:
        return F.lit(1.0 / MOST_BOOST)
    return F.when((scope == "project") & (memory_project == project), 1.0).when(scope == "permanent", 1.0 / MOST_BOOST).otherwise(OTHER_SCOPE / MOST_BOOST)


def confidence(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(0.0)) < 0.01, UNKNOWN_CONFIDENCE).otherwise(value)


def tag_affinity(tags: Column, query: str) -> Column:
    """Share of the tags all of whose words are among the query's words."""
    asked = F.array_distinct(words(F.lower(F.lit(query))))
    hit = F.filter(tags, lambda t: (F.size(words(F.lower(t))) > 0) & (F.size(F.array_except(words(F.lower(t)), asked)) == 0))
    return F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, 0.0).otherwise(F.size(hit) / F.size(tags))


def graph_proximity(hops: Column) -> Column:
    return F.when(hops.isNull() | (hops < 1), 0.0).when(hops == 1, 1.0).when(hops == 2, 0.5).otherwise(0.25)
