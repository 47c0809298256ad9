"""Filters of a memory scan as one predicate."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MEMORY_TYPES, SCOPES, VISIBILITIES


def valid_at(start: Column, end: Column, when: Column) -> Column:
    """Half-open validity: from ``start`` on, before ``end``."""
    return (start.isNull() | (start <= when)) & (end.isNull() | (end > when))


@dataclass(frozen=True)
class SearchFilters:
    """What a scan is restricted to; fields that are None do not restrict. Sensitive rows and old versions are left out unless asked for."""

    type: str | None = None
    scope: str | None = None
    visibility: str | None = None
    project: str | None = None
    source: str | None = None
    user_id: str | None = None
    conflict_status: str | None = None
    tags: tuple[str, ...] = ()
    as_of: datetime | None = None
    include_invalidated: bool = False
    valid_before: datetime | None = None
    valid_after: datetime | None = None

    def predicate(self) -> Column:
        c = F.col
        out = F.lit(True) if self.visibility == "sensitive" else F.coalesce(c("visibility") != "sensitive", F.lit(True))
        for name in ("type", "scope", "visibility", "project", "source"):
            if (value := getattr(self, name)) is not None:
                out = out & (c(name) == value)
        if self.user_id:
            out = out & (c("user_id") == self.user_id)
        if self.conflict_status is not None:
            out = out & (F.coalesce(c("conflict_status"), F.lit("")) == self.conflict_status)
        for tag in self.tags:
            out = out & F.array_contains("tags", tag)
        if self.as_of is not None:
            out = out & valid_at(c("valid_from"), c("valid_to"), F.lit(self.as_of))
        elif not self.include_invalidated:
            out = out & c("valid_to").isNull()
        if self.valid_before is not None:
            out = out & (c("valid_from").isNull() | (c("valid_from") <= F.lit(self.valid_before)))
        if self.valid_after is not None:
            out = out & (c("valid_from") >= F.lit(self.valid_after))
        return out

    def apply(self, memories: DataFrame) -> DataFrame:
        return memories.where(self.predicate())


def parse_filters(kind: str = "", scope: str = "", project: str = "", tags: str = "", visibility: str = "") -> SearchFilters:
    """Filters from text options: empty ones do not restrict, tags are parted by commas, names must be known."""
    for value, allowed in ((kind, MEMORY_TYPES), (scope, SCOPES), (visibility, VISIBILITIES)):
        if value and value not in allowed:
            raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    split = tuple(t.strip() for t in tags.split(",") if t.strip())
    return SearchFilters(type=kind or None, scope=scope or None, project=project or None, visibility=visibility or None, tags=split)


def checked_threshold(value: float) -> float:
    if not 0 < value <= 1:
        raise ValueError(f"a threshold must be over 0 and at most 1, not {value}")
    return value


def page(memories: DataFrame, filters: SearchFilters, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, by offset."""
    return filters.apply(memories).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def keyset_page(memories: DataFrame, filters: SearchFilters, limit: int, after=None) -> DataFrame:
    """In order of ids, after the last id of the page before; an id that is not there gives an empty page."""
    rows = filters.apply(memories)
    if after is not None:
        known = memories.where(F.col("id") == after).select("id").limit(1)
        rows = rows.where(F.col("id") > after).join(F.broadcast(known.select(F.lit(True).alias("known"))), F.col("known")).drop("known")
    return rows.orderBy("id").limit(limit)


def by_id(memories: DataFrame, key) -> DataFrame:
    return memories.where(F.col("id") == key)


def by_prefix(memories: DataFrame, prefix: str) -> DataFrame:
    return memories.where(F.startswith(F.col("id").cast("string"), F.lit(prefix)))


def long_enough(content: Column) -> Column:
    """At least ten characters besides the white space around them."""
    from ..functions.text import trimmed

    return F.char_length(trimmed(content)) >= 10
