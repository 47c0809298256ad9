"""Lifecycle rules: expiry, decay, retirement, conflict resolution, consolidation. All rows concerned are current and not sensitive."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_off
from .filters import SearchFilters
from .greedy import alike_classes, places, thin_out
from .search import similar_pairs
from .vector_index import has_direction

SESSION_HOURS = 24


def current(memories: DataFrame) -> DataFrame:
    return SearchFilters().apply(memories)


def ttl_expired(now: datetime) -> Column:
    end = F.unix_micros("created_at") + F.col("ttl_seconds") * 1_000_000
    return (F.col("scope") == "ttl") & (F.col("ttl_seconds") > 0) & (F.unix_micros(F.lit(now)) > end)


def session_decayed(now: datetime) -> Column:
    return (F.col("scope") == "session") & (F.coalesce("last_accessed", "created_at") < F.lit(now - timedelta(hours=SESSION_HOURS)))


def retired(now: datetime) -> Column:
    return F.col("scope").isin("permanent", "project") & (F.col("valid_until") < F.lit(now))


def conflict_groups(memories: DataFrame) -> DataFrame:
    """(conflict_group_id, members) of active groups of two or more."""
    rows = memories.where((F.col("conflict_status") == "active") & (F.coalesce("conflict_group_id", F.lit("")) != ""))
    return rows.groupBy("conflict_group_id").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")


def resolve_conflicts(memories: DataFrame) -> DataFrame:
    """``memories`` with every member of such a group resolved."""
    groups = conflict_groups(current(memories)).select("conflict_group_id", F.lit(True).alias("__resolved"))
    hit = F.col("__resolved") & (F.col("conflict_status") == "active") & SearchFilters().predicate()
    return memories.join(groups, "conflict_group_id", "left").withColumn("conflict_status", F.when(hit, "resolved").otherwise(F.col("conflict_status"))).select(*memories.columns)


def conflict_winners(memories: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(conflict_group_id, id): of each active group's members whose confidence is within the tolerance of the highest the newest wins, the smaller id among equals."""
    rows = current(memories)
    groups = conflict_groups(rows).select("conflict_group_id")
    members = rows.where("conflict_status = 'active'").join(groups, "conflict_group_id").select("conflict_group_id", "id", "confidence", "created_at")
    best = members.groupBy("conflict_group_id").agg(F.max("confidence").alias("best"))
    near = members.join(best, "conflict_group_id").where(F.col("confidence") >= F.col("best") - tolerance)
    newest = F.min(F.struct((-F.unix_micros("created_at")).alias("t"), "id"))["id"]
    return near.groupBy("conflict_group_id").agg(newest.alias("id"))


def _permanent(memories: DataFrame) -> DataFrame:
    return current(memories).where("scope = 'permanent'")


def consolidation_pairs(memories: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(a, b, score) of permanent memories more alike than the threshold."""
    return similar_pairs(_permanent(memories), threshold)


def consolidate(memories: DataFrame, threshold: float = 0.92, **rest: int) -> DataFrame:
    """(id) of permanent memories to delete: newest first, each kept row is compared with the later ones; of two alike the more confident stays, and a row that goes stops comparing.

    The comparisons are settled in rounds over all rows, see ``greedy``; ``rest`` bounds what is left to one task."""
    rows = cut_off(_permanent(memories).where(has_direction(F.col("embedding"))).select("id", "embedding", "created_at", "confidence"))
    classes, links = alike_classes(rows, threshold)
    newest = F.coalesce(-F.unix_micros("created_at"), F.lit((1 << 63) - 1))
    ordered = rows.select("id", places(newest, F.col("id")).alias("place"), F.coalesce("confidence", F.lit(0.0)).alias("trust"))
    return thin_out(ordered.join(classes, "id").select("id", "class", "place", "trust"), links, **rest)


def run_lifecycle(memories: DataFrame, now: datetime) -> DataFrame:
    """``memories`` with ``lifecycle_action``: expired, decayed, retired, resolved or null. A row has the first that applies; resolution sees the survivors only."""
    mine = SearchFilters().predicate()
    action = F.when(mine & F.coalesce(ttl_expired(now), F.lit(False)), "expired").when(mine & F.coalesce(session_decayed(now), F.lit(False)), "decayed").when(mine & F.coalesce(retired(now), F.lit(False)), "retired")
    marked = memories.withColumn("lifecycle_action", action)
    groups = conflict_groups(current(marked.where("lifecycle_action is null"))).select("conflict_group_id", F.lit(True).alias("__resolved"))
    resolved = F.col("lifecycle_action").isNull() & F.col("__resolved") & (F.col("conflict_status") == "active") & mine
    return marked.join(groups, "conflict_group_id", "left").withColumn("lifecycle_action", F.when(resolved, "resolved").otherwise(F.col("lifecycle_action"))).select(*memories.columns, "lifecycle_action")


def lifecycle_report(memories: DataFrame, now: datetime) -> DataFrame:
    """(expired, decayed, retired, conflicts): of a group of n resolved rows n - 1 count as conflicts."""
    rows = run_lifecycle(memories, now)
    return rows.agg(
        *[F.count_if(F.col("lifecycle_action") == a).alias(a) for a in ("expired", "decayed", "retired")],
        (F.count_if(F.col("lifecycle_action") == "resolved") - F.count_distinct(F.when(F.col("lifecycle_action") == "resolved", F.col("conflict_group_id")))).alias("conflicts"),
    )


#: A phase names rows of the memories that are left, (id), in their order.
Phase = Callable[[DataFrame], DataFrame]


def phases(now: datetime, threshold: float = 0.92) -> dict[str, Phase]:
    """All phases in their order. Of a conflict group of n rows the n - 1 that lost are named."""

    def lost(memories: DataFrame) -> DataFrame:
        rows = current(memories).where("conflict_status = 'active'")
        return rows.join(conflict_groups(rows).select("conflict_group_id"), "conflict_group_id", "left_semi").join(conflict_winners(memories).select("id"), "id", "left_anti")

    return {
        "expired": lambda m: current(m).where(ttl_expired(now)),
        "decayed": lambda m: current(m).where(session_decayed(now)),
        "consolidated": lambda m: consolidate(m, threshold),
        "retired": lambda m: current(m).where(retired(now)),
        "conflicts": lost,
    }


@dataclass(frozen=True)
class LifecycleRun:
    memories: DataFrame  # what is left, resolved members of conflict groups among it; in a dry run all, as they were
    actions: DataFrame  # (id, action)
    report: DataFrame  # (phase, n, error): n is 0 where the phase failed

    def checked(self) -> LifecycleRun:
        """An error if a phase failed. What the others did is in the tables all the same."""
        bad = [f"{r['phase']}: {r['error']}" for r in self.report.where("error is not null").collect()]
        if bad:
            raise RuntimeError("lifecycle: " + "; ".join(bad))
        return self


def run_phases(memories: DataFrame, now: datetime, steps: Mapping[str, Phase] | None = None, dry_run: bool = False) -> LifecycleRun:
    """Run the phases (those of ``phases`` if none are given) one after the other; each sees what the ones before it left, in a dry run all.

    Rows of a phase go, but for conflicts, whose groups are resolved. A phase that fails when it is run is reported, and the others go on. Only the ids
    that phases name are stored: what is left is the memories without them, so a phase reads no columns but its own."""
    left, did, report = memories, [], []
    for name, step in (phases(now) if steps is None else steps).items():
        try:
            hit = cut_off(step(left).select("id").distinct().withColumn("action", F.lit(name)))
            n = hit.count()
        except Exception as e:  # noqa: BLE001  whatever stops one phase, the others are to go on
            report.append((name, 0, (str(e).splitlines() or [type(e).__name__])[0]))
            continue
        did.append(hit)
        if n and not dry_run:
            left = resolve_conflicts(left) if name == "conflicts" else left.join(hit.select("id"), "id", "left_anti")
        report.append((name, n, None))
    spark = memories.sparkSession
    actions = memories.select("id", F.lit("").alias("action")).limit(0)
    for hit in did:
        actions = actions.unionByName(hit)
    return LifecycleRun(left, actions, spark.createDataFrame(report, "phase string, n long, error string"))
