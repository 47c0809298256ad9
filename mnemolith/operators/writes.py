"""Writes as rewrites of tables: upsert, deduplication, reinforcement, conflicts, contradictions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import significant_words, trimmed
from ..session import cut_off, spread
from .greedy import alike_classes, places, take_in

DEDUP, REINFORCE, DUPLICATE, BOOST = 0.92, 0.80, 0.95, 0.05
CANDIDATE, AUTO_CONFIRM, MOST_CANDIDATES = 0.75, 0.82, 20

# Phrases that signal a relation of which a subject has one at a time.
_WORK = ["works at", "employed at", "employed by", "joined", "started at", "job at"]
_ROLE = ["role is", "position is", "title is", "works as", "his role", "her role", "their role"]
_PLACE = ["lives in", "located in", "based in", "moved to", "relocated to"]
_LEAD = ["ceo of", "leads ", "leading ", "head of"]
SIGNALS = {
    "WORKS_AT": _WORK, "EMPLOYED_BY": _WORK, "HAS_ROLE": _ROLE, "LOCATED_IN": _PLACE, "LIVES_IN": _PLACE, "BASED_IN": _PLACE,
    "MARRIED_TO": ["married to", "spouse is", "wife is", "husband is", "partner is"], "REPORTS_TO": ["reports to", "manager is", "boss is"], "CEO_OF": _LEAD, "LEADS": _LEAD,
}


def upsert(memories: DataFrame, incoming: DataFrame, now: datetime) -> DataFrame:
    """Replace rows by id with the last of ``incoming`` (with ``seq``); a null embedding keeps the old one; what an incoming row supersedes ends now."""
    last = incoming.withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("seq")))).where("__n = 1").drop("__n", "seq")
    old = memories.select("id", F.col("embedding").alias("__old"))
    fresh = last.join(old, "id", "left").withColumn("embedding", F.coalesce("embedding", "__old")).withColumn("valid_from", F.coalesce("valid_from", F.lit(now))).select(*memories.columns)
    ended = incoming.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id"), F.lit(True).alias("__ended")).distinct()
    kept = memories.join(last.select("id"), "id", "left_anti").join(ended, "id", "left").withColumn("valid_to", F.when(F.col("__ended"), F.lit(now)).otherwise(F.col("valid_to"))).select(*memories.columns)
    return kept.unionByName(fresh)


def upsert_by_key(table: DataFrame, incoming: DataFrame, key: str, keep: tuple[str, ...] = (), union: tuple[str, ...] = ()) -> DataFrame:
    """Merge on ``key``: columns in ``keep`` stay as they were on a match, arrays in ``union`` are united, the rest is replaced."""
    t, i = table.alias("t"), incoming.alias("i")
    joined = t.join(i, F.col(f"t.{key}") == F.col(f"i.{key}"), "full_outer")
    matched_or_new = F.col(f"i.{key}").isNotNull()

    def column(c: str) -> Column:
        old, new = F.col(f"t.{c}"), F.col(f"i.{c}")
        if c in keep or c == key:
            return F.coalesce(old, new)
        if c in union:
            return F.when(old.isNotNull() & new.isNotNull(), F.array_union(old, new)).otherwise(F.coalesce(old, new))
        return F.when(matched_or_new, new).otherwise(old)

    return joined.select(*[column(c).alias(c) for c in table.columns])


def upsert_facts(facts: DataFrame, incoming: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with both ends known replace those of the same id; the others change nothing."""
    ends = entities.select("id")
    known = incoming.join(ends.withColumnRenamed("id", "source_entity_id"), "source_entity_id", "left_semi").join(ends.withColumnRenamed("id", "target_entity_id"), "target_entity_id", "left_semi")
    return upsert_by_key(facts, known, "id")


def dedup_decision(incoming: DataFrame, best: DataFrame, threshold: float = DEDUP) -> DataFrame:
    """(id, status, existing_id): of (id, content) with the best match (id, existing_id, existing_content, score): created, updated if longer in bytes, else duplicate."""
    hit = F.col("score") >= threshold
    status = F.when(~F.coalesce(hit, F.lit(False)), "created").when(F.octet_length("content") > F.octet_length("existing_content"), "updated").otherwise("duplicate")
    return incoming.join(best, "id", "left").select("id", status.alias("status"), F.when(hit, F.col("existing_id")).alias("existing_id"))


def capture_decision(score: Column, reinforce: float = REINFORCE, duplicate: float = DUPLICATE) -> Column:
    """What becomes of a captured memory by its best match."""
    return F.when(score >= duplicate, "duplicate").when(score >= reinforce, "reinforce").otherwise("store")


def reinforced(memories: DataFrame, hits: DataFrame, now: datetime, boost: float = BOOST) -> DataFrame:
    """``memories`` with the ids in ``hits`` more trusted, once for each time they are there."""
    n = hits.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    more = F.coalesce("__n", F.lit(0))
    return (
        memories.join(n, "id", "left")
        .withColumn("confidence", F.when(more > 0, F.least(F.lit(1.0), F.col("confidence") + boost * more)).otherwise(F.col("confidence")))
        .withColumn("reinforced_count", (F.coalesce("reinforced_count", F.lit(0)) + more).cast("int"))
        .withColumn("reinforced_at", F.when(more > 0, F.lit(now)).otherwise(F.col("reinforced_at")))
        .select(*memories.columns)
    )


def tag_conflicts(memories: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Both ids of each conflict (a, b, group_id) become active members of the group; the last group by name holds."""
    ids = conflicts.select(F.col("a").alias("id"), "group_id").unionByName(conflicts.select(F.col("b").alias("id"), "group_id")).groupBy("id").agg(F.max("group_id").alias("__group"))
    joined = memories.join(ids, "id", "left")
    return joined.withColumn("conflict_group_id", F.coalesce("__group", "conflict_group_id")).withColumn("conflict_status", F.when(F.col("__group").isNotNull(), "active").otherwise(F.col("conflict_status"))).select(*memories.columns)


def signalled(text: Column) -> Column:
    """Relations that the text has a signal phrase of."""
    return _signalled(F.lower(text))


def _signalled(low: Column) -> Column:
    has = lambda phrases: F.greatest(*[F.contains(low, F.lit(p)) for p in phrases]) if len(phrases) > 1 else F.contains(low, F.lit(phrases[0]))
    return F.filter(F.array(*[F.when(has(p), F.lit(r)) for r, p in SIGNALS.items()]), lambda x: x.isNotNull())


def with_signals(rows: DataFrame, text: str = "content") -> DataFrame:
    """``rows`` with ``low``, their texts in lower case, and ``signals``, the relations that these signal; each text is lowered once."""
    return spread(rows).withColumn("low", F.lower(text)).withColumn("signals", _signalled(F.col("low")))


def differs(low: Column, fact: Column) -> Column:
    """Whether a text in lower case has fewer than half of the fact's significant words, of which there are some."""
    told = significant_words(fact)
    shared = F.size(F.filter(told, lambda w: F.contains(low, w)))
    return (F.size(told) > 0) & (shared < F.floor((F.size(told) + 1) / 2))


def fact_conflict(text: Column, relation: Column, fact: Column) -> Column:
    """Whether the text signals the fact's relation but has fewer than half of its significant words."""
    return F.array_contains(signalled(text), F.upper(relation)) & differs(F.lower(text), fact)


def contradictions(new: DataFrame, near: DataFrame, linked: DataFrame | None = None, confirm: Column | None = None, candidate: float = CANDIDATE, auto: float = AUTO_CONFIRM) -> DataFrame:
    """(id, candidate_id, score, stage): memories that contradict ``new`` (id, content).

    Candidates are the nearest (id, candidate_id, candidate_content, score) at or above the threshold, and those linked by entities, at the
    threshold; of both the first score holds. They must share a relation by keyword: ``candidate_signals``, where the candidates have that column
    in place of their content, are what ``signalled`` says of it. Above ``auto`` that is enough; below, ``confirm`` (a column of the candidate)
    decides, where there is one."""
    pool = near.where(F.col("score") >= candidate).withColumn("__o", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "candidate_id"))).where(F.col("__o") <= MOST_CANDIDATES).drop("__o")
    told = "candidate_signals" if "candidate_signals" in near.columns else "candidate_content"
    if linked is not None:
        extra = linked.join(pool.select("id", "candidate_id"), ["id", "candidate_id"], "left_anti")
        pool = pool.select("id", "candidate_id", told, "score").unionByName(extra.select("id", "candidate_id", told, F.lit(candidate).alias("score")))
    # The new texts are looked through once, not for each candidate.
    signals = cut_off(with_signals(new.select("id", "content")).select("id", F.col("signals").alias("__signals")))
    theirs = F.col(told) if told == "candidate_signals" else signalled(F.col(told))
    hits = signals.join(pool, "id").where(F.arrays_overlap("__signals", theirs))
    stage = F.when(F.col("score") >= auto, "auto").otherwise("confirmed" if confirm is not None else "keyword")
    sure = F.lit(True) if confirm is None else (F.col("score") >= auto) | confirm
    return hits.where(sure).select("id", "candidate_id", "score", stage.alias("stage"))


def delete_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


def delete_prefix(table: DataFrame, prefix: str) -> DataFrame:
    """Delete the one row whose id begins with ``prefix``; none or several are errors."""
    hit = F.startswith(F.col("id").cast("string"), F.lit(prefix))
    found = table.where(hit).select("id").limit(2).count()
    if found != 1:
        raise LookupError("not found" if not found else "ambiguous prefix")
    return table.where(~hit)


def delete_all(table: DataFrame) -> DataFrame:
    return table.limit(0)


def schema_violations(memories: DataFrame, entities: DataFrame) -> DataFrame:
    """(rule, key, n) of memory ids and entity names that are not unique."""
    check = lambda df, c, rule: df.groupBy(F.col(c).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "key", "n")
    return check(memories, "id", "memory id").unionByName(check(entities, "name", "entity name"))


def import_cleanse(rows: DataFrame, now: datetime) -> DataFrame:
    """Without blank contents; missing times are now."""
    out = rows.where(trimmed(F.col("content")) != "")
    for c in ("created_at", "updated_at", "last_accessed"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(now)))
    return out


def batch_dedup(incoming: DataFrame, stored: DataFrame, threshold: float = DEDUP, **rest: int) -> DataFrame:
    """(id, status, existing_id) of (id, seq, content, embedding), where each row also sees what earlier ones made of the store.

    A row joins the most alike record at or above the threshold and takes its place if it is longer; else it is a new record. Of records
    equally alike a stored one comes first, then the smaller id as text. Settled in rounds over all rows, see ``greedy``."""
    named = lambda mark, df: df.withColumn("id", F.concat(F.lit(mark), F.col("id").cast("string"))).withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)))
    new, old = named("n:", incoming), named("s:", stored)
    classes, links = alike_classes(new.select("id", "embedding").unionByName(old.select("id", "embedding")), threshold - 1e-12)
    arrived = new.select("id", places(F.col("seq"), F.col("id")).alias("place"), "size").join(classes, "id", "left")
    held = old.select("id", "size").join(classes, "id")
    done = take_in(arrived.select("id", "class", "place", "size"), held.select("id", "class", "size"), links, **rest)
    return done.select(F.substr("id", F.lit(3)).alias("id"), "status", F.when(F.col("status") != "created", F.substr("record.id", F.lit(3))).alias("existing_id"))
