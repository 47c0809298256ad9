"""Entities and facts of memories by a caller's models, what they add to the graph, and the counts.

Entities are looked for in every memory first. Facts are looked for after that, and a fact may have its ends in other memories than its
own: both must be names that were found in some memory of the run. What a model fails on counts as an error and holds up nothing else.

Defined results: a null text is empty; blank names are no entities; names are the same if they are in lower case and without white space around
them. A name that the graph knows keeps its entity; a new one is spelled, and has the type, that it had where it was first met. A statement
with the same ends, relation and text is one fact, whichever memories say it; facts of an entity with itself are left out. Links are
rows, not arrays, so a name that a third of all memories have is no group of its own anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import member_or, trimmed
from ..schema import ENTITY_TYPES
from ..session import cut_off, spread
from .graph import normalise_relation

#: Extractors give a list of dicts with these fields for a text; what they leave out is null.
ENTITY_FIELDS = ("name", "type")
FACT_FIELDS = ("source_name", "target_name", "relation_type", "fact")
Extractor = Callable[[str], list[dict]]


@dataclass(frozen=True)
class Extraction:
    entities: DataFrame  # (id, name, type, is_new) of every name found
    links: DataFrame  # (entity_id, memory_id)
    facts: DataFrame  # (id, source_entity_id, target_entity_id, relation_type, fact, memories): how many memories say it
    fact_links: DataFrame  # (fact_id, memory_id)
    counts: DataFrame  # (entities_extracted, facts_extracted, errors), one row


def found_in(text: Column, load: Callable[[], Extractor], fields: tuple[str, ...]) -> Column:
    """What an extractor finds in each text, null where it fails; ``load`` runs once for each task."""

    def attempt(extract: Extractor, t: str | None) -> list[dict] | None:
        try:
            return [{f: row.get(f) for f in fields} for row in extract(t or "")]
        except Exception:  # noqa: BLE001  whatever a model throws, the other texts go on
            return None

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extract = load()
        for texts in parts:
            yield pd.Series([attempt(extract, t) for t in texts], dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, f"array<struct<{','.join(f'{f}:string' for f in fields)}>>")(text)


def _looked_for(memories: DataFrame, load: Callable[[], Extractor], fields: tuple[str, ...]) -> DataFrame:
    """(memory_id, found), kept: a model is asked once for each text."""
    return cut_off(spread(memories.select("id", "content")).select(F.col("id").alias("memory_id"), found_in(F.col("content"), load, fields).alias("found")))


def _key(name: str) -> Column:
    return F.lower(trimmed(F.col(name)))


def _new_id(key: str) -> Column:
    return F.sha2(F.concat(F.lit("entity:"), key), 256)


def _named(parts: tuple[str, ...]) -> Column:
    return F.sha2(F.to_json(F.array(*parts)), 256)


def extract(memories: DataFrame, entities: DataFrame, load_entities: Callable[[], Extractor], load_facts: Callable[[], Extractor]) -> Extraction:
    """Run both extractors over (id, content); ``entities`` (id, name) are those that the graph has.

    The model for facts isn't loaded if no memory has an entity."""
    asked = _looked_for(memories, load_entities, ENTITY_FIELDS)
    said = asked.select("memory_id", F.posexplode("found").alias("pos", "e")).select("memory_id", "pos", _key("e.name").alias("key"), trimmed(F.col("e.name")).alias("name"), "e.type")
    mentions = cut_off(said.where("key <> ''"))
    first = F.min_by(F.struct("name", "type"), F.struct("memory_id", "pos")).alias("first")
    known = entities.select("id", _key("name").alias("key")).groupBy("key").agg(F.min("id").alias("known_id"))
    named = mentions.groupBy("key").agg(first).join(known, "key", "left").withColumn("id", F.coalesce("known_id", _new_id("key")))
    # Rows on the way hold an entity by its first key and the id that the graph gave it, if any: less than its id, and the same for all keys of one.
    same = W.partitionBy("id")
    names = cut_off(named.select("key", "id", F.min("key").over(same).alias("entity"), F.max("known_id").over(same).alias("given"), "first.name", member_or(F.col("first.type"), ENTITY_TYPES, "concept").alias("type"), F.col("known_id").isNull().alias("is_new")))
    links = mentions.select("key", "memory_id").join(names.select("key", "entity", "given"), "key").select("entity", "given", "memory_id").distinct().select(F.coalesce("given", _new_id("entity")).alias("entity_id"), "memory_id")
    failed = lambda rows: rows.agg(F.count_if(F.col("found").isNull()).alias("failed"))

    if names.isEmpty():
        told = memories.limit(0).select(F.col("id").alias("memory_id"), F.lit(None).cast(f"array<struct<{','.join(f'{f}:string' for f in FACT_FIELDS)}>>").alias("found"))
    else:
        told = _looked_for(memories, load_facts, FACT_FIELDS)
    stated = told.select("memory_id", F.explode("found").alias("f")).select("memory_id", _key("f.source_name").alias("source_key"), _key("f.target_name").alias("target_key"), F.col("f.relation_type").alias("relation_type"), F.coalesce("f.fact", F.lit("")).alias("fact"))
    end = lambda side: names.select(F.col("key").alias(f"{side}_key"), F.col("entity").alias(f"{side}_entity"), F.col("given").alias(f"{side}_given"))
    both = stated.join(end("source"), "source_key").join(end("target"), "target_key").where("source_entity <> target_entity")
    short = ("source_entity", "source_given", "target_entity", "target_given", "relation_type", "fact")
    placed = cut_off(both.withColumn("relation_type", F.coalesce(normalise_relation("relation_type"), F.lit("RELATES_TO"))).groupBy(*short, "memory_id").agg(F.count(F.lit(1)).alias("times")))
    ids = [F.coalesce(f"{side}_given", _new_id(f"{side}_entity")).alias(f"{side}_entity_id") for side in ("source", "target")]
    columns = ("source_entity_id", "target_entity_id", "relation_type", "fact")
    whole = lambda rows, rest: rows.select(*ids, "relation_type", "fact", rest).select(_named(columns).alias("id"), *columns, rest)

    counts = mentions.agg(F.count(F.lit(1)).alias("entities_extracted")).join(F.broadcast(placed.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("facts_extracted"))), how="cross")
    errors = failed(asked).unionByName(failed(told)).agg(F.sum("failed").alias("errors"))
    return Extraction(
        names.select("id", "name", "type", "is_new"),
        links,
        whole(placed.groupBy(*short).agg(F.count(F.lit(1)).alias("memories")), "memories"),
        whole(placed, "memory_id").select(F.col("id").alias("fact_id"), "memory_id"),
        counts.join(F.broadcast(errors), how="cross"),
    )
