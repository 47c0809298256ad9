"""The entity graph: facts are edges between entities, and both name memories."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..schema import RELATIONS
from ..session import cut_off
from .greedy import alike_classes


def active(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("expired_at").isNull())


def undirected(facts: DataFrame) -> DataFrame:
    """(fact_id, src, dst, source_memory_ids) of every active fact in both directions, in one pass."""
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = F.array(way("source_entity_id", "target_entity_id"), way("target_entity_id", "source_entity_id"))
    return active(facts).select(F.col("id").alias("fact_id"), "source_memory_ids", F.explode(both).alias("way")).select("fact_id", "way.src", "way.dst", "source_memory_ids")


def expand(facts: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One hop from (entity_id): distinct (memory_id) of the facts passed, and distinct (entity_id) of the neighbours."""
    passed = undirected(facts).join(seeds.select(F.col("entity_id").alias("src")).distinct(), "src")
    return passed.select(F.explode("source_memory_ids").alias("memory_id")).distinct(), passed.select(F.col("dst").alias("entity_id")).distinct()


def memories_within(facts: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(memory_id, hops): the first hop at which a memory is met, going on from entities not visited before.

    The facts are read once a hop; what a hop passed is cut off, so that later hops don't compute it again."""
    visited = frontier = seeds.select("entity_id").distinct()
    found = []
    for hop in range(1, depth + 1):
        passed = cut_off(undirected(facts).join(frontier.withColumnRenamed("entity_id", "src"), "src").select("dst", "source_memory_ids").distinct())
        found.append(passed.select(F.explode("source_memory_ids").alias("memory_id"), F.lit(hop).alias("hops")))
        frontier = passed.select(F.col("dst").alias("entity_id")).distinct().join(visited, "entity_id", "left_anti")
        visited = visited.unionByName(frontier)
    return reduce(DataFrame.unionByName, found).groupBy("memory_id").agg(F.min("hops").alias("hops"))


def ranks_of(near: DataFrame, limit: int) -> DataFrame:
    """(id, hops, rank) of the nearest of (memory_id, hops)."""
    few = near.withColumnRenamed("memory_id", "id").orderBy("hops", "id").limit(limit)
    return few.withColumn("rank", F.row_number().over(W.orderBy("hops", "id")))


def graph_ranks(facts: DataFrame, seeds: DataFrame, limit: int, depth: int = 2) -> DataFrame:
    """(id, hops, rank) of the nearest memories."""
    return ranks_of(memories_within(facts, seeds, depth), limit)


def fact_memories(found: DataFrame) -> DataFrame:
    """(memory_id, rank) of the memories that found facts (id, score, source_memory_ids) name, in the order in which they are met, each once."""
    named = found.select("score", "id", F.posexplode("source_memory_ids").alias("pos", "memory_id"))
    first = named.groupBy("memory_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "pos")).alias("met"))
    return first.withColumn("rank", F.row_number().over(W.orderBy("met", "memory_id"))).drop("met")


def recall_ids(facts: DataFrame, seeds: DataFrame, found: DataFrame, limit: int, depth: int = 2) -> DataFrame:
    """(id, rank) of the nearest memories of the seeds; without seeds (a top-k, so few) those of the facts ``found`` by a search."""
    if not seeds.isEmpty():
        return graph_ranks(facts, seeds, limit, depth).select("id", "rank")
    return fact_memories(found).where(F.col("rank") <= limit).select(F.col("memory_id").alias("id"), "rank")


def subgraph(facts: DataFrame, seed: str, hops: int = 3, limit: int = 200) -> DataFrame:
    """(dist, entity_id, fact_id): ends and last edges of paths from the seed that repeat no edge, nearest first.

    Goes no further once the levels so far fill the limit, as all further rows come after them."""
    edges = undirected(facts).select("fact_id", "src", "dst")
    paths = edges.where(F.col("src") == seed).select(F.col("dst").alias("at"), F.array("fact_id").alias("path"))
    rows = None
    for dist in range(1, hops + 1):
        paths = cut_off(paths)
        level = paths.select(F.lit(dist).alias("dist"), F.col("at").alias("entity_id"), F.element_at("path", -1).alias("fact_id")).distinct()
        rows = level if rows is None else rows.unionByName(level)
        if dist == hops or rows.limit(limit).count() == limit:
            break
        paths = paths.join(edges, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("fact_id"))).select(F.col("dst").alias("at"), F.array_append("path", F.col("fact_id")).alias("path"))
    return rows.orderBy("dist", "entity_id", "fact_id").limit(limit)


def subgraph_nodes(paths: DataFrame) -> DataFrame:
    return paths.groupBy("entity_id").agg(F.min("dist").alias("dist"))


def facts_between(facts: DataFrame, a: str, b: str) -> DataFrame:
    return active(facts).where((F.least("source_entity_id", "target_entity_id") == min(a, b)) & (F.greatest("source_entity_id", "target_entity_id") == max(a, b)))


def facts_for_entity(facts: DataFrame, entity: str) -> DataFrame:
    return active(facts).where((F.col("source_entity_id") == entity) | (F.col("target_entity_id") == entity))


def facts_of_memory(facts: DataFrame, memory) -> DataFrame:
    """Expired facts too."""
    return facts.where(F.array_contains("source_memory_ids", memory))


def memories_of_facts(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("id").alias("fact_id"), F.explode("source_memory_ids").alias("memory_id")).distinct()


def _new_enough(mine: DataFrame, lists: DataFrame, most: int) -> DataFrame:
    """(id, candidate_id, created_at): what the lists (src, candidate_id, created_at, __n) of its entities (src, id) have for a memory, as new as the newest last row of a full one."""
    last = lists.where(F.col("__n") == most + 1).select("src", F.col("created_at").alias("oldest"))
    bounds = mine.join(last, "src").groupBy("id").agg(F.max("oldest").alias("oldest"))
    met = mine.join(bounds, "id", "left").join(lists, "src").where("id <> candidate_id AND (oldest IS NULL OR created_at IS NULL OR created_at >= oldest)")
    return met.select("id", "candidate_id", "created_at")


def linked_by_entity(memories: DataFrame, facts: DataFrame, most: int = 20) -> DataFrame:
    """(id, candidate_id, rank): for each of (id, created_at) the newest ``most`` other memories that active facts of its entities name.

    Each entity keeps its newest ``most`` and one more (the memory itself may be among them) before it meets its memories, so a hub that names
    a third of all memories costs each of them no more rows than any entity. A full list has ``most`` others, so what is older than the last
    of it is not among the newest of any memory in it; a memory takes from all its lists only what is as new as the newest of these last ones."""
    newest = lambda group: F.row_number().over(W.partitionBy(group).orderBy(F.desc("created_at"), "candidate_id"))
    known = memories.select(F.col("id").alias("candidate_id"), "created_at")
    named = cut_off(undirected(facts).select("src", F.explode("source_memory_ids").alias("candidate_id")).distinct().join(known, "candidate_id"))
    lists = cut_off(named.withColumn("__n", newest("src")).where(F.col("__n") <= most + 1))
    met = _new_enough(named.select("src", F.col("candidate_id").alias("id")), lists, most).distinct()
    return met.withColumn("rank", newest("id")).where(F.col("rank") <= most).select("id", "candidate_id", "rank")


def episodes_of_memory(episodes: DataFrame, memory) -> DataFrame:
    return episodes.where(F.array_contains("memory_ids", memory))


def append_unique(rows: DataFrame, column: str, key, value) -> DataFrame:
    """``rows`` with the value added to the array of the row with that id, once."""
    added = F.array_union(F.coalesce(F.col(column), F.array().cast(rows.schema[column].dataType)), F.array(F.lit(value)))
    return rows.withColumn(column, F.when(F.col("id") == key, added).otherwise(F.col(column)))


def link_memory(entities: DataFrame, entity, memory) -> DataFrame:
    """``entities`` with the memory added to the entity's; an entity that is not there is an error."""
    if entities.where(F.col("id") == entity).isEmpty():
        raise LookupError("not found")
    return append_unique(entities, "memory_ids", entity, memory)


def invalidate_fact(facts: DataFrame, key, expired_at: datetime, invalid_at: datetime) -> DataFrame:
    hit = F.col("id") == key
    return facts.withColumn("expired_at", F.when(hit, F.lit(expired_at)).otherwise(F.col("expired_at"))).withColumn("invalid_at", F.when(hit, F.lit(invalid_at)).otherwise(F.col("invalid_at")))


def normalise_relation(column: str):
    name = F.upper(F.trim(F.col(column)))
    return F.when(name.isin(*RELATIONS), name).otherwise("RELATES_TO")


def migrate_relations(facts: DataFrame) -> DataFrame:
    """``label``: what the stored relation normalises to, for edges that are labelled RELATES_TO."""
    return facts.withColumn("label", F.when(F.col("label") == "RELATES_TO", normalise_relation("relation_type")).otherwise(F.col("label")))


def communities(facts: DataFrame) -> DataFrame:
    """(entity_id, community): connected components of the active facts, named by their smallest entity.

    Rounds of hooking to the smallest neighbour and of pointer jumping; each is cut off in the checkpoint folder."""
    edges = cut_off(undirected(facts).select("src", "dst").distinct())
    labels = cut_off(edges.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "entity_id"))
    while True:
        near = edges.join(labels.withColumnRenamed("entity_id", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["entity_id"] == near["src"]).select("entity_id", "label", F.least("label", "near").alias("hooked"))
        jumps = labels.select(F.col("entity_id").alias("hooked"), F.col("label").alias("jump"))
        new = cut_off(hooked.join(jumps, "hooked").select("entity_id", "label", F.least("hooked", "jump").alias("new")))
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("entity_id", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "community")


def community_memories(entities: DataFrame, labels: DataFrame, community: str) -> DataFrame:
    members = labels.where(F.col("community") == community).select(F.col("entity_id").alias("id"))
    return entities.join(members, "id").select(F.explode("memory_ids").alias("memory_id")).distinct()


#: Length of the runs that names are looked up by, and how many known names may have one before vectors are asked first. It changes no result.
GRAM, HOT_NAMES = 3, 200


def _runs(c: str, n: int) -> Column:
    return F.when(F.char_length(c) >= n, F.transform(F.sequence(F.lit(1), F.char_length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _by_runs(known: DataFrame) -> DataFrame:
    """(entity_id, low, gram) of (entity_id, name): every name with all its runs."""
    theirs = known.select("entity_id", F.lower("name").alias("low"))
    return theirs.select("*", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[_runs("low", n) for n in range(1, GRAM + 1)]))).alias("gram"))


def _rarest_runs(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(id, asked, holders, gram): of the runs of each name (id, name) that which the fewest known names have; none if some run is in no known name."""
    ours = asked.select("id", F.lower("name").alias("asked"))
    wanted = ours.select("id", "asked", F.explode(F.when(F.char_length("asked") < GRAM, F.array("asked")).otherwise(F.array_distinct(_runs("asked", GRAM)))).alias("gram")).distinct()
    holders = held.groupBy("gram").agg(F.count(F.lit(1)).alias("holders"))
    rarest = F.min(F.struct(F.coalesce("holders", F.lit(0)).alias("holders"), "gram")).alias("r")
    return wanted.join(holders, "gram", "left").groupBy("id", "asked").agg(rarest).where("r.holders > 0").select("id", "asked", "r.holders", "r.gram")


def names_holding(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(id, entity_id, embedding, name_embedding) where the name of (entity_id, name, name_embedding) has that of (id, name, embedding) in it, in any case.

    A name is looked up by that of its runs of three characters (or by itself, if shorter) which the fewest known names have, and then verified."""
    held = _by_runs(known)
    met = _rarest_runs(asked, held).join(held, "gram").where(F.contains("low", F.col("asked"))).select("id", "asked", "entity_id")
    ours = asked.select("id", F.lower("name").alias("asked"), "embedding")
    return met.join(ours, ["id", "asked"]).join(known.select("entity_id", "name_embedding"), "entity_id").select("id", "entity_id", "embedding", "name_embedding")


def alike_names(asked: DataFrame, known: DataFrame, threshold: float, hot_names: int = HOT_NAMES) -> DataFrame:
    """(id, entity_id) of ``names_holding`` with a cosine above the threshold.

    A name that only runs in very many known names could be looked up by ("CUST" among customers) would be paired with all of these. For
    such names the alike vectors come first, by classes of equal ones, and the names are compared after that."""
    held = _by_runs(known)
    looked_up = cut_off(_rarest_runs(asked, held))
    rare, hot = looked_up.where(F.col("holders") <= hot_names), looked_up.where(F.col("holders") > hot_names)
    ours = asked.select("id", F.lower("name").alias("asked"), "embedding")
    theirs = known.select("entity_id", F.lower("name").alias("low"), "name_embedding")
    alike = cosine(F.col("embedding"), F.col("name_embedding")) > threshold
    met = rare.join(held, "gram").where(F.contains("low", F.col("asked"))).select("id", "asked", "entity_id")
    found = met.join(ours, ["id", "asked"]).join(theirs, "entity_id").where(alike).select("id", "entity_id")
    if hot.isEmpty():
        return found
    common = ours.join(hot.select("id", "asked"), ["id", "asked"], "left_semi")
    marked = lambda df, mark, key, vector: df.select(F.concat(F.lit(mark), F.xxhash64(key, vector).cast("string"), F.lit(":"), F.col(key).cast("string")).alias("id"), F.col(key).alias("row"), F.transform(vector, lambda x: x.cast("double")).alias("embedding"))
    a, k = marked(common, "a", "id", "embedding"), marked(theirs, "k", "entity_id", "name_embedding")
    classes, links = alike_classes(a.select("id", "embedding").unionByName(k.select("id", "embedding")), threshold - 1e-9)
    side = lambda df, row, of: df.join(classes, "id").select(F.col("row").alias(row), F.col("class").alias(of))
    near = side(a, "id", "a").join(links.select("a", "b"), "a").join(side(k, "entity_id", "b"), "b").select("id", "entity_id").distinct()
    held_too = near.join(common, "id").join(theirs, "entity_id").where(F.contains("low", F.col("asked")) & alike)
    return found.unionByName(held_too.select("id", "entity_id"))


def resolve_entities(extracted: DataFrame, entities: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(id, entity_id, how) of extracted (id, name, aliases, embedding): by name, then alias in either direction, then cosine; null is new."""
    fold = lambda c: F.lower(F.trim(c))
    known = entities.select(F.col("id").alias("entity_id"), fold(F.col("name")).alias("key"))
    named = extracted.select("id", fold(F.col("name")).alias("key"))
    alias = lambda rows, key: rows.select(F.col(key), F.explode("aliases").alias("a")).select(key, fold(F.col("a")).alias("key"))
    by_name = named.join(known, "key").select("id", "entity_id", F.lit(1).alias("order"))
    ours = alias(entities.withColumnRenamed("id", "entity_id"), "entity_id")
    by_alias = named.join(ours, "key").select("id", "entity_id", F.lit(2).alias("order")).unionByName(alias(extracted, "id").join(known, "key").select("id", "entity_id", F.lit(2).alias("order")))
    with_vectors = entities.where("name_embedding is not null").select(F.col("id").alias("entity_id"), "name", "name_embedding")
    by_vector = alike_names(extracted.where("embedding is not null"), with_vectors, threshold).select("id", "entity_id", F.lit(3).alias("order"))
    best = by_name.unionByName(by_alias).unionByName(by_vector).groupBy("id").agg(F.min(F.struct("order", "entity_id")).alias("m"))
    how = F.when(F.col("m.order") == 1, "name").when(F.col("m.order") == 2, "alias").when(F.col("m.order") == 3, "embedding").otherwise("new")
    return extracted.select("id").join(best, "id", "left").select("id", F.col("m.entity_id").alias("entity_id"), how.alias("how"))


def resolve_facts(new: DataFrame, facts: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(id, action, existing_id): skip a fact with the same text and ends as an active one; else by ``verdicts`` (id, existing_id, kind), where contradicted comes before duplicate; else insert."""
    ends = ["source_entity_id", "target_entity_id"]
    same = new.select("id", "fact", *ends).join(active(facts).select(F.col("id").alias("existing_id"), "fact", *ends), ["fact", *ends]).groupBy("id").agg(F.min("existing_id").alias("same_id"))
    out = new.select("id").join(same, "id", "left")
    if verdicts is None:
        return out.select("id", F.when(F.col("same_id").isNotNull(), "skip").otherwise("insert").alias("action"), F.col("same_id").alias("existing_id"))
    order = F.when(F.col("kind") == "contradicted", 0).when(F.col("kind") == "duplicate", 1)
    told = verdicts.withColumn("order", order).where("order is not null").groupBy("id").agg(F.min(F.struct("order", "existing_id")).alias("v"))
    action = F.when(F.col("same_id").isNotNull(), "skip").when(F.col("v.order") == 0, "invalidate").when(F.col("v.order") == 1, "skip").otherwise("insert")
    return out.join(told, "id", "left").select("id", action.alias("action"), F.coalesce("same_id", "v.existing_id").alias("existing_id"))


def valid_facts(extracted: DataFrame, entities: DataFrame) -> DataFrame:
    """Extracted facts (source_name, target_name, ..) whose ends are known by name and differ, with the ends' ids."""
    ids = entities.select(F.col("id").alias("eid"), F.lower("name").alias("key"))
    end = lambda c: ids.select(F.col("eid").alias(f"{c}_entity_id"), F.col("key").alias(f"{c}_key"))
    rows = extracted.withColumn("source_key", F.lower("source_name")).withColumn("target_key", F.lower("target_name"))
    return rows.join(end("source"), "source_key").join(end("target"), "target_key").where("source_entity_id <> target_entity_id").drop("source_key", "target_key")
