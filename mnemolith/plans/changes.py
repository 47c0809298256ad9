"""Queries on single rows, writes, links between records, conflicts and contradictions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import contradiction, evaluation, graph, lifecycle, versions, writes
from ..operators.filters import SearchFilters
from ..operators.search import nearest_few_before, search_facts, seed_entities, similar_pairs
from ..session import cut_off
from ..sources import tables as T
from .records import VECTORS
from .registry import query
from .retrieval import CURRENT, ENT, FAC, MEASURES, QUESTIONS, RESULTS, RETRIEVED, SCORED, M, eval_results

NOW = "TIMESTAMP '2024-02-01'"


@query("SELECT id, valid_to FROM memories WHERE visibility <> 'sensitive' AND type = 'rule'", (M,))
def filter_with_old_versions(spark, sf_dir):
    return SearchFilters(type="rule", include_invalidated=True).apply(T.memories(spark, sf_dir)).select("id", "valid_to")


@query("SELECT id, confidence FROM memories WHERE confidence >= 0.5", (M,))
def capture_confidence(spark, sf_dir):
    return T.memories(spark, sf_dir).where(X.confident(F.col("confidence"))).select("id", "confidence")


@query(f"SELECT id, CASE WHEN id IN (3, 5) THEN {NOW} ELSE valid_to END AS valid_to FROM memories", (M,))
def invalidate_memories(spark, sf_dir):
    """One of the ids is unknown and changes nothing."""
    return versions.invalidate(T.memories(spark, sf_dir), [3, 5, -1], T.NOW).select("id", "valid_to")


@query("SELECT id, created_at AS valid_from FROM memories", (M,))
def validity_backfill(spark, sf_dir):
    """Memories without a start, as before versions were kept, get the time of their creation."""
    rows = T.memories(spark, sf_dir).withColumn("valid_from", F.when(F.col("scope") != "ttl", F.col("valid_from")))
    return versions.backfill_validity(rows).select("id", "valid_from")


@query("SELECT id, strlen(content) + CASE WHEN type = 'preference' THEN 8 ELSE 0 END AS n, CASE WHEN type = 'preference' THEN 0.9::double ELSE confidence END AS confidence, type = 'preference' AND content IS NOT NULL AS content_changed FROM memories", (M,))
def patch_memories(spark, sf_dir):
    memories = T.memories(spark, sf_dir)
    changes = memories.where("type = 'preference'").select("id", F.concat(F.lit("patched "), "content").alias("content"), F.lit(0.9).alias("confidence"))
    return versions.patch(memories, changes).select("id", F.octet_length("content").cast("long").alias("n"), "confidence", "content_changed")


@query("SELECT id, scope FROM memories WHERE scope <> 'session'", (M,))
def delete_memories(spark, sf_dir):
    memories = T.memories(spark, sf_dir)
    return writes.delete_ids(memories, memories.where("scope = 'session'")).select("id", "scope")


@query("SELECT id FROM entities WHERE id <> 'n24'", (ENT,))
def delete_by_prefix(spark, sf_dir):
    return writes.delete_prefix(T.entities(spark, sf_dir), "n24").select("id")


@query(
    """SELECT id, CASE WHEN type = 'person' THEN name || '!' ELSE name END AS name, CASE WHEN type = 'person' THEN 'again,' ELSE '' END || aliases[1] AS aliases,
      CASE WHEN type = 'person' THEN len(list_distinct(list_append(memory_ids, 1))) ELSE len(memory_ids) END AS n FROM entities
    UNION ALL SELECT 'x' || id, 'new ' || name, '', 0 FROM entities WHERE type = 'concept'""",
    (ENT,),
)
def entity_upsert(spark, sf_dir):
    """Persons come in again with a new name, another alias and another memory; concepts come in under new ids."""
    entities = T.entities(spark, sf_dir)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    again = entities.where("type = 'person'").select("id", F.concat("name", F.lit("!")).alias("name"), "type", F.array(F.lit("again")).alias("aliases"), F.array(F.lit(1).cast("long")).alias("memory_ids"))
    new = entities.where("type = 'concept'").select(F.concat(F.lit("x"), "id").alias("id"), F.concat(F.lit("new "), "name").alias("name"), "type", none("string").alias("aliases"), none("long").alias("memory_ids"))
    merged = writes.upsert_by_key(entities, again.unionByName(new), "id", union=("aliases", "memory_ids"))
    return merged.select("id", "name", F.array_join(F.array_sort("aliases"), ",").alias("aliases"), F.size("memory_ids").cast("long").alias("n"))


@query("SELECT id, CASE WHEN relation_type = 'LOCATED_IN' THEN fact || ' now' ELSE fact END AS fact FROM facts", (FAC,))
def fact_upsert(spark, sf_dir):
    """Facts with unknown ends come in too, and change nothing."""
    facts = T.facts(spark, sf_dir).select("id", "source_entity_id", "target_entity_id", "relation_type", "fact")
    told = facts.where("relation_type = 'LOCATED_IN'").withColumn("fact", F.concat("fact", F.lit(" now")))
    lost = facts.where("relation_type = 'BASED_IN'").withColumn("source_entity_id", F.lit("nobody")).withColumn("fact", F.lit("lost"))
    return writes.upsert_facts(facts, told.unionByName(lost), T.entities(spark, sf_dir)).select("id", "fact")


@query(f"SELECT id, CASE WHEN id = (SELECT min(id) FROM facts WHERE relation_type = 'PART_OF') THEN {NOW} ELSE expired_at END AS expired_at FROM facts", (FAC,))
def fact_invalidation(spark, sf_dir):
    facts = T.facts(spark, sf_dir)
    key = facts.where("relation_type = 'PART_OF'").agg(F.min("id")).first()[0]
    return graph.invalidate_fact(facts.withColumn("invalid_at", F.lit(None).cast("timestamp")), key, T.NOW, datetime(2024, 1, 1)).select("id", "expired_at")


@query("SELECT id, array_to_string(list_sort(CASE WHEN id = 'n3' THEN list_distinct(list_append(memory_ids, 5)) ELSE memory_ids END), ',') AS memory_ids FROM entities", (ENT,))
def entity_memory_link(spark, sf_dir):
    linked = graph.link_memory(T.entities(spark, sf_dir), "n3", 5)
    return linked.select("id", F.array_join(F.array_sort("memory_ids").cast("array<string>"), ",").alias("memory_ids"))


@query("SELECT id AS fact_id, unnest(source_memory_ids) AS memory_id FROM facts WHERE expired_at IS NULL", (FAC,))
def memories_of_facts(spark, sf_dir):
    return graph.memories_of_facts(graph.active(T.facts(spark, sf_dir)))


@query("SELECT u.conv_id, u.turn FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND (u.conv_id = 2 OR u.turn = 2)")
def episodes_of_memory(spark, sf_dir):
    """Turns as episodes that name the memories of their numbers."""
    episodes = T.turns(spark, sf_dir).withColumn("memory_ids", F.array("conv_id", "turn"))
    return graph.episodes_of_memory(episodes, 2).select("conv_id", "turn")


@query("SELECT 'c' || c_custkey::varchar AS source_entity_id, 'n' || c_nationkey::varchar AS target_entity_id FROM customer")
def extracted_facts(spark, sf_dir):
    """Customers with their nations in other letters; facts about unknown names, and of a nation with itself, are left out."""
    customers, nations = T.read(spark, sf_dir, "customer"), T.read(spark, sf_dir, "nation")
    told = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.upper("c_name").alias("source_name"), F.lower("n_name").alias("target_name"))
    unknown = customers.select(F.concat(F.lit("no "), "c_name").alias("source_name"), F.col("c_name").alias("target_name"))
    itself = nations.select(F.col("n_name").alias("source_name"), F.upper("n_name").alias("target_name"))
    return graph.valid_facts(told.unionByName(unknown).unionByName(itself), T.entities(spark, sf_dir)).select("source_entity_id", "target_entity_id")


@query(
    f"""SELECT id, coalesce(g, conflict_group_id) AS conflict_group_id, CASE WHEN g IS NOT NULL THEN 'active' ELSE conflict_status END AS conflict_status FROM memories LEFT JOIN (
      SELECT id, max(g) AS g FROM (SELECT a AS id, 'v' || a AS g FROM ({VECTORS}) UNION ALL SELECT b, 'v' || a FROM ({VECTORS})) GROUP BY id) USING (id)""",
    (M,),
)
def conflict_tagging(spark, sf_dir):
    """Memories with alike vectors are in conflict."""
    memories = T.memories(spark, sf_dir)
    pairs = similar_pairs(T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.4)
    return writes.tag_conflicts(memories, pairs.select("a", "b", F.concat(F.lit("v"), F.col("a").cast("string")).alias("group_id"))).select("id", "conflict_group_id", "conflict_status")


@query(
    f"""SELECT conflict_group_id, id FROM (SELECT *, max(confidence) OVER (PARTITION BY conflict_group_id) AS best, count(*) OVER (PARTITION BY conflict_group_id) AS n FROM memories WHERE {CURRENT} AND conflict_status = 'active' AND conflict_group_id <> '')
    WHERE n >= 2 AND confidence >= best - 0.01::double QUALIFY row_number() OVER (PARTITION BY conflict_group_id ORDER BY created_at DESC, id) = 1""",
    (M,),
)
def conflict_winners(spark, sf_dir):
    return lifecycle.conflict_winners(T.memories(spark, sf_dir))


PHRASES = ("she joined them. ", "it is based in town. ", "he leads them. ")
SIGNS = {"work": ["works at", "employed at", "employed by", "joined", "started at", "job at"], "place": ["lives in", "located in", "based in", "moved to", "relocated to"], "lead": ["ceo of", "leads ", "leading ", "head of"], "role": ["role is", "position is", "title is", "works as", "his role", "her role", "their role"], "pair": ["married to", "spouse is", "wife is", "husband is", "partner is"], "boss": ["reports to", "manager is", "boss is"]}
_SIGNS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(content), {chr(39)}{p}{chr(39)})' for p in ps)} THEN '{name}' END" for name, ps in SIGNS.items())
#: A sentence that signals a relation, and the document itself.
SAID = f"""said AS MATERIALIZED (SELECT id, embedding, created_at, content, [x FOR x IN [{_SIGNS}] IF x IS NOT NULL] AS signs
  FROM (SELECT id, embedding, created_at, (['she joined them. ', 'it is based in town. ', 'he leads them. '])[id % 3 + 1] || coalesce(content, '') AS content FROM memories))"""
CLOSE = """close AS MATERIALIZED (SELECT b.id, a.id AS candidate_id, list_cosine_similarity(a.embedding, b.embedding) AS score FROM said a JOIN said b ON a.id < b.id WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND list_cosine_similarity(a.embedding, b.embedding) > 0.25
  QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY list_cosine_similarity(a.embedding, b.embedding) DESC, a.id) <= 20)"""
NAMED = """named AS MATERIALIZED (SELECT DISTINCT e, m, created_at FROM (SELECT unnest([source_entity_id, target_entity_id]) AS e, source_memory_ids[1] AS m FROM facts WHERE expired_at IS NULL) JOIN memories ON memories.id = m)"""
LINKED = """linked AS MATERIALIZED (SELECT id, candidate_id, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, candidate_id) AS rank
  FROM (SELECT DISTINCT x.m AS id, y.m AS candidate_id, y.created_at FROM named x JOIN named y ON x.e = y.e AND x.m <> y.m) QUALIFY rank <= 20)"""


def _said(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories whose texts begin with a sentence that signals a relation, and for each the alike ones before it."""
    memories = T.memories(spark, sf_dir)
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("id") % 3 + 1).cast("int"))
    near = nearest_few_before(memories.select("id", "embedding"), 0.25, writes.MOST_CANDIDATES).withColumnRenamed("existing_id", "candidate_id")
    return memories.withColumn("content", F.concat(phrase, F.coalesce("content", F.lit("")))), near, T.facts(spark, sf_dir)


@query(
    """SELECT p.id, p.candidate_id, round(score, 6) AS score, CASE WHEN score >= 0.35 THEN 'auto' ELSE 'keyword' END AS stage FROM (
      SELECT * FROM close UNION ALL SELECT id, candidate_id, 0.25::double FROM linked WHERE (id, candidate_id) NOT IN (SELECT (id, candidate_id) FROM close)) p
    JOIN said a ON a.id = p.id JOIN said b ON b.id = p.candidate_id WHERE list_has_any(a.signs, b.signs)""",
    (M, FAC, SAID, CLOSE, NAMED, LINKED),
)
def contradictions(spark, sf_dir):
    """By keywords alone: candidates are alike memories before each, and the newest that its entities name, over all relations."""
    said, near, facts = _said(spark, sf_dir)
    signs = cut_off(writes.with_signals(said.select("id", "content")).select(F.col("id").alias("candidate_id"), F.col("signals").alias("candidate_signals")))
    linked = graph.linked_by_entity(said, facts).select("id", "candidate_id")
    found = writes.contradictions(said.select("id", "content"), near.join(signs, "candidate_id"), linked.join(signs, "candidate_id"), candidate=0.25, auto=0.35)
    return found.select("id", "candidate_id", F.round("score", 6).alias("score"), "stage")


#: Facts of the relations that a subject has one at a time; of those here, places.
PLACES_SAID = """told AS MATERIALIZED (SELECT DISTINCT source_memory_ids[1] AS m, relation_type AS r, fact, list_filter(list_transform(list_filter(string_split(lower(fact), ' '), lambda x: x <> ''), lambda w: trim(w, '.,;:"()' || chr(39))), lambda w: strlen(w) >= 4 AND w NOT IN ('the', 'and', 'for', 'that', 'this', 'with', 'from', 'have', 'been', 'they')) AS ws
  FROM facts WHERE relation_type IN ('LOCATED_IN', 'BASED_IN')),
able AS MATERIALIZED (SELECT e, r, named.m, created_at FROM named JOIN (SELECT DISTINCT m, r FROM told) t ON t.m = named.m),
touching AS (SELECT DISTINCT e, m FROM (SELECT unnest([source_entity_id, target_entity_id]) AS e, source_memory_ids[1] AS m FROM facts)),
reached AS (SELECT c.id, a.m AS candidate_id, a.created_at FROM close c JOIN said s ON s.id = c.id AND list_contains(s.signs, 'place') JOIN touching t ON t.m = c.candidate_id JOIN able a ON a.e = t.e WHERE a.m <> c.id GROUP BY ALL),
by_entity AS (SELECT id, candidate_id, 0.25::double AS score FROM reached WHERE (id, candidate_id) NOT IN (SELECT (id, candidate_id) FROM close) QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, candidate_id) <= 20),
hits AS MATERIALIZED (SELECT DISTINCT p.id, p.candidate_id, p.score FROM (SELECT * FROM close UNION ALL SELECT * FROM by_entity) p JOIN said s ON s.id = p.id AND list_contains(s.signs, 'place') JOIN told f ON f.m = p.candidate_id
  WHERE len(f.ws) > 0 AND len([w FOR w IN f.ws IF contains(lower(s.content), w)]) < (len(f.ws) + 1) // 2),
judged AS (SELECT h.id, h.candidate_id, h.score, CASE WHEN h.score >= 0.35 THEN 'auto' ELSE 'confirmed' END AS stage FROM hits h JOIN memories c ON c.id = h.candidate_id WHERE h.score >= 0.35 OR strlen(coalesce(c.content, '')) % 2 = 0)"""


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every stage, with a judge that confirms candidates whose text has an even number of bytes."""
    said, near, facts = _said(spark, sf_dir)
    memories = T.memories(spark, sf_dir)
    judge = lambda pairs: pairs.where(F.octet_length("candidate_content") % 2 == 0)
    plain = memories.withColumn("content", F.coalesce("content", F.lit("")))
    return contradiction.find_contradictions(said, near, plain, facts, judge, candidate=0.25, auto=0.35), memories, facts


@query("SELECT id, candidate_id, round(score, 6) AS score, stage FROM judged", (M, FAC, SAID, CLOSE, NAMED, PLACES_SAID))
def contradiction_cascade(spark, sf_dir):
    """Vectors and entities, signals, the candidates' facts, and a judge for what is still open."""
    return _judged(spark, sf_dir)[0].select("id", "candidate_id", F.round("score", 6).alias("score"), "stage")


@query(
    """SELECT 'memory' AS kind, id::varchar AS id FROM memories WHERE valid_to IS NULL AND id IN (SELECT candidate_id FROM judged)
    UNION ALL SELECT 'fact', id FROM facts WHERE expired_at IS NULL AND source_memory_ids[1] IN (SELECT candidate_id FROM judged)
      AND source_memory_ids[1] NOT IN (SELECT id FROM memories WHERE valid_to IS NULL AND id NOT IN (SELECT candidate_id FROM judged))""",
    (M, FAC, SAID, CLOSE, NAMED, PLACES_SAID),
)
def contradictions_applied(spark, sf_dir):
    """What ends by it: contradicted memories, and facts that are left without a valid memory."""
    found, memories, facts = _judged(spark, sf_dir)
    after, kept = contradiction.invalidate_contradicted(memories, facts, cut_off(found), T.NOW)
    ended = after.where(F.col("valid_to") == F.lit(T.NOW)).join(memories.where("valid_to is null").select("id"), "id", "left_semi")
    expired = kept.where(F.col("expired_at") == F.lit(T.NOW)).join(facts.where("expired_at is null").select("id"), "id", "left_semi")
    return ended.select(F.lit("memory").alias("kind"), F.col("id").cast("string").alias("id")).unionByName(expired.select(F.lit("fact").alias("kind"), "id"))


@query("SELECT id, relation_type IN ('LOCATED_IN', 'BASED_IN') AND NOT contains('they relocated to mars', CASE relation_type WHEN 'LOCATED_IN' THEN 'located' ELSE 'based' END) AS conflict FROM facts", (FAC,))
def fact_conflicts(spark, sf_dir):
    """Which facts a new text contradicts: it speaks of a place, and of the fact's own words it has fewer than half."""
    return T.facts(spark, sf_dir).select("id", writes.fact_conflict(F.lit("they relocated to mars"), F.col("relation_type"), F.col("fact")).alias("conflict"))


@query(r"SELECT conv_id, turn, trim(text, e' \n\t\r') AS body FROM conversations")
def code_fences(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    return T.read(spark, sf_dir, "conversations").select("conv_id", "turn", X.strip_code_fences(fenced).alias("body"))


@query("SELECT event_id, event_type IN ('view', 'signup') OR (event_type = 'click' AND value > 50) AS healthy FROM events")
def health_gate(spark, sf_dir):
    """Views and signups skip the check, clicks pass it by their value, errors and purchases fail it."""
    check = F.when(F.col("event_type") == "click", F.col("value") > 50).when(F.col("event_type").isin("error", "purchase"), F.lit(False))
    return T.read(spark, sf_dir, "events").select("event_id", X.healthy([check]).alias("healthy"))


@query(f"SELECT {MEASURES.replace('0.0::double AS recall_at_k2', 'avg(recalled_at_k::int::double) AS recall_at_k2')} FROM results", (QUESTIONS, RETRIEVED, SCORED, RESULTS))
def eval_summary_same_k(spark, sf_dir):
    return evaluation.summarise(eval_results(spark, sf_dir), 3, 3).withColumn("avg_f1", F.round("avg_f1", 6))


@query("SELECT id, candidate_id, rank::int AS rank FROM linked", (M, FAC, NAMED, LINKED))
def candidates_by_entity(spark, sf_dir) -> DataFrame:
    return graph.linked_by_entity(T.memories(spark, sf_dir), T.facts(spark, sf_dir))


@query(
    """SELECT m AS id, rank FROM (SELECT m, (row_number() OVER (ORDER BY min(id), m))::int AS rank FROM (SELECT id, unnest(source_memory_ids) AS m FROM (
      SELECT * FROM facts WHERE expired_at IS NULL AND (contains(lower(fact), 'part of') OR contains(lower(relation_type), 'part of')) ORDER BY id LIMIT 20)) GROUP BY m) WHERE rank <= 15""",
    (FAC,),
)
def recall_by_facts(spark, sf_dir):
    """No entity has a name with a word of the question, so facts with the question in them name the memories."""
    facts, entities = T.facts(spark, sf_dir), T.entities(spark, sf_dir)
    seeds = seed_entities(entities, "part of").select(F.col("id").alias("entity_id"))
    return graph.recall_ids(facts, seeds, search_facts(facts, 20, "part of"), 15)


@query(
    """SELECT m.id, min(k.id) AS entity_id, CASE WHEN min(k.id) IS NULL THEN 'new' ELSE 'embedding' END AS how FROM met m
    LEFT JOIN known k ON contains(lower(k.name), lower(m.name)) AND list_cosine_similarity(m.e, k.e) > 0.95 GROUP BY m.id""",
    ("known AS (SELECT c_custkey AS k, 'c' || c_custkey::varchar AS id, c_name AS name, embedding::double[] AS e FROM customer JOIN embeddings ON vec_id = c_custkey)", "met AS (SELECT 'x' || id AS id, CASE WHEN k % 5 = 0 THEN 'nobody' WHEN k % 5 = 1 THEN 'CUST' ELSE right(name, 4) END AS name, e FROM known)"),
)
def entity_resolution_by_vector(spark, sf_dir):
    """Customers met again under parts of their names, with their vectors; some under a name that nobody has."""
    vectors = T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("c_custkey"), F.col("embedding").alias("name_embedding"))
    customers = T.read(spark, sf_dir, "customer").join(vectors, "c_custkey")
    none = F.array().cast("array<string>").alias("aliases")
    known = customers.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), none, "name_embedding", F.col("c_custkey").alias("k"))
    part = F.when(F.col("k") % 5 == 0, "nobody").when(F.col("k") % 5 == 1, "CUST").otherwise(F.right("name", F.lit(4)))
    met = known.select(F.concat(F.lit("x"), "id").alias("id"), part.alias("name"), "aliases", F.col("name_embedding").alias("embedding"))
    return graph.resolve_entities(met, known.drop("k"))
