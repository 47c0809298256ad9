"""Queries on versions, the graph, lifecycle, writes, statistics, text and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph, lifecycle, stats, vector_index, versions, writes
from ..operators.chunks import pieces
from ..operators.filters import SearchFilters
from ..operators.ranking import community_sweep
from ..operators.search import knn, nearest_before, seed_entities, similar_pairs
from ..operators.vector_index import build_index
from ..sources import files
from ..sources import tables as T
from ..streaming import wal
from .registry import query
from .retrieval import COSINE, CURRENT, EDGES, ENT, ESTIMATE, FAC, HOPS, SEED_ROWS, TOP, TURNS, M, probe, seeds

NOW = "TIMESTAMP '2024-02-01'"
TTL = f"scope = 'ttl' AND ttl_seconds > 0 AND {NOW} > created_at + to_seconds(ttl_seconds)"
DECAY = f"scope = 'session' AND coalesce(last_accessed, created_at) < {NOW} - INTERVAL 24 HOUR"
RETIRE = f"scope IN ('permanent', 'project') AND valid_until < {NOW}"
GROUPS = "SELECT conflict_group_id FROM {0} WHERE conflict_status = 'active' AND conflict_group_id <> '' GROUP BY conflict_group_id HAVING count(*) >= 2"
ACTION = f"""
acted AS (SELECT *, CASE WHEN NOT ({CURRENT}) THEN NULL WHEN {TTL} THEN 'expired' WHEN {DECAY} THEN 'decayed' WHEN {RETIRE} THEN 'retired' END AS a FROM memories),
survivors AS (SELECT * FROM acted WHERE a IS NULL AND {CURRENT}),
done AS (SELECT id, conflict_group_id, CASE WHEN a IS NULL AND {CURRENT} AND conflict_status = 'active' AND conflict_group_id IN ({GROUPS.format('survivors')}) THEN 'resolved' ELSE a END AS lifecycle_action FROM acted)"""


@query("SELECT head, id, depth FROM walk", (M, "walk(head, id, next, depth) AS (SELECT id, id, supersedes_id, 0 FROM memories WHERE supersedes_id IS NOT NULL AND id NOT IN (SELECT supersedes_id FROM memories WHERE supersedes_id IS NOT NULL) UNION ALL SELECT w.head, m.id, m.supersedes_id, w.depth + 1 FROM walk w JOIN memories m ON m.id = w.next)"), recursive=True)
def supersession_chain(spark, sf_dir):
    return versions.chains(T.memories(spark, sf_dir))


@query("SELECT id, valid_from, valid_to FROM memories JOIN walk USING (id)", (M, "walk(id, next) AS (SELECT id, supersedes_id FROM memories WHERE id = 19 UNION ALL SELECT m.id, m.supersedes_id FROM walk w JOIN memories m ON m.id = w.next)"), recursive=True)
def version_history(spark, sf_dir):
    return versions.chain_of(T.memories(spark, sf_dir), 19).select("id", "valid_from", "valid_to")


@query(
    f"""SELECT id, supersedes_id, valid_to, access_count FROM (
      SELECT id, supersedes_id, CASE WHEN type = 'rule' AND project = 'src2' THEN {NOW} ELSE valid_to END AS valid_to, access_count FROM memories
      UNION ALL SELECT id + 1000000000, id, NULL, access_count FROM memories WHERE type = 'rule' AND project = 'src2')""",
    (M,),
)
def supersede_rules(spark, sf_dir):
    memories = T.memories(spark, sf_dir)
    updates = memories.where("type = 'rule' and project = 'src2'").select("id", (F.col("id") + 1_000_000_000).alias("new_id"), F.concat(F.lit("new: "), F.col("content")).alias("content"))
    return versions.supersede(memories, updates, T.NOW).select("id", "supersedes_id", "valid_to", "access_count")


@query("SELECT id AS memory_id, hops FROM near", (FAC, SEED_ROWS, EDGES, HOPS))
def graph_khop(spark, sf_dir):
    return graph.memories_within(T.facts(spark, sf_dir), seeds(spark)).select("memory_id", "hops")


@query(
    "SELECT dist, entity_id, fact_id FROM (SELECT DISTINCT dist, place AS entity_id, path[-1] AS fact_id FROM walk) ORDER BY dist, entity_id, fact_id LIMIT 200",
    (FAC, EDGES, "walk(dist, place, path) AS (SELECT 1, dst, [fact_id] FROM edges WHERE src = 'n3' UNION ALL SELECT dist + 1, e.dst, list_append(path, e.fact_id) FROM walk w JOIN edges e ON e.src = w.place WHERE dist < 2 AND NOT list_contains(path, e.fact_id))"),
    recursive=True,
)
def graph_subgraph(spark, sf_dir):
    return graph.subgraph(T.facts(spark, sf_dir), "n3", 2)


@query("SELECT f.id, f.relation_type FROM facts f, (SELECT source_entity_id AS a, target_entity_id AS b FROM facts WHERE relation_type = 'USES' AND expired_at IS NULL ORDER BY id LIMIT 1) WHERE expired_at IS NULL AND least(source_entity_id, target_entity_id) = least(a, b) AND greatest(source_entity_id, target_entity_id) = greatest(a, b)", (FAC,))
def facts_between(spark, sf_dir):
    facts = T.facts(spark, sf_dir)
    one = facts.where("relation_type = 'USES' and expired_at is null").orderBy("id").select("target_entity_id", "source_entity_id").first()
    return graph.facts_between(facts, *one).select("id", "relation_type")


@query("SELECT id, relation_type FROM facts WHERE expired_at IS NULL AND (source_entity_id = 'c7' OR target_entity_id = 'c7')", (FAC,))
def facts_for_entity(spark, sf_dir):
    return graph.facts_for_entity(T.facts(spark, sf_dir), "c7").select("id", "relation_type")


@query("SELECT id FROM facts WHERE list_contains(source_memory_ids, 11)", (FAC,))
def facts_of_memory(spark, sf_dir):
    return graph.facts_of_memory(T.facts(spark, sf_dir), 11).select("id")


@query("SELECT DISTINCT unnest(source_memory_ids) AS memory_id FROM facts WHERE expired_at IS NULL AND (source_entity_id = 'n3' OR target_entity_id = 'n3')", (FAC,))
def memories_of_entity(spark, sf_dir):
    seed = spark.createDataFrame([("n3",)], "entity_id string")
    return graph.expand(T.facts(spark, sf_dir), seed)[0]


PLACES = "places AS (SELECT * FROM facts WHERE relation_type IN ('PART_OF', 'BASED_IN', 'LOCATED_IN'))"
COMMUNITIES = "region_of AS (SELECT source_entity_id AS id, target_entity_id AS r FROM facts WHERE relation_type = 'PART_OF')"


@query(
    """SELECT entity_id, min(entity_id) OVER (PARTITION BY r) AS community FROM (
      SELECT id AS entity_id, r FROM region_of UNION SELECT r, r FROM region_of UNION SELECT source_entity_id, r FROM facts JOIN region_of ON target_entity_id = region_of.id WHERE relation_type IN ('BASED_IN', 'LOCATED_IN'))""",
    (FAC, COMMUNITIES),
)
def communities(spark, sf_dir):
    """Places form a forest whose trees are the regions, which is what the SQL says; the operator knows nothing of that."""
    return graph.communities(T.facts(spark, sf_dir).where(F.col("relation_type").isin("PART_OF", "BASED_IN", "LOCATED_IN")))


@query(
    "SELECT DISTINCT unnest(memory_ids) AS memory_id FROM entities WHERE id IN (SELECT source_entity_id FROM facts WHERE relation_type IN ('BASED_IN', 'LOCATED_IN') AND target_entity_id IN (SELECT id FROM region_of WHERE r = 'r1') UNION SELECT id FROM region_of WHERE r = 'r1' UNION SELECT 'r1')",
    (ENT, FAC, COMMUNITIES),
)
def community_memories(spark, sf_dir):
    labels = communities(spark, sf_dir)
    mine = labels.where("entity_id = 'r1'").select("community").first()["community"]
    return graph.community_memories(T.entities(spark, sf_dir), labels, mine)


@query(
    """SELECT id, round(score, 6) AS score, swept FROM (
      SELECT id, score, false AS swept FROM top
      UNION ALL SELECT DISTINCT m, 1.0::double / 61, true FROM (SELECT unnest(memory_ids) AS m FROM entities WHERE id IN (SELECT source_entity_id FROM facts WHERE relation_type IN ('BASED_IN', 'LOCATED_IN') AND target_entity_id IN (SELECT id FROM region_of WHERE r = 'r3') UNION SELECT id FROM region_of WHERE r = 'r3' UNION SELECT 'r3')) WHERE m NOT IN (SELECT id FROM top))""",
    (M, ENT, FAC, TOP, COMMUNITIES),
)
def recall_community(spark, sf_dir):
    """The nearest memories, and those of the only entity's community: the name of region 3 is asked for."""
    memories, entities = T.memories(spark, sf_dir), T.entities(spark, sf_dir)
    name = T.read(spark, sf_dir, "region").where("r_regionkey = 3").first()["r_name"]
    near = knn(memories, probe(spark, sf_dir), 50).select("id", "score")
    swept = community_sweep(near, f"what of {name}", seed_entities(entities, f"what of {name}"), communities(spark, sf_dir), entities)
    return swept.select("id", F.round("score", 6).alias("score"), "swept")


COMING = """
coming AS MATERIALIZED (SELECT id, strlen(content) AS size, embedding, row_number() OVER (ORDER BY id) AS place FROM memories WHERE embedding IS NOT NULL),
before AS MATERIALIZED (SELECT b.place, list({'s': -list_cosine_similarity(a.embedding, b.embedding), 'rec': a.id::varchar, 'place': a.place, 'size': a.size}) AS near FROM coming a JOIN coming b ON a.place < b.place AND list_cosine_similarity(a.embedding, b.embedding) >= 0.35 GROUP BY b.place),
steps(place, held, status, rec) AS (
  SELECT 0::bigint, []::STRUCT(place bigint, rec varchar)[], '', NULL::varchar
  UNION ALL
  SELECT place, CASE WHEN best IS NULL THEN list_append(held, {'place': place, 'rec': id}) WHEN size > best.size THEN list_append([h FOR h IN held IF h.place <> best.place], {'place': place, 'rec': best.rec}) ELSE held END,
    CASE WHEN best IS NULL THEN 'created' WHEN size > best.size THEN 'updated' ELSE 'duplicate' END, best.rec
  FROM (SELECT c.place, c.id::varchar AS id, c.size, w.held,
      list_sort(flatten([[{'s': n.s, 'rec': h.rec, 'place': n.place, 'size': n.size} FOR h IN w.held IF h.place = n.place] FOR n IN coalesce(b.near, [])]))[1] AS best
    FROM steps w JOIN coming c ON c.place = w.place + 1 LEFT JOIN before b ON b.place = c.place))"""


@query("SELECT id::varchar AS id, status, rec AS existing_id FROM steps JOIN coming USING (place)", (M, COMING), recursive=True)
def batch_dedup(spark, sf_dir):
    """All memories with a vector arrive in the order of their ids, at an empty store."""
    rows = T.memories(spark, sf_dir).where("embedding is not null").withColumn("seq", F.col("id"))
    return writes.batch_dedup(rows, rows.limit(0), 0.35)


@query("SELECT relation_type, CASE WHEN upper(trim(relation_type)) IN ('LOCATED_IN', 'BASED_IN', 'PART_OF', 'USES') THEN upper(trim(relation_type)) ELSE 'RELATES_TO' END AS label, count(*) AS n FROM facts GROUP BY ALL", (FAC,))
def relation_migration(spark, sf_dir):
    return graph.migrate_relations(T.facts(spark, sf_dir).withColumn("label", F.lit("RELATES_TO"))).groupBy("relation_type", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s.id, CASE WHEN s.id LIKE 's%' THEN s.id END AS entity_id, CASE WHEN s.id LIKE 's%' THEN 'alias' ELSE 'new' END AS how FROM (SELECT id FROM entities WHERE id LIKE 's%' UNION ALL SELECT 'x' || id FROM entities WHERE id LIKE 'r%') s", (ENT,))
def entity_resolution(spark, sf_dir):
    """Suppliers met again under their alias, and names that nobody has."""
    known = T.entities(spark, sf_dir).withColumn("name_embedding", F.lit(None).cast("array<float>"))
    none = F.lit(None).cast("array<float>").alias("embedding")
    again = known.where("id like 's%'").select("id", F.element_at("aliases", 1).alias("name"), F.array().cast("array<string>").alias("aliases"), none)
    new = known.where("id like 'r%'").select(F.concat(F.lit("x"), "id").alias("id"), F.concat(F.lit("nobody "), "id").alias("name"), F.array().cast("array<string>").alias("aliases"), none)
    return graph.resolve_entities(again.unionByName(new), known)


@query("SELECT f.id, CASE WHEN f.expired_at IS NULL THEN 'skip' ELSE 'insert' END AS action, CASE WHEN f.expired_at IS NULL THEN f.id END AS existing_id FROM facts f WHERE relation_type = 'USES'", (FAC,))
def fact_resolution(spark, sf_dir):
    facts = T.facts(spark, sf_dir)
    return graph.resolve_facts(facts.where("relation_type = 'USES'"), facts)


@query("SELECT t.type, count(m.id) AS n FROM (SELECT unnest(['rule', 'fact', 'episode', 'procedure', 'preference']) AS type) t LEFT JOIN memories m USING (type) GROUP BY t.type", (M,))
def stats_by_type(spark, sf_dir):
    return stats.by_type(T.memories(spark, sf_dir))


@query("SELECT t.scope, count(m.id) AS n FROM (SELECT unnest(['permanent', 'project', 'session', 'ttl']) AS scope) t LEFT JOIN memories m USING (scope) GROUP BY t.scope", (M,))
def stats_by_scope(spark, sf_dir):
    return stats.by_scope(T.memories(spark, sf_dir))


@query("SELECT CASE WHEN reinforced_count <= 0 THEN '0' WHEN reinforced_count <= 3 THEN '1-3' WHEN reinforced_count <= 10 THEN '4-10' ELSE '10+' END AS tier, count(*) AS n FROM memories GROUP BY ALL", (M,))
def stats_tiers(spark, sf_dir):
    return stats.tiers(T.memories(spark, sf_dir))


@query("SELECT id, access_count, n FROM (SELECT id, access_count, created_at, least(strlen(content), 80) AS n FROM memories) ORDER BY access_count DESC, created_at DESC, id LIMIT 5", (M,))
def stats_top_accessed(spark, sf_dir):
    return stats.top_accessed(T.memories(spark, sf_dir)).join(T.memories(spark, sf_dir).select("id", F.least(F.octet_length("content"), F.lit(80)).cast("long").alias("n")), "id").select("id", "access_count", "n")


@query(
    f"SELECT count(*) AS total, min(created_at) AS oldest, max(created_at) AS newest, count(*) FILTER (conflict_status = 'active') AS active_conflicts, count(*) FILTER (scope = 'ttl' AND valid_until < {NOW} + INTERVAL 24 HOUR) AS pending_ttl, count(*) FILTER (embedding IS NULL) AS without_embedding, count(*) * 768 * 4 AS storage_bytes FROM memories",
    (M,),
)
def stats_summary(spark, sf_dir):
    return stats.summary(T.memories(spark, sf_dir), T.NOW)


def _current(spark, sf_dir) -> DataFrame:
    return lifecycle.current(T.memories(spark, sf_dir))


@query(f"SELECT id, created_at, ttl_seconds FROM memories WHERE {CURRENT} AND {TTL}", (M,))
def ttl_expiry(spark, sf_dir):
    return _current(spark, sf_dir).where(lifecycle.ttl_expired(T.NOW)).select("id", "created_at", "ttl_seconds")


@query(f"SELECT id, last_accessed FROM memories WHERE {CURRENT} AND {DECAY}", (M,))
def session_decay(spark, sf_dir):
    return _current(spark, sf_dir).where(lifecycle.session_decayed(T.NOW)).select("id", "last_accessed")


@query(f"SELECT id, valid_until FROM memories WHERE {CURRENT} AND {RETIRE}", (M,))
def retire_expired(spark, sf_dir):
    return _current(spark, sf_dir).where(lifecycle.retired(T.NOW)).select("id", "valid_until")


@query(f"SELECT id, CASE WHEN {CURRENT} AND conflict_status = 'active' AND conflict_group_id IN ({GROUPS.format('(SELECT * FROM memories WHERE ' + CURRENT + ')')}) THEN 'resolved' ELSE conflict_status END AS conflict_status FROM memories", (M,))
def resolve_conflicts(spark, sf_dir):
    return lifecycle.resolve_conflicts(T.memories(spark, sf_dir)).select("id", "conflict_status")


@query("SELECT id, lifecycle_action FROM done WHERE lifecycle_action IS NOT NULL", (M, ACTION))
def lifecycle_actions(spark, sf_dir):
    return lifecycle.run_lifecycle(T.memories(spark, sf_dir), T.NOW).where("lifecycle_action is not null").select("id", "lifecycle_action")


@query("SELECT count(*) FILTER (lifecycle_action = 'expired') AS expired, count(*) FILTER (lifecycle_action = 'decayed') AS decayed, count(*) FILTER (lifecycle_action = 'retired') AS retired, count(*) FILTER (lifecycle_action = 'resolved') - count(DISTINCT conflict_group_id) FILTER (lifecycle_action = 'resolved') AS conflicts FROM done", (M, ACTION))
def lifecycle_report(spark, sf_dir):
    return lifecycle.lifecycle_report(T.memories(spark, sf_dir), T.NOW)


PAIRS = "SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.embedding, b.embedding) AS score FROM perm a JOIN perm b ON a.id < b.id"
PERMANENT = f"perm AS (SELECT * FROM memories WHERE {CURRENT} AND scope = 'permanent' AND embedding IS NOT NULL)"


@query(f"SELECT a, b, round(score, 6) AS score FROM ({PAIRS}) WHERE score > 0.3", (M, PERMANENT))
def consolidate_pairs(spark, sf_dir):
    """Test vectors are near random, so the threshold is far below the default."""
    return lifecycle.consolidation_pairs(T.memories(spark, sf_dir), 0.3).select("a", "b", F.round("score", 6).alias("score"))


WALKED = f"""
ordered AS MATERIALIZED (SELECT id, embedding, coalesce(confidence, 0) AS trust, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM perm),
later AS MATERIALIZED (SELECT a.place, list({{'place': b.place, 'trust': b.trust}} ORDER BY b.place) AS alike FROM ordered a JOIN ordered b ON a.place < b.place AND list_cosine_similarity(a.embedding, b.embedding) > 0.3 GROUP BY a.place),
turns(place, gone) AS (
  SELECT 0::bigint, []::bigint[]
  UNION ALL
  SELECT place, CASE WHEN list_contains(gone, place) THEN gone ELSE gone || [m.place FOR m IN met IF stop IS NULL OR m.place < stop] || CASE WHEN stop IS NULL THEN [] ELSE [place] END END
  FROM (SELECT *, list_min([m.place FOR m IN met IF m.trust > trust]) AS stop
    FROM (SELECT o.place, o.trust, w.gone, [m FOR m IN coalesce(l.alike, []) IF NOT list_contains(w.gone, m.place)] AS met FROM turns w JOIN ordered o ON o.place = w.place + 1 LEFT JOIN later l ON l.place = o.place)))"""


@query("SELECT id FROM ordered WHERE list_contains((SELECT gone FROM turns ORDER BY place DESC LIMIT 1), place)", (M, PERMANENT, WALKED), recursive=True)
def consolidate_greedy(spark, sf_dir):
    return lifecycle.consolidate(T.memories(spark, sf_dir), 0.3)


VECTORS = "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::double[], b.embedding::double[]) > 0.4"


@query(VECTORS)
def similar_vectors(spark, sf_dir):
    vectors = T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return similar_pairs(vectors, 0.4).select("a", "b", F.round("score", 6).alias("score"))


QUESTION = "asked AS (SELECT embedding::double[] AS q FROM embeddings WHERE vec_id = 7)"
NEAREST = f"SELECT id, round(list_cosine_similarity(embedding, q), 6) AS score FROM memories, asked WHERE {CURRENT} AND embedding IS NOT NULL ORDER BY list_cosine_similarity(embedding, q) DESC, id LIMIT 25"


@query(NEAREST, (M, QUESTION))
def knn_indexed(spark, sf_dir):
    """The 25 nearest memories by an index of all of them: lists near the question first, then all that can hold a nearer one."""
    memories = T.memories(spark, sf_dir)
    index = build_index(memories.select("id", "embedding"), calibrate=False)
    return vector_index.knn_indexed(index, memories, probe(spark, sf_dir), 25, exact=True).select("id", F.round("score", 6).alias("score"))


@query(VECTORS)
def similar_vectors_indexed(spark, sf_dir):
    """The pairs of ``similar_vectors`` by an index: blocks meet only where their angles allow a pair."""
    vectors = T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector_index.row_pairs_above(build_index(vectors, calibrate=False), 0.4).select("a", "b", F.round("score", 6).alias("score"))


@query()
def neighbours_indexed(spark, sf_dir):
    """The ten nearest of every hundredth vector, by as many probes as the calibration asked for; a share of 0.9 of them or more is exact."""
    vectors = T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = vector_index.neighbours(build_index(vectors), vectors.where("id % 100 = 0"), 10)
    return found.select("id", "neighbour_id", F.round("score", 6).alias("score"))


BEST = """
incoming AS (SELECT * FROM memories WHERE embedding IS NOT NULL),
best AS (SELECT p.id, p.content, m.id AS existing_id, m.content AS existing_content, round(list_cosine_similarity(p.embedding, m.embedding), 9) AS score FROM incoming p LEFT JOIN incoming m ON m.id < p.id
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY round(list_cosine_similarity(p.embedding, m.embedding), 9) DESC NULLS LAST, m.id) = 1)"""


def _best(spark, sf_dir, at_least: float) -> tuple[DataFrame, DataFrame]:
    """Every memory with a vector, as it came in, and the most alike of those before it, if it is that alike."""
    memories = T.memories(spark, sf_dir).where("embedding is not null")
    best = nearest_before(memories.select("id", "embedding"), at_least)
    return memories.select("id", "content"), best.join(memories.select(F.col("id").alias("existing_id"), F.col("content").alias("existing_content")), "existing_id")


@query("SELECT id, CASE WHEN coalesce(score, 0) < 0.3 THEN 'created' WHEN strlen(content) > strlen(existing_content) THEN 'updated' ELSE 'duplicate' END AS status, CASE WHEN score >= 0.3 THEN existing_id END AS existing_id FROM best", (M, BEST))
def dedup_decision(spark, sf_dir):
    return writes.dedup_decision(*_best(spark, sf_dir, 0.3), threshold=0.3)


@query("SELECT id, CASE WHEN score >= 0.4 THEN 'duplicate' WHEN score >= 0.25 THEN 'reinforce' ELSE 'store' END AS decision FROM best", (M, BEST))
def reinforce_decision(spark, sf_dir):
    new, best = _best(spark, sf_dir, 0.25)
    return new.select("id").join(best, "id", "left").select("id", writes.capture_decision(F.col("score"), 0.25, 0.4).alias("decision"))


@query(f"SELECT id, least(1, confidence + CASE WHEN hit THEN 0.05::double ELSE 0 END) AS confidence, (reinforced_count + hit::int)::int AS reinforced_count FROM (SELECT *, id IN (SELECT id FROM memories WHERE {CURRENT} AND type = 'fact') AS hit FROM memories)", (M,))
def reinforced_facts(spark, sf_dir):
    memories = T.memories(spark, sf_dir)
    return writes.reinforced(memories, SearchFilters(type="fact").apply(memories).select("id"), T.NOW).select("id", "confidence", "reinforced_count")


WORK = "['works at', 'employed at', 'employed by', 'joined', 'started at', 'job at']"


@query(f"SELECT conv_id, turn, list_bool_or(list_transform({WORK}, lambda p: contains(lower(user_msg), p))) AS work, list_bool_or(list_transform(['leads ', 'leading ', 'head of', 'ceo of'], lambda p: contains(lower(assistant_msg), p))) AS lead FROM turns", (TURNS,))
def relation_signals(spark, sf_dir):
    return T.turns(spark, sf_dir).select("conv_id", "turn", F.array_contains(writes.signalled(F.col("user_msg")), "WORKS_AT").alias("work"), F.array_contains(writes.signalled(F.col("assistant_msg")), "LEADS").alias("lead"))


SIGNIFICANT = r"list_filter(list_transform(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''), lambda w: trim(w, '.,;:""''()')), lambda w: strlen(w) >= 4 AND w NOT IN ('the', 'and', 'for', 'that', 'this', 'with', 'from', 'have', 'been', 'they'))".replace('""', '"')


@query(f"SELECT conv_id, turn, len({SIGNIFICANT}) AS n, coalesce(array_to_string(({SIGNIFICANT})[1:5], ' '), '') AS first FROM conversations")
def significant_words(spark, sf_dir):
    found = X.significant_words(F.col("text"))
    return T.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("n"), F.array_join(F.slice(found, 1, 5), " ").alias("first"))


def _mentions_sql(phrases: list[str]) -> str:
    import re

    # RE2 has ASCII word boundaries, as the operator has.
    return " + ".join(f"regexp_matches(text, '(?i)\\b{re.escape(p).replace(chr(39), chr(39) * 2)}\\b')::int" for p in phrases)


CLASSES = "SELECT doc_id, CASE WHEN greatest(r, p, f, e) = 0 THEN 'fact' WHEN r = greatest(r, p, f, e) THEN 'rule' WHEN p = greatest(r, p, f, e) THEN 'procedure' WHEN f = greatest(r, p, f, e) THEN 'preference' ELSE 'episode' END AS type FROM (SELECT doc_id, {} AS r, {} AS p, {} AS f, {} AS e FROM documents)"


@query(CLASSES.format(*map(_mentions_sql, (X.RULE, X.PROCEDURE, X.PREFERENCE, X.EPISODE))))
def classify(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", X.classify(F.col("text")).alias("type"))


@query(f"SELECT doc_id, ({ESTIMATE.replace('content', 'text')})::bigint AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"SELECT conv_id, turn, strlen(trim(user_msg, e' \n\t\r')) >= 20 AND strlen(trim(assistant_msg, e' \n\t\r')) >= 20 AND NOT contains(user_msg, 'NO_REPLY') AND NOT contains(assistant_msg, 'NO_REPLY') AND NOT contains(user_msg, 'HEARTBEAT_OK') AND NOT contains(assistant_msg, 'HEARTBEAT_OK') AS keep FROM turns", (TURNS,))
def capture_gate(spark, sf_dir):
    return T.turns(spark, sf_dir).select("conv_id", "turn", X.capture_gate(F.col("user_msg"), F.col("assistant_msg")).alias("keep"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '\"', '&#34;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), chr(9), '&#x9;'), chr(10), '&#xA;'), chr(13), '&#xD;') AS escaped FROM pages")
def xml_escape(spark, sf_dir):
    return T.read(spark, sf_dir, "pages").select("page_id", X.xml_escape(F.col("html")).alias("escaped"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(replace(text, chr(10), ' '), 60) || '...' ELSE replace(text, chr(10), ' ') END AS preview FROM documents")
def previews(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text"), 60).alias("preview"))


@query()
def chunk_split(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(pieces(512, 64)("text")).alias("piece", "content"))


@query("SELECT id, seq, state, updated_at FROM wal QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, seq) = 1", (T.WAL_SQL,))
def wal_latest(spark, sf_dir):
    return wal.latest(T.wal(spark, sf_dir)).select("id", "seq", "state", "updated_at")


LATEST = "latest AS (SELECT * FROM wal QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, seq) = 1)"


@query("SELECT count(*) FILTER (state IN ('pending', 'processing')) AS pending, count(*) FILTER (state = 'failed') AS failed FROM latest", (T.WAL_SQL, LATEST))
def wal_status(spark, sf_dir):
    return wal.status(T.wal(spark, sf_dir))


@query("SELECT id, state FROM latest WHERE state <> 'done'", (T.WAL_SQL, LATEST))
def wal_compact(spark, sf_dir):
    return wal.compact(T.wal(spark, sf_dir)).select("id", "state")


@query("SELECT id, CASE WHEN seq % 2 = 0 THEN 'done' WHEN seq % 3 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS state, seq % 3 + 1 AS attempts FROM latest WHERE state IN ('pending', 'processing')", (T.WAL_SQL, LATEST))
def wal_retry(spark, sf_dir):
    entries = wal.replay(T.wal(spark, sf_dir)).withColumn("attempts", F.col("seq") % 3).withColumn("ok", F.col("seq") % 2 == 0)
    return wal.after_attempt(entries).select("id", "state", "attempts")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def last_n_turns(spark, sf_dir):
    return wal.last_turns(T.read(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS user_msg, arg_max(text, turn) FILTER (role = 'assistant') AS assistant_msg FROM conversations GROUP BY conv_id")
def last_messages(spark, sf_dir):
    return wal.last_of_role(T.read(spark, sf_dir, "conversations"))


@query(
    """SELECT id, access_count, valid_to FROM (
      SELECT m.id, m.access_count, CASE WHEN m.id IN (SELECT id - 1 FROM memories WHERE type = 'rule') THEN TIMESTAMP '2024-02-01' ELSE m.valid_to END AS valid_to FROM memories m WHERE type <> 'rule'
      UNION ALL SELECT id, access_count + 2, valid_to FROM memories WHERE type = 'rule')""",
    (M,),
)
def upsert_merge(spark, sf_dir):
    """Every rule comes in twice, the second time counted once more, and supersedes the memory before it."""
    memories = T.memories(spark, sf_dir)
    rules = memories.where("type = 'rule'")
    twice = rules.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("access_count", F.col("access_count") + F.col("seq")).withColumn("supersedes_id", F.col("id") - 1).withColumn("embedding", F.lit(None).cast("array<float>"))
    return writes.upsert(memories, twice, T.NOW).select("id", "access_count", "valid_to")


@query(f"SELECT id, type, scope, printf('%.4f', confidence) AS confidence, access_count FROM memories WHERE {CURRENT}", (M,))
def export_csv(spark, sf_dir):
    return files.csv_rows(T.memories(spark, sf_dir)).select("id", "type", "scope", "confidence", "access_count")


@query(f"SELECT id, visibility, array_to_string(tags, ',') AS tags FROM memories WHERE {CURRENT}", (M,))
def export_json(spark, sf_dir):
    return files.export_rows(T.memories(spark, sf_dir)).select("id", "visibility", F.array_join("tags", ",").alias("tags"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN TIMESTAMP '2024-02-01' ELSE created_at END AS created_at FROM memories WHERE id % 9 <> 0 AND length(trim(content)) > 0", (M,))
def import_cleanse(spark, sf_dir):
    rows = T.memories(spark, sf_dir).withColumn("content", F.when(F.col("id") % 9 == 0, " \n\t").otherwise(F.col("content"))).withColumn("created_at", F.when(F.col("id") % 4 != 0, F.col("created_at")))
    return writes.import_cleanse(rows, T.NOW).select("id", "created_at")


@query("SELECT 'entity name' AS rule, name AS key, count(*) AS n FROM entities GROUP BY name HAVING count(*) > 1", (ENT,))
def schema_violations(spark, sf_dir):
    return writes.schema_violations(T.memories(spark, sf_dir), T.entities(spark, sf_dir))


@query(f"SELECT id, round(coalesce({COSINE}, 0), 6) AS score FROM memories WHERE {CURRENT} AND scope = 'permanent'", (M,))
def cosine_scan(spark, sf_dir):
    from ..functions.vectors import cosine_to

    rows = SearchFilters(scope="permanent").apply(T.memories(spark, sf_dir))
    return rows.select("id", F.round(cosine_to(F.col("embedding"), probe(spark, sf_dir)), 6).alias("score"))
