"""Search, ranking and evaluation queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..operators import evaluation, graph, ranking, search
from ..operators import retrieval as by_words
from ..operators.filters import SearchFilters, keyset_page, page
from ..session import cut_off
from ..sources import tables as T
from .registry import query

M, ENT, FAC, TURNS = T.MEMORIES_SQL, T.ENTITIES_SQL, T.FACTS_SQL, T.TURNS_SQL
PROBE, PROJECT, ASKED, SEEDS = 7, "src1", "en deploy the src1 service", ("c1", "c5", "s3")
CURRENT = "visibility <> 'sensitive' AND valid_to IS NULL"
COSINE = "list_cosine_similarity(embedding, (SELECT embedding::double[] FROM embeddings WHERE vec_id = 7))"
TOP = f"top AS (SELECT *, {COSINE} AS score FROM memories WHERE {CURRENT} AND embedding IS NOT NULL ORDER BY score DESC, id LIMIT 50)"
FACTORS = """
  CASE WHEN last_accessed IS NULL THEN 0.1::double ELSE exp(-0.693::double * greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_accessed)) / 3.6e9::double, 0) / 168) END AS recency_score,
  CASE WHEN access_count <= 0 THEN 0 ELSE least(1, log2(access_count + 1) / 10) END AS frequency_score,
  (CASE type WHEN 'rule' THEN 1.5 WHEN 'procedure' THEN 1.3 WHEN 'fact' THEN 1.0 WHEN 'episode' THEN 0.8 WHEN 'preference' THEN 0.7 ELSE 1.0 END)::double / 1.5::double AS type_boost_score,
  CASE WHEN scope = 'project' AND project = 'src1' THEN 1.0::double WHEN scope = 'permanent' THEN 1.0::double / 1.5::double ELSE 0.8::double / 1.5::double END AS scope_boost_score,
  CASE WHEN confidence < 0.01 THEN 0.7::double ELSE confidence END AS confidence_score,
  CASE WHEN reinforced_count <= 0 THEN 0 ELSE least(1, log2(reinforced_count + 1) / 5) END AS reinforcement_score,
  len(list_filter(tags, lambda t: list_contains(['en', 'deploy', 'the', 'src1', 'service'], t)))::double / len(tags) AS tag_affinity_score,
  CASE WHEN EXISTS (SELECT 1 FROM top u WHERE u.supersedes_id = top.id) THEN 0.3::double ELSE 1 END AS supersession_penalty,
  CASE WHEN conflict_status = 'active' THEN 0.8::double ELSE 1 END AS conflict_penalty"""
TOTAL = "0.45 * similarity_score + 0.08 * recency_score + 0.05 * frequency_score + 0.1 * type_boost_score + 0.08 * scope_boost_score + 0.07 * confidence_score + 0.07 * reinforcement_score + 0.05 * tag_affinity_score + 0.05 * graph_proximity_score"
RANKED = f"ranked AS (SELECT *, ({TOTAL}) * supersession_penalty * conflict_penalty AS final_score FROM (SELECT *, score AS similarity_score, 0.0::double AS graph_proximity_score, {FACTORS} FROM top))"
ESTIMATE = r"CASE WHEN strlen(content) = 0 THEN 0 ELSE trunc(greatest(len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) * 1.25::double, strlen(content) / 3.5::double) * 1.1::double)::bigint END"
SEED_ROWS = f"seeds AS (SELECT unnest(['{SEEDS[0]}', '{SEEDS[1]}', '{SEEDS[2]}']) AS entity_id)"
EDGES = "edges AS (SELECT id AS fact_id, source_entity_id AS src, target_entity_id AS dst, source_memory_ids FROM facts WHERE expired_at IS NULL UNION ALL SELECT id, target_entity_id, source_entity_id, source_memory_ids FROM facts WHERE expired_at IS NULL)"
HOPS = """
one AS (SELECT DISTINCT e.* FROM edges e JOIN seeds s ON e.src = s.entity_id),
next AS (SELECT DISTINCT dst AS entity_id FROM one WHERE dst NOT IN (SELECT entity_id FROM seeds)),
two AS (SELECT e.* FROM edges e JOIN next n ON e.src = n.entity_id),
near AS (SELECT memory_id AS id, min(hops) AS hops FROM (SELECT unnest(source_memory_ids) AS memory_id, 1 AS hops FROM one UNION ALL SELECT unnest(source_memory_ids), 2 FROM two) GROUP BY memory_id)"""
ROUND = lambda c: F.round(c, 6)


def probe(spark: SparkSession, sf_dir: str, vec_id: int = PROBE) -> list[float]:
    return list(T.read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SEEDS], "entity_id string")


def top_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.knn(T.memories(spark, sf_dir), probe(spark, sf_dir), 50)
    return ranking.rank(near, ASKED, T.NOW, PROJECT)


@query(f"SELECT id, type, round(score, 6) AS score FROM (SELECT id, type, {COSINE} AS score FROM memories WHERE {CURRENT} AND type IN ('fact') AND embedding IS NOT NULL ORDER BY score DESC, id LIMIT 10)", (M,))
def knn_filtered(spark, sf_dir):
    return search.knn(T.memories(spark, sf_dir), probe(spark, sf_dir), 10, SearchFilters(type="fact")).select("id", "type", ROUND("score").alias("score"))


@query(f"SELECT id, project, round(score, 6) AS score FROM (SELECT id, project, {COSINE} AS score FROM memories WHERE {CURRENT} AND project = 'src1' AND embedding IS NOT NULL ORDER BY score DESC, id LIMIT 10)", (M,))
def knn_project(spark, sf_dir):
    return search.knn(T.memories(spark, sf_dir), probe(spark, sf_dir), 10, SearchFilters(project=PROJECT)).select("id", "project", ROUND("score").alias("score"))


@query(f"SELECT id, round(score, 6) AS score FROM (SELECT * FROM (SELECT *, {COSINE} AS score FROM memories WHERE embedding IS NOT NULL) ORDER BY score DESC, id LIMIT 60) WHERE {CURRENT} ORDER BY score DESC, id LIMIT 30", (M,))
def knn_post_filtered(spark, sf_dir):
    return search.knn(T.memories(spark, sf_dir), probe(spark, sf_dir), 30, candidate_window=60, post_filter=True).select("id", ROUND("score").alias("score"))


@query(f"SELECT id, round(score, 6) AS score FROM (SELECT id, {COSINE} AS score FROM memories WHERE embedding IS NOT NULL) WHERE score >= 0.25", (M,))
def near_duplicates(spark, sf_dir):
    return search.find_duplicates(T.memories(spark, sf_dir), probe(spark, sf_dir), 0.25).select("id", ROUND("score").alias("score"))


@query(f"SELECT id, round(coalesce({COSINE.replace('embedding,', 'fact_embedding,', 1)}, 0), 6) AS score FROM facts WHERE expired_at IS NULL ORDER BY score DESC, id LIMIT 15", (FAC,))
def fact_search_semantic(spark, sf_dir):
    return search.search_facts(T.facts(spark, sf_dir), 15, embedding=probe(spark, sf_dir)).select("id", ROUND("score").alias("score")).orderBy(F.desc("score"), "id")


@query("SELECT id, fact, 1.0::double AS score FROM facts WHERE expired_at IS NULL AND (contains(lower(fact), 'based in') OR contains(lower(relation_type), 'based in')) ORDER BY id LIMIT 40", (FAC,))
def fact_search_text(spark, sf_dir):
    return search.search_facts(T.facts(spark, sf_dir), 40, query="Based In").select("id", "fact", "score")


@query("SELECT id, name FROM entities WHERE contains(lower(name), '00001') OR list_bool_or(list_transform(aliases, lambda a: contains(lower(a), '00001'))) ORDER BY name, id LIMIT 100", (ENT,))
def entity_contains(spark, sf_dir):
    return search.search_entities(T.entities(spark, sf_dir), "00001").select("id", "name")


@query(
    r"SELECT id, name FROM entities WHERE len(list_intersect(list_filter(string_split_regex(lower(regexp_replace(name, '[-+&|!(){}\[\]^~*?:/]', ' ', 'g')), '\s+'), lambda x: x <> ''), ['europe', 'asia', 'france', 'where', 'is', 'the', 'team'])) > 0 ORDER BY id LIMIT 10",
    (ENT,),
)
def entity_seeds(spark, sf_dir):
    return search.seed_entities(T.entities(spark, sf_dir), "Where is the (Europe) team? Asia / France").select("id", "name")


@query(
    f"SELECT id, type, {', '.join(f'round({c}, 6) AS {c}' for c in ('similarity_score', 'recency_score', 'frequency_score', 'type_boost_score', 'scope_boost_score', 'confidence_score', 'reinforcement_score', 'tag_affinity_score', 'supersession_penalty', 'conflict_penalty', 'final_score'))} FROM ranked ORDER BY ranked.final_score DESC, id LIMIT 10",
    (M, TOP, RANKED),
)
def recall_ranked(spark, sf_dir):
    """The flagship: filtered search, relevance score, best ten."""
    names = ["similarity_score", "recency_score", "frequency_score", "type_boost_score", "scope_boost_score", "confidence_score", "reinforcement_score", "tag_affinity_score", "supersession_penalty", "conflict_penalty", "final_score"]
    return top_ranked(spark, sf_dir).limit(10).select("id", "type", *[ROUND(c).alias(c) for c in names])


@query(
    f"SELECT id, cost, used FROM (SELECT *, sum(cost) OVER (ORDER BY final_score DESC, id)::bigint AS used FROM (SELECT *, ({ESTIMATE} + 2)::bigint AS cost FROM ranked)) WHERE used <= 20000",
    (M, TOP, RANKED),
)
def recall_budgeted(spark, sf_dir):
    return ranking.within_budget(top_ranked(spark, sf_dir), 20000, [F.desc("final_score"), F.col("id")]).select("id", "cost", "used")


@query(
    f"""SELECT id, cost, used, array_to_string(peers, ',') AS peers FROM (
      SELECT *, sum(cost) OVER (ORDER BY final_score DESC, id)::bigint AS used,
        CASE WHEN conflict_status = 'active' THEN (SELECT coalesce(list(left(u.id::varchar, 8) ORDER BY left(u.id::varchar, 8)), []) FROM ranked u WHERE u.conflict_group_id = r.conflict_group_id AND u.conflict_status = 'active' AND u.id <> r.id AND length(u.id::varchar) >= 8) END AS peers
      FROM (SELECT *, (strlen(content) // 4)::bigint AS cost FROM ranked) r) WHERE used <= 20000""",
    (M, TOP, RANKED),
)
def recall_conflict_budget(spark, sf_dir):
    marked = ranking.annotate_conflicts(top_ranked(spark, sf_dir))
    kept = ranking.within_budget(marked, 20000, [F.desc("final_score"), F.col("id")], F.floor(F.octet_length("content") / 4).cast("long"))
    return kept.select("id", "cost", "used", F.array_join("peers", ",").alias("peers"))


GRAPH_RECALL = f"""
v AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank_v FROM top),
g AS (SELECT id, hops, row_number() OVER (ORDER BY hops, id) AS rank_g FROM (SELECT * FROM near ORDER BY hops, id LIMIT 50)),
merged AS (SELECT coalesce(v.id, g.id) AS id, coalesce(0.6::double / (60 + rank_v), 0) + coalesce(0.4::double / (60 + rank_g), 0) AS rrf, v.score AS similarity FROM v FULL JOIN g ON v.id = g.id)"""


@query(
    f"""SELECT id, round(rrf, 6) AS rrf, round(final_score, 6) AS final_score FROM (
      SELECT id, rrf, ({TOTAL}) * supersession_penalty * conflict_penalty AS final_score FROM (
        SELECT top.*, coalesce(similarity, rrf) AS similarity_score, CASE WHEN hops = 1 THEN 1.0::double WHEN hops = 2 THEN 0.5::double WHEN hops >= 3 THEN 0.25::double ELSE 0 END AS graph_proximity_score, {FACTORS.replace('FROM top u', 'FROM pool u')}
        FROM pool top LEFT JOIN near n ON n.id = top.id)) ORDER BY final_score DESC, id LIMIT 20""",
    (M, FAC, TOP, SEED_ROWS, EDGES, HOPS, GRAPH_RECALL, f"pool AS (SELECT m.*, rrf, similarity FROM merged JOIN memories m USING (id) WHERE {CURRENT})"),
)
def recall_with_graph(spark, sf_dir):
    memories, facts = T.memories(spark, sf_dir), T.facts(spark, sf_dir)
    near = search.knn(memories, probe(spark, sf_dir), 50)
    within = cut_off(graph.memories_within(facts, seeds(spark)))
    linked = graph.ranks_of(within, 50)
    blend = ranking.rrf_blend(ranking.with_rank(near.select("id", "score"), F.desc("score"), F.col("id")), linked)
    pool = SearchFilters().apply(memories).join(blend, "id").withColumn("score", F.col("rrf"))
    hops = within.withColumnRenamed("memory_id", "id")
    return ranking.rank(pool, ASKED, T.NOW, PROJECT, proximity=hops).limit(20).select("id", ROUND("rrf").alias("rrf"), ROUND("final_score").alias("final_score"))


def three_lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = SearchFilters().apply(T.memories(spark, sf_dir))
    ordered = lambda *by: ranking.with_rank(rows.orderBy(*by).limit(40).select("id", "access_count", "created_at", "confidence"), *by).select("id", "rank")
    return [ordered(F.desc("access_count"), F.col("id")), ordered(F.desc("created_at"), F.col("id")), ordered(F.desc("confidence"), F.col("id"))]


@query(
    f"""SELECT id, round(sum(1.0::double / (60 + rank)), 6) AS score FROM (
      SELECT id, row_number() OVER (ORDER BY access_count DESC, id) AS rank FROM memories WHERE {CURRENT}
      UNION ALL SELECT id, row_number() OVER (ORDER BY created_at DESC, id) FROM memories WHERE {CURRENT}
      UNION ALL SELECT id, row_number() OVER (ORDER BY confidence DESC, id) FROM memories WHERE {CURRENT}) WHERE rank <= 40 GROUP BY id""",
    (M,),
)
def rrf_merge(spark, sf_dir):
    return ranking.rrf_merge(three_lists(spark, sf_dir)).select("id", ROUND("score").alias("score"))


@query("SELECT id, round(rrf, 6) AS rrf, round(similarity, 6) AS similarity FROM merged", (M, FAC, TOP, SEED_ROWS, EDGES, HOPS, GRAPH_RECALL))
def rrf_weighted(spark, sf_dir):
    near = search.knn(T.memories(spark, sf_dir), probe(spark, sf_dir), 50)
    linked = graph.graph_ranks(T.facts(spark, sf_dir), seeds(spark), 50)
    return ranking.rrf_blend(ranking.with_rank(near.select("id", "score"), F.desc("score"), F.col("id")), linked).select("id", ROUND("rrf").alias("rrf"), ROUND("similarity").alias("similarity"))


@query("SELECT count(*) >= 4 AND max(final_score) - min(final_score) <= 0.05 AS needed FROM (SELECT final_score FROM ranked ORDER BY final_score DESC, id LIMIT 4)", (M, TOP, RANKED))
def rerank_gate(spark, sf_dir):
    return ranking.needs_rerank(top_ranked(spark, sf_dir), 0.05)


@query(
    "SELECT id, row_number() OVER (ORDER BY CASE WHEN rank IN (3, 1, 8) THEN 0 ELSE 1 END, CASE rank WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 8 THEN 2 END, rank) AS rank FROM (SELECT id, row_number() OVER (ORDER BY final_score DESC, id) AS rank FROM ranked)",
    (M, TOP, RANKED),
)
def rerank_applied(spark, sf_dir):
    order = spark.createDataFrame([(2, 0), (0, 1), (7, 2), (2, 3), (40, 4), (-1, 5)], "position int, place int")
    ranked = ranking.with_rank(top_ranked(spark, sf_dir).select("id", "final_score"), F.desc("final_score"), F.col("id"))
    return ranking.apply_order(ranked, order).select("id", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT id, access_count + CASE WHEN id IN (SELECT id FROM top) THEN 1 ELSE 0 END AS access_count, CASE WHEN id IN (SELECT id FROM top) THEN TIMESTAMP '2024-02-01' ELSE last_accessed END AS last_accessed FROM memories", (M, TOP))
def access_update(spark, sf_dir):
    memories = T.memories(spark, sf_dir)
    return ranking.touch(memories, search.knn(memories, probe(spark, sf_dir), 50), T.NOW).select("id", "access_count", "last_accessed")


@query(f"SELECT id, project FROM memories WHERE {CURRENT} AND list_contains(tags, 'en') AND list_contains(tags, 'src3')", (M,))
def filter_tags_all(spark, sf_dir):
    return SearchFilters(tags=("en", "src3")).apply(T.memories(spark, sf_dir)).select("id", "project")


@query("SELECT id, valid_from, valid_to FROM memories WHERE visibility <> 'sensitive' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-20') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20')", (M,))
def filter_as_of(spark, sf_dir):
    return SearchFilters(as_of=datetime(2024, 1, 20)).apply(T.memories(spark, sf_dir)).select("id", "valid_from", "valid_to")


@query(f"SELECT id, valid_from FROM memories WHERE {CURRENT} AND valid_from <= TIMESTAMP '2024-01-25' AND valid_from >= TIMESTAMP '2024-01-15'", (M,))
def filter_valid_range(spark, sf_dir):
    return SearchFilters(valid_before=datetime(2024, 1, 25), valid_after=datetime(2024, 1, 15)).apply(T.memories(spark, sf_dir)).select("id", "valid_from")


@query("SELECT id, type, scope FROM memories WHERE visibility = 'sensitive' AND valid_to IS NULL AND user_id = '3' AND conflict_status = 'active'", (M,))
def filter_sensitive_user(spark, sf_dir):
    return SearchFilters(visibility="sensitive", user_id="3", conflict_status="active").apply(T.memories(spark, sf_dir)).select("id", "type", "scope")


@query(f"SELECT id, created_at FROM memories WHERE {CURRENT} ORDER BY created_at DESC, id LIMIT 20 OFFSET 20", (M,))
def list_page(spark, sf_dir):
    return page(T.memories(spark, sf_dir), SearchFilters(), 20, 20).select("id", "created_at")


@query(f"SELECT id, created_at FROM memories WHERE {CURRENT} AND id > 100 ORDER BY id LIMIT 25", (M,))
def list_keyset_page(spark, sf_dir):
    return keyset_page(T.memories(spark, sf_dir), SearchFilters(), 25, 100).select("id", "created_at")


@query("SELECT count(*) AS n FROM memories WHERE embedding IS NULL OR len(embedding) = 0", (M,))
def without_embedding(spark, sf_dir):
    from ..functions.vectors import is_empty

    return T.memories(spark, sf_dir).where(is_empty(F.col("embedding"))).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, round(tag_affinity_score, 6) AS affinity FROM (SELECT id, len(list_filter(tags, lambda t: list_contains(['en', 'deploy', 'the', 'src1', 'service'], t)))::double / len(tags) AS tag_affinity_score FROM memories WHERE {CURRENT})", (M,))
def tag_affinity(spark, sf_dir):
    return SearchFilters().apply(T.memories(spark, sf_dir)).select("id", ROUND(S.tag_affinity(F.col("tags"), ASKED)).alias("affinity"))


QUESTIONS = "q AS (SELECT item_id AS question_id, text AS ground_truth, CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'single-hop' ELSE 'multi-hop' END AS category FROM benchmark)"
SIGNIFICANT = r"list_filter(list_transform(list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> ''), lambda w: trim(w, '.,;:\"''()')), lambda w: strlen(w) >= 4 AND w NOT IN ('the', 'and', 'for', 'that', 'this', 'with', 'from', 'have', 'been', 'they'))"
RETRIEVED = f"""
asked AS (SELECT *, list_distinct({SIGNIFICANT.format('ground_truth')}) AS sought FROM q),
told AS (SELECT doc_id, text AS content, list_distinct({SIGNIFICANT.format('text')}) AS said FROM documents),
found AS (SELECT question_id, ground_truth, category, content, row_number() OVER (PARTITION BY question_id ORDER BY len(list_intersect(sought, said)) DESC, doc_id) AS rank
  FROM asked JOIN told ON len(list_intersect(sought, said)) > 0)"""
WORDS = "regexp_extract_all(lower({0}), '[a-z0-9'']+')"
SCORED = (
    "scored AS (SELECT *, CASE WHEN shared = 0 THEN 0 ELSE 2.0::double * shared / (len(a) + len(b)) END AS f1, ground_truth <> '' AND contains(lower(content), lower(ground_truth)) AS exact FROM ("
    "SELECT *, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))) AS shared FROM ("
    f"SELECT *, {WORDS.format('content')} AS a, {WORDS.format('ground_truth')} AS b FROM found WHERE rank <= 3)))"
)
RESULTS = """
results AS (
  SELECT q.question_id, q.category, coalesce(b.exact, false) AS exact_match, coalesce(b.f1, 0) AS f1_score, coalesce(r.hit, false) AS recalled_at_k FROM q
  LEFT JOIN (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY f1 DESC, rank) = 1) b USING (question_id)
  LEFT JOIN (SELECT question_id, bool_or(exact) AS hit FROM scored GROUP BY question_id) r USING (question_id))"""
MEASURES = "count(*) AS n, avg(exact_match::int::double) AS exact_match, round(avg(f1_score), 6) AS avg_f1, avg(recalled_at_k::int::double) AS recall_at_k, 0.0::double AS recall_at_k2"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("item_id") % 3 == 0, "").when(F.col("item_id") % 3 == 1, "single-hop").otherwise("multi-hop")
    return T.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("ground_truth"), category.alias("category"))


def retrieved(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """The ``k`` documents that share most of each question's significant words, best first; texts are read for these only."""
    asked, docs = questions(spark, sf_dir), T.read(spark, sf_dir, "documents")
    stored = docs.select(F.lit(0).alias("scope"), "doc_id", F.col("text").alias("content"))
    return by_words.recall_by_words(asked.select(F.lit(0).alias("scope"), "question_id", F.col("ground_truth").alias("question")), stored, k).join(asked, "question_id")


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.results(questions(spark, sf_dir), retrieved(spark, sf_dir), 3)


@query("SELECT question_id, rank, round(f1, 6) AS f1, exact FROM scored QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY f1 DESC, rank) = 1", (QUESTIONS, RETRIEVED, SCORED))
def best_candidate(spark, sf_dir):
    return evaluation.best_candidate(evaluation.score_candidates(retrieved(spark, sf_dir))).select("question_id", F.col("rank").cast("long").alias("rank"), ROUND("f1").alias("f1"), "exact")


@query(f"SELECT {MEASURES} FROM results", (QUESTIONS, RETRIEVED, SCORED, RESULTS))
def eval_summary(spark, sf_dir):
    return evaluation.summarise(eval_results(spark, sf_dir), 3, 2).withColumn("avg_f1", ROUND("avg_f1"))


@query(f"SELECT CASE WHEN category = '' THEN 'uncategorized' ELSE category END AS category, {MEASURES} FROM results GROUP BY ALL", (QUESTIONS, RETRIEVED, SCORED, RESULTS))
def eval_by_category(spark, sf_dir):
    return evaluation.by_category(eval_results(spark, sf_dir), 3, 2).withColumn("avg_f1", ROUND("avg_f1"))


@query("SELECT item_id, count(*) AS hits FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY item_id")
def exact_match_hits(spark, sf_dir):
    """How many documents hold each benchmark passage.

    A passage's inner words, between its single spaces, are whole words of every text that holds it, so only documents with
    its longest inner word are searched for it; passages without inner words are searched for everywhere."""
    asked = T.read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("truth"))
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    parts = F.split(F.lower("truth"), " ")
    inner = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    anchored = asked.withColumn("anchor", F.array_max(inner)["w"])
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("anchor"))
    maybe = words.join(anchored.where("anchor is not null"), "anchor").select("doc_id", "item_id", "truth")
    hits = maybe.join(docs, "doc_id").where(X.exact_match(F.col("text"), F.col("truth"))).select("item_id")
    bare = anchored.where("anchor is null").join(docs, X.exact_match(F.col("text"), F.col("truth"))).select("item_id")
    return hits.unionByName(bare).groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"))


#: The first turn of a conversation is asked, the answer is what came next; all turns but the question are stored.
PAIRS = f"""
pairs AS MATERIALIZED (SELECT conv_id AS pair_id, conv_id AS question_id, u.text AS question, a.text AS ground_truth, CASE conv_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS category FROM
  (SELECT conv_id, arg_min(text, turn) AS text, min(turn) AS turn FROM conversations GROUP BY conv_id) u JOIN conversations a USING (conv_id) WHERE a.turn = u.turn + 1),
asked AS (SELECT *, list_distinct({SIGNIFICANT.format('question')}) AS sought FROM pairs),
told AS MATERIALIZED (SELECT conv_id AS pair_id, conv_id * 1000 + turn AS doc_id, role || ': ' || text AS content, list_distinct({SIGNIFICANT.format("role || ': ' || text")}) AS said
  FROM conversations c WHERE turn > (SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id)),
found AS (SELECT a.question_id, ground_truth, category, content, row_number() OVER (PARTITION BY a.question_id ORDER BY len(list_intersect(sought, said)) DESC, doc_id) AS rank
  FROM asked a JOIN told t ON {{scope}} len(list_intersect(sought, said)) > 0)"""
RUN = "SELECT {0}, 0::bigint AS recall_failures, '{1}' AS mode FROM results"
PAIR_RESULTS = RESULTS.replace("FROM q\n", "FROM pairs q\n")


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = T.read(spark, sf_dir, "conversations")
    starts = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("q"))
    answers = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ground_truth"))
    asked = starts.select("conv_id", F.col("q.turn").alias("turn"), F.col("q.text").alias("question")).join(answers, ["conv_id", "turn"])
    category = F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")
    pairs = asked.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("question_id"), "question", "ground_truth", category.alias("category"))
    turns = rows.join(starts.select("conv_id", F.col("q.turn").alias("start")), "conv_id").where("turn > start")
    return pairs, turns.select(F.col("conv_id").alias("pair_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat_ws(": ", "role", "text").alias("content"))


@query(RUN.format(MEASURES, "per-pair-reset"), (PAIRS.format(scope="a.pair_id = t.pair_id AND"), SCORED, PAIR_RESULTS))
def eval_run_reset(spark, sf_dir):
    """Every conversation on its own: its first turn is asked of its other turns."""
    pairs, turns = _pairs(spark, sf_dir)
    return by_words.summary(by_words.evaluate(pairs, turns, 3), 3, 2, False).withColumn("avg_f1", ROUND("avg_f1"))


@query(RUN.format(MEASURES, "accumulate"), (PAIRS.format(scope=""), SCORED, PAIR_RESULTS))
def eval_run_accumulate(spark, sf_dir):
    """All turns are stored before any first turn is asked."""
    pairs, turns = _pairs(spark, sf_dir)
    return by_words.summary(by_words.evaluate(pairs, turns, 3, accumulate=True), 3, 2, True).withColumn("avg_f1", ROUND("avg_f1"))
