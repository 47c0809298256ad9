"""Memories, entities, facts, log entries, turns and questions derived from the driver's tables.

``MEMORIES_SQL`` and the like say the same for an independent SQL engine."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2024, 2, 1)
#: Edges carry dates of orders, which are older.
EDGE_NOW = datetime(1999, 1, 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    n, now = F.col("doc_id"), F.lit(NOW)
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    minutes = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))
    tens, eights = n % 10, F.floor(n / 8)
    created = now - minutes(n * 997 % 40000)
    return docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select(
        n.alias("id"),
        pick(["rule", "procedure", "fact", "episode", "preference"], n % 5).alias("type"),
        pick(["permanent", "project", "session", "ttl"], F.floor(n / 5) % 4).alias("scope"),
        F.when(n % 17 == 0, "sensitive").when(n % 3 == 0, "private").otherwise("shared").alias("visibility"),
        F.col("text").alias("content"),
        ((n % 101) / 100.0).alias("confidence"),
        F.lit("explicit").alias("source"),
        F.array("lang", "source").alias("tags"),
        F.col("source").alias("project"),
        (n % 7).cast("string").alias("user_id"),
        (n % 30 * 86400).alias("ttl_seconds"),
        created.alias("created_at"),
        created.alias("updated_at"),
        (now - minutes(n * 53 % 4000)).alias("last_accessed"),
        (n % 1024).alias("access_count"),
        (n % 14).cast("int").alias("reinforced_count"),
        F.lit(None).cast("timestamp").alias("reinforced_at"),
        F.when(tens.isin(8, 9), n - 1).alias("supersedes_id"),
        F.when(n % 7 == 0, now + minutes(n * 11 % 2000 - 1000)).alias("valid_until"),
        created.alias("valid_from"),
        F.when(tens.isin(7, 8), F.greatest(created, now - minutes(n % 500))).alias("valid_to"),
        F.when((n % 8).isin(3, 4), F.concat(F.lit("g"), eights.cast("string"))).alias("conflict_group_id"),
        F.when((n % 8).isin(3, 4), "active").otherwise("").alias("conflict_status"),
        "embedding",
    )


MEMORIES_SQL = """
memories AS (
  SELECT doc_id AS id, (['rule', 'procedure', 'fact', 'episode', 'preference'])[doc_id % 5 + 1] AS type,
    (['permanent', 'project', 'session', 'ttl'])[doc_id // 5 % 4 + 1] AS scope,
    CASE WHEN doc_id % 17 = 0 THEN 'sensitive' WHEN doc_id % 3 = 0 THEN 'private' ELSE 'shared' END AS visibility,
    text AS content, (doc_id % 101) / 100.0::double AS confidence, 'explicit' AS source, [lang, d.source] AS tags, d.source AS project,
    (doc_id % 7)::varchar AS user_id, doc_id % 30 * 86400 AS ttl_seconds,
    TIMESTAMP '2024-02-01' - to_minutes(doc_id * 997 % 40000) AS created_at, TIMESTAMP '2024-02-01' - to_minutes(doc_id * 53 % 4000) AS last_accessed,
    doc_id % 1024 AS access_count, doc_id % 14 AS reinforced_count,
    CASE WHEN doc_id % 10 IN (8, 9) THEN doc_id - 1 END AS supersedes_id,
    CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-02-01' + to_minutes(doc_id * 11 % 2000 - 1000) END AS valid_until,
    TIMESTAMP '2024-02-01' - to_minutes(doc_id * 997 % 40000) AS valid_from,
    CASE WHEN doc_id % 10 IN (7, 8) THEN greatest(TIMESTAMP '2024-02-01' - to_minutes(doc_id * 997 % 40000), TIMESTAMP '2024-02-01' - to_minutes(doc_id % 500)) END AS valid_to,
    CASE WHEN doc_id % 8 IN (3, 4) THEN 'g' || (doc_id // 8)::varchar END AS conflict_group_id,
    CASE WHEN doc_id % 8 IN (3, 4) THEN 'active' ELSE '' END AS conflict_status, embedding::double[] AS embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts; each names up to two memories by its key."""
    docs = read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    parts = (("region", "r", "r_regionkey", "r_name", "concept"), ("nation", "n", "n_nationkey", "n_name", "concept"), ("customer", "c", "c_custkey", "c_name", "person"), ("supplier", "s", "s_suppkey", "s_name", "project"), ("part", "p", "p_partkey", "p_name", "system"))
    out = None
    for table, prefix, key, name, kind in parts:
        k = F.col(key).cast("long")
        rows = read(spark, sf_dir, table).select(F.concat(F.lit(prefix), k.cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), F.array(F.concat(F.lit(f"{table} "), k.cast("string"))).alias("aliases"), k.alias("k"))
        out = rows if out is None else out.unionByName(rows)
    return out.crossJoin(F.broadcast(docs)).select("id", "name", "type", "aliases", F.array(F.col("k") % F.col("n"), (F.col("k") * 7) % F.col("n")).alias("memory_ids"))


ENTITIES_SQL = """
entities AS (
  SELECT prefix || k::varchar AS id, name, type, [tab || ' ' || k::varchar] AS aliases, [k % n, k * 7 % n] AS memory_ids FROM (
    SELECT 'r' AS prefix, 'region' AS tab, r_regionkey::bigint AS k, r_name AS name, 'concept' AS type FROM region
    UNION ALL SELECT 'n', 'nation', n_nationkey::bigint, n_name, 'concept' FROM nation
    UNION ALL SELECT 'c', 'customer', c_custkey, c_name, 'person' FROM customer
    UNION ALL SELECT 's', 'supplier', s_suppkey, s_name, 'project' FROM supplier
    UNION ALL SELECT 'p', 'part', p_partkey, p_name, 'system' FROM part), (SELECT count(*) AS n FROM documents)
)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where customers, suppliers and nations are, and what customers use, with the memories that say so."""
    t = lambda name: read(spark, sf_dir, name)
    docs = t("documents").agg(F.count(F.lit(1)).alias("n"))
    vectors = t("embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("fact_embedding"))
    start = F.lit(datetime(1998, 1, 1))
    text = lambda c: F.col(c).cast("string")

    def edge(rows: DataFrame, kind: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return rows.select(F.concat(F.lit(f"{kind}:"), text(x), F.lit(":"), text(y)).alias("id"), F.concat(F.lit(a), text(x)).alias("source_entity_id"), F.concat(F.lit(b), text(y)).alias("target_entity_id"), F.lit(kind).alias("relation_type"), F.col(x).cast("long").alias("k"), "created_at")

    flat = lambda df: df.withColumn("created_at", start)
    used = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.min(F.col("o_orderdate").cast("timestamp")).alias("created_at"))
    rows = (
        edge(flat(t("customer")), "LOCATED_IN", "c", "c_custkey", "n", "c_nationkey")
        .unionByName(edge(flat(t("supplier")), "BASED_IN", "s", "s_suppkey", "n", "s_nationkey"))
        .unionByName(edge(flat(t("nation")), "PART_OF", "n", "n_nationkey", "r", "n_regionkey"))
        .unionByName(edge(used, "USES", "c", "o_custkey", "p", "l_partkey"))
    )
    fact = F.concat_ws(" ", "source_entity_id", F.lower(F.replace("relation_type", F.lit("_"), F.lit(" "))), "target_entity_id")
    expired = F.when((F.col("k") % 11 == 0) & (F.col("relation_type") == "USES"), F.lit(EDGE_NOW))
    return rows.join(vectors, "k", "left").crossJoin(F.broadcast(docs)).select("id", "source_entity_id", "target_entity_id", "relation_type", fact.alias("fact"), "fact_embedding", "created_at", expired.alias("expired_at"), F.array(F.col("k") % F.col("n")).alias("source_memory_ids"), "k")


FACTS_SQL = """
facts AS (
  SELECT relation_type || ':' || x || ':' || y AS id, a || x AS source_entity_id, b || y AS target_entity_id, relation_type,
    a || x || ' ' || lower(replace(relation_type, '_', ' ')) || ' ' || b || y AS fact, embedding::double[] AS fact_embedding, created_at,
    CASE WHEN k % 11 = 0 AND relation_type = 'USES' THEN TIMESTAMP '1999-01-01' END AS expired_at, [k % n] AS source_memory_ids, k
  FROM (
    SELECT 'LOCATED_IN' AS relation_type, 'c' AS a, 'n' AS b, c_custkey::varchar AS x, c_nationkey::varchar AS y, c_custkey AS k, TIMESTAMP '1998-01-01' AS created_at FROM customer
    UNION ALL SELECT 'BASED_IN', 's', 'n', s_suppkey::varchar, s_nationkey::varchar, s_suppkey, TIMESTAMP '1998-01-01' FROM supplier
    UNION ALL SELECT 'PART_OF', 'n', 'r', n_nationkey::varchar, n_regionkey::varchar, n_nationkey::bigint, TIMESTAMP '1998-01-01' FROM nation
    UNION ALL SELECT 'USES', 'c', 'p', o_custkey::varchar, l_partkey::varchar, o_custkey, min(o_orderdate) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey
  ) LEFT JOIN embeddings e ON e.vec_id = k, (SELECT count(*) AS n FROM documents)
)"""


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries of users: the state comes from the event's type."""
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "processing").otherwise("pending")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), state.alias("state"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("props").alias("content"), F.lit(0).alias("attempts"))


WAL_SQL = """
wal AS (
  SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'pending' END AS state,
    ts AS updated_at, props AS content FROM events
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn with the assistant's that follows it."""
    rows = read(spark, sf_dir, "conversations")
    user = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_msg"))
    reply = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_msg"))
    return user.join(reply, ["conv_id", "turn"])


TURNS_SQL = """
turns AS (
  SELECT u.conv_id, u.turn, u.text AS user_msg, a.text AS assistant_msg
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'
)"""
