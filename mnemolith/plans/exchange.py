"""Queries on files written and read back, on log entries and on checks of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.chunks import chunk_files
from ..operators.filters import long_enough
from ..schema import WAL
from ..session import scratch
from ..sources import files
from ..sources import tables as T
from ..streaming import wal
from .records import LATEST
from .registry import query
from .retrieval import CURRENT, TURNS, M

NOW = "TIMESTAMP '2024-02-01'"


@query(f"SELECT id::varchar AS id, type, scope, visibility, content, confidence, source, array_to_string(tags, ',') AS tags, project, created_at, created_at AS updated_at, access_count FROM memories WHERE {CURRENT}", (M,))
def export_json_files(spark, sf_dir):
    """The whole export, written as JSON lines and read back."""
    path = scratch(spark, "export-json")
    files.write_json(T.memories(spark, sf_dir), path)
    return files.read_memories(spark, path).select(*files.EXPORTED).withColumn("tags", F.array_join("tags", ","))


@query(f"SELECT id::varchar AS id, type, scope, visibility, content, printf('%.4f', confidence) AS confidence, source, project, created_at, access_count FROM memories WHERE {CURRENT}", (M,))
def export_csv_files(spark, sf_dir):
    """The whole export, written as CSV and read back."""
    path = scratch(spark, "export-csv")
    files.write_csv(T.memories(spark, sf_dir), path)
    return files.read_csv(spark, path)


@query("SELECT role, text AS content FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL")
def transcript_messages(spark, sf_dir):
    """Conversations as transcripts: the role stands in either place and in any case of letters; other roles and broken lines are left out."""
    path = scratch(spark, "transcripts")
    turns = T.read(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", F.when(F.col("conv_id") % 2 == 0, "Human").otherwise("USER")).otherwise(F.initcap("role"))
    outside = F.col("turn") % 2 == 0
    line = lambda outer, inner: F.to_json(F.struct(outer.alias("role"), F.struct(inner.alias("role"), F.col("text").alias("content")).alias("message")))
    said = turns.select(line(F.when(outside, role), F.when(~outside, role)).alias("value"))
    other = turns.select(line(F.lit("tool"), F.lit("user")).alias("value"))
    broken = turns.select(F.concat(F.lit('{"role": "user", "message": '), F.col("turn").cast("string")).alias("value"))
    said.unionByName(other).unionByName(broken).write.text(path)
    return files.read_transcript(spark, path).select("role", "content")


@query("SELECT id::varchar AS id, state, updated_at, content FROM latest", (T.WAL_SQL, LATEST))
def wal_log_files(spark, sf_dir):
    """The log as JSON lines with some that can't be read, and the latest entries of it."""
    path = scratch(spark, "log")
    entries = T.wal(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    known = set(entries.columns)
    wal.append_log(entries.select(*[(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in WAL]), path)
    entries.select(F.concat(F.lit("{"), "id").alias("value")).write.mode("append").text(path)
    return wal.latest(wal.read_log(spark, path)).select("id", "state", "updated_at", "content")


@query(f"SELECT id, 'done' AS state, NULL::varchar AS content, {NOW} AS updated_at FROM latest WHERE state IN ('pending', 'processing')", (T.WAL_SQL, LATEST))
def wal_tombstones(spark, sf_dir):
    return wal.tombstones(wal.replay(T.wal(spark, sf_dir)), "done", T.NOW).select("id", "state", "content", "updated_at")


@query(f"SELECT sha256('rebuild:' || id::varchar) AS id, id AS memory_id, {NOW} AS enqueued_at, 0::int AS attempts, 'pending' AS state FROM memories", (M,))
def graph_rebuild(spark, sf_dir):
    return wal.enqueue_all(T.memories(spark, sf_dir), T.NOW).select("id", "memory_id", "enqueued_at", "attempts", "state")


@query(f"SELECT sha256(concat_ws('|', 's1', user_msg, assistant_msg)) AS uuid, 's1' AS session_id, {NOW} AS captured_at FROM turns", (TURNS,))
def episode_rows(spark, sf_dir):
    return files.stamp_episode(T.turns(spark, sf_dir), "s1", T.NOW).select("uuid", "session_id", "captured_at")


@query(r"SELECT doc_id, length(trim(coalesce(text, ''), e' \n\t\r')) >= 10 AS long_enough FROM documents")
def content_length(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", long_enough(F.col("text")).alias("long_enough"))


@query(
    r"""SELECT strlen(content) AS n, CASE type WHEN 'rule' THEN 'fact' WHEN 'episode' THEN 'odd' ELSE type END AS type, CASE scope WHEN 'ttl' THEN 'permanent' WHEN 'session' THEN 'odd' ELSE scope END AS scope,
      CASE WHEN id % 101 = 0 THEN 0.9::double WHEN id % 101 > 90 THEN confidence + 1 ELSE confidence END AS confidence,
      CASE WHEN length(trim(coalesce(content, ''), e' \n\t\r')) < 10 THEN 'content is too short' WHEN type = 'episode' THEN 'unknown type' WHEN scope = 'session' THEN 'unknown scope' WHEN id % 101 > 90 THEN 'confidence is not between 0 and 1' END AS error
    FROM memories""",
    (M,),
)
def batch_validation(spark, sf_dir):
    """Rows of a batch with missing and with wrong values."""
    rows = T.memories(spark, sf_dir).select(
        "content",
        F.when(F.col("type") == "rule", "").when(F.col("type") == "episode", "odd").otherwise(F.col("type")).alias("type"),
        F.when(F.col("scope") == "session", "odd").when(F.col("scope") != "ttl", F.col("scope")).alias("scope"),
        "tags",
        F.when(F.col("id") % 101 > 90, F.col("confidence") + 1).otherwise(F.col("confidence")).alias("confidence"),
    )
    return files.validate_batch(rows).select(F.octet_length("content").cast("long").alias("n"), "type", "scope", "confidence", "error")


@query("SELECT id, type, content, confidence, array_to_string(tags, ',') AS tags FROM memories", (M,))
def llm_memories(spark, sf_dir):
    """Memories as a model may give them: an array, or an object with one."""
    array = F.array(F.struct("type", "content", "confidence", "tags"))
    told = T.memories(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.to_json(array)).otherwise(F.to_json(F.struct(array.alias("memories")))).alias("told"))
    found = told.select("id", F.explode(files.parse_llm_memories(F.col("told"))).alias("m"))
    return found.select("id", "m.type", "m.content", "m.confidence", F.array_join("m.tags", ",").alias("tags"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::timestamp END AS at FROM orders")
def lenient_times(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("string")).otherwise("some time in May")
    return T.read(spark, sf_dir, "orders").select("o_orderkey", files.lenient_timestamp(said).alias("at"))


@query(r"""SELECT p_partkey, array_to_string(list_concat(['part.' || p_partkey::varchar], list_filter(list_transform(string_split_regex(lower(p_name), '\s+'), lambda w: trim(w, '.,;:!?()[]{}"''`')), lambda w: strlen(w) > 2)), ',') AS tags FROM part""")
def heading_tags(spark, sf_dir):
    path = F.concat(F.lit("/notes/part."), F.col("p_partkey").cast("string"), F.lit(".md"))
    return T.read(spark, sf_dir, "part").select("p_partkey", F.array_join(X.heading_tags(F.col("p_name"), path), ",").alias("tags"))


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'skipped' WHEN 'click' THEN 'updated' WHEN 'view' THEN NULL ELSE 'created' END AS status,
      CASE WHEN event_type NOT IN ('error', 'view') THEN h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS id FROM (SELECT *, md5(event_id::varchar) AS h FROM events)"""
)
def store_outputs(spark, sf_dir):
    """Lines that report what became of a record."""
    uuid = F.regexp_replace(F.md5(F.col("event_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    line = F.when(F.col("event_type") == "error", "Skipped: a duplicate").when(F.col("event_type") == "view", "Nothing to say").when(F.col("event_type") == "click", F.concat(F.lit("Updated memory "), uuid)).otherwise(F.concat(F.lit("Stored memory "), uuid, F.lit(".")))
    return T.read(spark, sf_dir, "events").select("event_id", X.parse_store_output(line).alias("r")).select("event_id", "r.status", "r.id")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'unknown' ELSE (o_custkey % 4)::varchar || '-hop' END AS hops, CASE o_custkey % 3 WHEN 0 THEN 'temporal' WHEN 1 THEN 'multi-hop' ELSE 'single-hop' END AS category, CASE WHEN o_custkey % 3 = 1 THEN 'person' ELSE 'concept' END AS kind FROM orders")
def normalised_names(spark, sf_dir):
    """Categories and types in the spellings that evaluation sets and models give them."""
    n = F.col("o_custkey") % 3
    raw = F.when(n == 0, " Temporal Reasoning ").when(n == 1, "multi_HOP").otherwise("Single-Hop")
    kind = F.when(n == 1, "person").when(n == 2, "ghost")
    return T.read(spark, sf_dir, "orders").select("o_orderkey", X.hop_category(F.col("o_custkey") % 4).alias("hops"), X.normalise_question_type(raw).alias("category"), X.member_or(kind, ("person", "concept"), "concept").alias("kind"))


@query(
    """SELECT p_partkey::varchar AS file, 0::int AS seq, p_name AS heading, p_name AS path, 1::int AS depth, 3::int AS word_count, e'before\\nabc def' AS content FROM part
    UNION ALL SELECT p_partkey::varchar, 1, 'Deep', p_name || ' / Deep', 3, 3, 'x  y z' FROM part
    UNION ALL SELECT p_partkey::varchar, 3, 'Last', p_name || ' / Last', 2, 2, '##### no' FROM part"""
)
def markdown_chunks(spark, sf_dir):
    """Notes on parts: text before the first heading, a skipped level, an empty section, and marks that are too many for a heading."""
    note = F.concat(F.lit("before\n# "), "p_name", F.lit("\nabc def\n### Deep\n x  y z \n\n## Next\n## Last\n##### no\n"))
    notes = T.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), note.alias("text"))
    return chunk_files(notes).select("file", "seq", "heading", "path", "depth", "word_count", "content")


@query("SELECT conv_id, contains(array_to_string(texts[1:2], chr(1)), ask) AS early, contains(array_to_string(texts, chr(1)), ask) AS ever FROM (SELECT conv_id, list(lower(text) ORDER BY turn) AS texts, lower(split_part(arg_max(text, turn), ' ', 1)) AS ask FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) WHERE ask <> ''")
def recall_at_k(spark, sf_dir):
    """Whether the first word of a conversation's last turn stands in its first two turns, and in any."""
    turns = T.read(spark, sf_dir, "conversations").where("text is not null")
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"].alias("texts"), F.split_part(F.max_by("text", "turn"), F.lit(" "), F.lit(1)).alias("ask")).where("ask <> ''")
    return said.select("conv_id", X.recall_at_k(F.col("texts"), F.col("ask"), 2).alias("early"), X.recall_at_k(F.col("texts"), F.col("ask"), 2147483647).alias("ever"))
