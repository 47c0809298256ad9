"""Queries on stores that are written batch by batch: the log in segments, captured memories, backfilled embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding
from ..session import scratch
from ..sources import tables as T
from ..streaming import capture, wal
from ..streaming.segments import SegmentLog
from .records import COMING, LATEST
from .registry import query
from .retrieval import M

WAL_ROWS = "id long, seq long, state string, updated_at timestamp"


@query("SELECT id, seq, state, updated_at FROM latest WHERE state <> 'done'", (T.WAL_SQL, LATEST))
def wal_segments(spark, sf_dir):
    """The log arrives in three batches, one of them twice, and is compacted to its latest entries between the last two."""
    log, rows = SegmentLog(spark, scratch(spark, "wal"), WAL_ROWS), T.wal(spark, sf_dir)
    for batch in (0, 1, 0):
        log.append(rows.where(F.col("seq") % 3 == batch), batch)
    log.compact(wal.latest)
    log.append(rows.where("seq % 3 = 2"), 2)
    return wal.compact(log.read()).select("id", "seq", "state", "updated_at")


@query("SELECT id, count(*) - 1 AS reinforced FROM (SELECT coalesce(rec, id::varchar) AS id FROM steps JOIN coming USING (place)) GROUP BY id", (M, COMING), recursive=True)
def captured_records(spark, sf_dir):
    """All memories with a vector arrive in three micro-batches, the second of them twice: the same records as in one go."""
    store = SegmentLog(spark, scratch(spark, "captured"), capture.STORE)
    rows = capture.in_batches(T.memories(spark, sf_dir).where("embedding is not null").select("id", F.col("id").alias("seq"), "content", "embedding"), 3)
    for batch in (0, 1, 1, 2):
        capture.capture_batch(rows.where(F.col("batch") == batch), batch, store, 0.35)
    capture.compact_records(store)
    return capture.records(store.read()).select("id", "reinforced")


def letter_model():
    """A model for the queries and tests: how many of a text's bytes fall on each of eight residues."""
    return lambda texts: [[float(t.encode().translate(None, bytes(b for b in range(256) if b % 8 != i)).__len__()) for i in range(8)] for t in texts]


@query("SELECT count(*) FILTER (embedding IS NULL) AS embedded, 0 AS without_embedding, sum(CASE WHEN embedding IS NULL THEN strlen(coalesce(content, '')) ELSE 0 END)::bigint AS bytes FROM memories", (M,))
def backfilled_embeddings(spark, sf_dir):
    """Memories without a vector get one, in four parts, each of which is there whole or not at all."""
    memories, done = T.memories(spark, sf_dir), SegmentLog(spark, scratch(spark, "backfill"), "id string, embedding array<double>")
    embedding.backfill(memories, letter_model, done, parts=4)
    after = embedding.with_backfilled(memories, done)
    new = done.read().agg(F.count(F.lit(1)).alias("embedded"), F.coalesce(F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)), F.lit(0.0)).cast("long").alias("bytes"))
    return embedding.to_embed(after).agg(F.count(F.lit(1)).cast("int").alias("without_embedding")).join(F.broadcast(new), how="cross").select("embedded", "without_embedding", "bytes")
