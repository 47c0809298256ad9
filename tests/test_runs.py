"""Extraction, lifecycle phases, hybrid search with failures, indexing of chunks, hot names, and the log's stream."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolith.functions.vectors import cosine
from mnemolith.operators import extraction, graph, lifecycle, ranking
from mnemolith.operators.chunks import index_chunks
from mnemolith.plans.runs import long_words, next_words, note_chunks
from mnemolith.schema import MEMORY
from mnemolith.streaming import wal

NOW = datetime(2024, 2, 1)


def memories(spark, *rows):
    blank = {f.name: None for f in MEMORY} | {"visibility": "shared", "conflict_status": ""}
    return spark.createDataFrame([tuple((blank | r)[f.name] for f in MEMORY) for r in rows], MEMORY)


def test_extraction(spark):
    texts = spark.createDataFrame([(1, "Alexandria elephantine"), (2, "alexandria # lost"), (3, "elephantine Alexandria 5%"), (4, None), (5, "alexandria ALEXANDRIA elephantine unheard-of")], "id int, content string")
    known = spark.createDataFrame([("k1", " ELEPHANTINE "), ("k0", "nobody")], "id string, name string")
    got = extraction.extract(texts, known, long_words, next_words)
    entities = {r["name"]: r for r in got.entities.collect()}
    assert {n: (r["type"], r["is_new"]) for n, r in entities.items()} == {"Alexandria": ("person", True), "elephantine": ("concept", False)}
    a, e = entities["Alexandria"]["id"], entities["elephantine"]["id"]
    assert e == "k1" and sorted(tuple(r) for r in got.links.collect()) == sorted([(a, 1), (a, 3), (a, 5), (e, 1), (e, 3), (e, 5)])
    # Of 5, the first two words are one entity, so there is no fact between them; the last has another text than that of 1.
    facts = {r["fact"]: r for r in got.facts.collect()}
    assert set(facts) == {"Alexandria uses elephantine", "ALEXANDRIA uses elephantine"}
    assert all((r["source_entity_id"], r["target_entity_id"], r["relation_type"]) == (a, e, "USES") for r in facts.values())
    assert sorted(r["memory_id"] for r in got.fact_links.collect()) == [1, 5]
    assert got.counts.first().asDict() == {"entities_extracted": 7, "facts_extracted": 2, "errors": 2}


def test_extraction_without_entities_asks_for_no_facts(spark):
    def never():
        raise AssertionError("loaded")

    texts = spark.createDataFrame([(1, "# gone"), (2, "short")], "id int, content string")
    known = spark.createDataFrame([], "id string, name string")
    for rows, errors in ((texts, 1), (texts.limit(0), 0)):
        got = extraction.extract(rows, known, long_words, never)
        assert got.counts.first().asDict() == {"entities_extracted": 0, "facts_extracted": 0, "errors": errors}
        assert got.entities.isEmpty() and got.links.isEmpty() and got.facts.isEmpty() and got.fact_links.isEmpty()


def test_repeated_rows_and_blank_names(spark):
    odd = lambda: lambda text: [{"name": n} for n in (" Bob ", "", None, "bob")]
    said = lambda: lambda text: [{"source_name": "BOB", "target_name": "who"}, {"source_name": None, "target_name": "bob"}]
    rows = spark.createDataFrame([(1, "x"), (1, "x")], "id int, content string")
    got = extraction.extract(rows, spark.createDataFrame([], "id string, name string"), odd, said)
    assert [(r["name"], r["type"]) for r in got.entities.collect()] == [("Bob", "concept")] and got.links.count() == 1
    assert got.counts.first().asDict() == {"entities_extracted": 4, "facts_extracted": 0, "errors": 0}


def test_extraction_stores_short_rows(spark, monkeypatch):
    """Each statement was stored and sent with three hashes. Names of one entity are one on the way, too."""
    stored, cut_off = [], extraction.cut_off
    monkeypatch.setattr(extraction, "cut_off", lambda df: stored.append(set(df.columns)) or cut_off(df))
    texts = spark.createDataFrame([(1, "Alexandria elephantine unheardof"), (1, "Alexandria elephantine unheardof"), (2, "alexandria unheardof"), (3, "Alexandria unheardof")], "id int, content string")
    got = extraction.extract(texts, spark.createDataFrame([("k", "alexandria"), ("k", "elephantine")], "id string, name string"), long_words, next_words)
    assert not any({"source_entity_id", "target_entity_id"} & columns for columns in stored)
    (new,) = (r["id"] for r in got.entities.where("is_new").collect())
    assert sorted(map(tuple, got.links.collect())) == sorted([("k", 1), ("k", 2), ("k", 3), (new, 1), (new, 2), (new, 3)])
    facts = {r["fact"]: r for r in got.facts.collect()}
    assert {f: (r["source_entity_id"], r["target_entity_id"], r["memories"]) for f, r in facts.items()} == {f: ("k", new, 1) for f in ("elephantine uses unheardof", "alexandria uses unheardof", "Alexandria uses unheardof")}
    assert sorted(map(tuple, got.fact_links.collect())) == sorted((facts[f"{w} uses unheardof"]["id"], n) for w, n in (("elephantine", 1), ("alexandria", 2), ("Alexandria", 3)))
    assert got.counts.first().asDict() == {"entities_extracted": 10, "facts_extracted": 4, "errors": 0}


def stale(spark):
    old = NOW - timedelta(days=3)
    pair = {"conflict_status": "active", "conflict_group_id": "g", "scope": "permanent", "created_at": old}
    return memories(
        spark,
        {"id": "ttl", "scope": "ttl", "ttl_seconds": 60, "created_at": old},
        {"id": "session", "scope": "session", "created_at": old},
        {"id": "p1", "scope": "permanent", "embedding": [1.0, 0.0], "confidence": 0.9, "created_at": old, "valid_until": old},
        {"id": "p2", "scope": "permanent", "embedding": [1.0, 0.01], "confidence": 0.5, "created_at": NOW},
        {"id": "c1", "confidence": 0.5, **pair},
        {"id": "c2", "confidence": 0.8, **pair},
        {"id": "old", "scope": "session", "created_at": old, "valid_to": old},
    )


def actions(run):
    return sorted((r["id"], r["action"]) for r in run.actions.collect())


def test_lifecycle_phases(spark):
    rows = stale(spark)
    run = lifecycle.run_phases(rows, NOW).checked()
    assert actions(run) == [("c1", "conflicts"), ("p1", "retired"), ("p2", "consolidated"), ("session", "decayed"), ("ttl", "expired")]
    assert [(r["phase"], r["n"]) for r in run.report.collect()] == [("expired", 1), ("decayed", 1), ("consolidated", 1), ("retired", 1), ("conflicts", 1)]
    assert {r["id"]: r["conflict_status"] for r in run.memories.collect()} == {"c1": "resolved", "c2": "resolved", "old": ""}
    dry = lifecycle.run_phases(rows, NOW, dry_run=True)
    assert actions(dry) == actions(run) and dry.memories.count() == rows.count() and dry.memories.where("conflict_status = 'resolved'").isEmpty()
    assert lifecycle.run_phases(rows.limit(0), NOW).checked().actions.isEmpty()


def test_phases_store_no_contents(spark, monkeypatch):
    """Tables of whole memories were written and read again after each phase."""
    stored, cut_off = [], lifecycle.cut_off
    monkeypatch.setattr(lifecycle, "cut_off", lambda df: stored.append(set(df.columns)) or cut_off(df))
    run = lifecycle.run_phases(stale(spark), NOW).checked()
    assert stored and not any(columns & {"content", "tags", "metadata"} for columns in stored)
    assert {r["id"] for r in run.memories.collect()} == {"c1", "c2", "old"}


def test_a_phase_that_fails_is_reported_and_the_rest_goes_on(spark):
    steps = lifecycle.phases(NOW) | {"decayed": lambda m: m.where(F.assert_true(F.col("id") == "", F.lit("no such table")).isNull()), "consolidated": lambda m: 1 / 0}
    run = lifecycle.run_phases(stale(spark), NOW, steps)
    assert actions(run) == [("c1", "conflicts"), ("p1", "retired"), ("ttl", "expired")]
    assert {r["phase"] for r in run.report.where("error is not null").collect()} == {"decayed", "consolidated"}
    with pytest.raises(RuntimeError, match="consolidated: division by zero"):
        run.checked()


def test_a_search_that_fails_in_a_task_is_left_out(spark):
    ranked = lambda n: spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    broken = lambda n: ranked(n).withColumn("rank", F.assert_true(F.col("rank") > 5).cast("int"))
    assert [r["id"] for r in ranking.hybrid_search([broken, ranked], 5).collect()] == ["a", "b"]
    for searches in ([broken], []):
        with pytest.raises(RuntimeError):
            ranking.hybrid_search(searches, 5)


def test_index_chunks_is_the_plain_loop(spark, small):
    chunks = note_chunks(spark, small).where("file < '000000060.md'").persist()
    plain = sorted(chunks.collect(), key=lambda r: (r["file"], r["seq"], r["piece"]))
    kept, want = [np.array(plain[3]["embedding"])], []
    for r in plain:
        v = np.array(r["embedding"])
        if not any(v @ u / np.sqrt((v @ v) * (u @ u)) >= 0.95 for u in kept):
            kept.append(v)
            want.append((r["file"], r["seq"], r["piece"]))
    stored = spark.createDataFrame([("s", list(plain[3]["embedding"]))], "id string, embedding array<double>")
    got = index_chunks(chunks, stored)
    assert sorted((r["file"], r["seq"], r["piece"]) for r in got.collect()) == want and len(want) < len(plain)
    assert index_chunks(chunks.limit(0), stored).isEmpty()
    blank = chunks.limit(2).withColumn("embedding", F.lit(None).cast("array<double>"))
    assert index_chunks(blank, stored).count() == 2
    chunks.unpersist()


def test_hot_names_meet_by_vectors(spark):
    rng = np.random.default_rng(3)
    vector = lambda: [float(x) for x in rng.integers(-1, 2, 3)]
    known = spark.createDataFrame([(f"e{i}", f"CUST{i % 30}" if i % 7 else None, vector() if i % 11 else None) for i in range(150)], "entity_id string, name string, name_embedding array<double>")
    asked = spark.createDataFrame([(str(i), ("cust", "UST1", "7", "none", None, "")[i % 6], vector()) for i in range(60)] + [("1", "cust2", [1.0, 0.0, 0.0])], "id string, name string, embedding array<double>")
    both = graph.names_holding(asked, known)
    want = {(r["id"], r["entity_id"]) for r in both.where(cosine(F.col("embedding"), F.col("name_embedding")) > 0.9).collect()}
    for hot in (0, 20, 10**6):
        assert {(r["id"], r["entity_id"]) for r in graph.alike_names(asked, known, 0.9, hot).collect()} == want and want


def test_stream_and_batch_agree_over_restarts(spark, tmp_path):
    at = lambda h: NOW + timedelta(hours=h)
    # The second file has an older line, one of the same time written earlier, one of the same time written later, and one without a time.
    parts = [[("a", 1, "pending", at(1)), ("b", 5, "pending", at(1)), ("c", 2, "done", at(3)), ("d", 3, "failed", at(2))], [("a", 6, "done", at(2)), ("b", 4, "done", at(1)), ("c", 7, "pending", at(1)), ("d", 8, "done", at(2)), ("e", 9, "pending", None), ("a", 10, "failed", None)]]
    schema, seen = "id string, seq long, state string, updated_at timestamp", {}
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = wal.stream_latest(spark.readStream.schema(schema).parquet(str(tmp_path / "log")))
        take = lambda batch, n: seen.update({r["id"]: r["state"] for r in batch.collect()})
        stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {r["id"]: r["state"] for r in wal.latest(spark.read.parquet(str(tmp_path / "log"))).collect()} == {"a": "done", "b": "done", "c": "done", "d": "failed", "e": "pending"}
