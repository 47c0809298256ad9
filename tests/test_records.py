"""Versions, lifecycle, writes, graph and log on hand-made rows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemolith.operators import contradiction, graph, lifecycle, stats, versions, writes
from mnemolith.operators.filters import SearchFilters, checked_threshold, keyset_page, parse_filters
from mnemolith.operators.search import find_duplicates, knn, similar_pairs
from mnemolith.schema import FACT, MEMORY, WAL
from mnemolith.sources import files
from mnemolith.streaming import wal

NOW = datetime(2024, 2, 1)


def memory(**over):
    row = {f.name: None for f in MEMORY} | {"type": "fact", "scope": "permanent", "visibility": "shared", "content": "some content", "confidence": 0.9, "tags": ["test"], "project": "", "access_count": 0, "reinforced_count": 0, "created_at": NOW, "conflict_status": ""}
    return tuple((row | over)[f.name] for f in MEMORY)


def table(spark, *rows):
    return spark.createDataFrame([memory(**r) for r in rows], MEMORY)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_filters(spark):
    df = table(spark, {"id": "a"}, {"id": "b", "visibility": "sensitive"}, {"id": "c", "valid_from": NOW, "valid_to": NOW + timedelta(days=1)}, {"id": "d", "tags": ["test", "x"], "user_id": "u", "conflict_status": "active"}, {"id": "e", "visibility": None})
    assert ids(SearchFilters().apply(df)) == ["a", "d", "e"]
    assert ids(SearchFilters(visibility="sensitive").apply(df)) == ["b"]
    assert ids(SearchFilters(include_invalidated=True).apply(df)) == ["a", "c", "d", "e"]
    assert ids(SearchFilters(tags=("test", "x"), user_id="u").apply(df)) == ["d"]
    assert ids(SearchFilters(conflict_status="").apply(df)) == ["a", "e"]
    for at, seen in ((NOW - timedelta(hours=1), False), (NOW, True), (NOW + timedelta(days=1), False)):
        assert ("c" in ids(SearchFilters(as_of=at).apply(df))) is seen
    assert ids(keyset_page(df, SearchFilters(), 2, "a")) == ["d", "e"] and ids(keyset_page(df, SearchFilters(), 2, "zz")) == []
    assert parse_filters(tags=" a, ,b ").tags == ("a", "b")
    with pytest.raises(ValueError):
        parse_filters(kind="nonsense")
    with pytest.raises(ValueError):
        checked_threshold(0)


def test_one_live_version_at_any_time(spark):
    rows = [{"id": str(i), "valid_from": NOW + timedelta(days=i), "valid_to": NOW + timedelta(days=i + 1) if i < 3 else None} for i in range(4)]
    df = table(spark, *rows)
    for hours in range(0, 120, 12):
        assert len(ids(SearchFilters(as_of=NOW + timedelta(hours=hours)).apply(df))) == 1


def test_search(spark):
    df = table(spark, {"id": "a", "embedding": [1.0, 0.0]}, {"id": "b", "embedding": [0.9, 0.1]}, {"id": "c", "embedding": [0.0, 1.0], "type": "rule"}, {"id": "d"})
    assert [r["id"] for r in knn(df, [1.0, 0.0], 2).collect()] == ["a", "b"]
    assert [r["id"] for r in knn(df, [1.0, 0.0], 2, SearchFilters(type="rule")).collect()] == ["c"]
    assert [r["id"] for r in knn(df, [1.0, 0.0], 2, SearchFilters(type="rule"), post_filter=True).collect()] == []
    assert [r["id"] for r in find_duplicates(df, [1.0, 0.0], 0.92).collect()] == ["a", "b"]
    got = [(r["a"], r["b"]) for r in similar_pairs(df, 0.92, 3).collect()]
    assert got == [("a", "b")]


def test_versions(spark):
    df = table(spark, {"id": "new", "supersedes_id": "mid"}, {"id": "mid", "supersedes_id": "old"}, {"id": "old"}, {"id": "x", "supersedes_id": "gone"}, {"id": "p", "supersedes_id": "q"}, {"id": "q", "supersedes_id": "p"})
    assert [r["id"] for r in versions.chain_of(df, "new").collect()] == ["new", "mid", "old"]
    assert [r["id"] for r in versions.chain_of(df, "x").collect()] == ["x"] and len(versions.chain_of(df, "p").collect()) == 2
    assert versions.chain_of(df, "nowhere").count() == 0
    got = sorted((r["head"], r["depth"], r["id"]) for r in versions.chains(df).collect())
    assert got == [("new", 0, "new"), ("new", 1, "mid"), ("new", 2, "old"), ("x", 0, "x")]
    assert ids(versions.invalidate(df, ["old", "unknown"], NOW).where("valid_to is not null")) == ["old"]
    changed = versions.patch(df, spark.createDataFrame([("old", "other content")], "id string, content string")).where("content_changed").collect()
    assert [r["content"] for r in changed] == ["other content"]
    assert versions.backfill_validity(df).where("valid_from is null").count() == 0


def test_lifecycle(spark):
    hour = timedelta(hours=1)
    df = table(
        spark,
        {"id": "ttl", "scope": "ttl", "ttl_seconds": 3599, "created_at": NOW - hour},
        {"id": "edge", "scope": "ttl", "ttl_seconds": 3600, "created_at": NOW - hour},
        {"id": "idle", "scope": "session", "last_accessed": NOW - 25 * hour},
        {"id": "busy", "scope": "session", "last_accessed": NOW - 24 * hour},
        {"id": "late", "valid_until": NOW - hour},
        {"id": "c1", "conflict_group_id": "g", "conflict_status": "active"},
        {"id": "c2", "conflict_group_id": "g", "conflict_status": "active"},
        {"id": "c3", "conflict_group_id": "h", "conflict_status": "active"},
        {"id": "c4", "conflict_group_id": "h", "conflict_status": "active", "valid_until": NOW - hour},
        {"id": "secret", "visibility": "sensitive", "valid_until": NOW - hour},
    )
    got = {r["id"]: r["lifecycle_action"] for r in lifecycle.run_lifecycle(df, NOW).collect() if r["lifecycle_action"]}
    assert got == {"ttl": "expired", "idle": "decayed", "late": "retired", "c4": "retired", "c1": "resolved", "c2": "resolved"}
    assert lifecycle.lifecycle_report(df, NOW).first().asDict() == {"expired": 1, "decayed": 1, "retired": 2, "conflicts": 1}


def test_consolidation(spark):
    rows = [("a", [1.0, 0.0], 0.5), ("b", [1.0, 0.01], 0.9), ("c", [1.0, 0.02], 0.4), ("d", [0.0, 1.0], 0.1), ("e", [0.01, 1.0], 0.1)]
    df = table(spark, *[{"id": i, "embedding": e, "confidence": c, "created_at": NOW - timedelta(hours=n)} for n, (i, e, c) in enumerate(rows)])
    gone = ids(lifecycle.consolidate(df))
    assert gone == ["a", "c", "e"]  # b is more confident than a and then takes c; of equals the newer stays
    left = df.where(~F.col("id").isin(gone))
    assert ids(lifecycle.consolidate(left)) == []


def test_writes(spark):
    df = table(spark, {"id": "a", "embedding": [1.0]}, {"id": "b"})
    new = table(spark, {"id": "a", "content": "first"}, {"id": "a", "content": "second", "supersedes_id": "b"}).withColumn("seq", F.when(F.col("content") == "second", 2).otherwise(1))
    got = {r["id"]: r for r in writes.upsert(df, new, NOW).collect()}
    assert got["a"]["content"] == "second" and got["a"]["embedding"] == [1.0] and got["a"]["valid_from"] == NOW and got["b"]["valid_to"] == NOW
    inc = spark.createDataFrame([("n1", "much longer content"), ("n2", "x"), ("n3", "y")], "id string, content string")
    best = spark.createDataFrame([("n1", "a", "short", 0.95), ("n2", "a", "short", 0.92), ("n3", "a", "short", 0.91)], "id string, existing_id string, existing_content string, score double")
    assert {r["id"]: r["status"] for r in writes.dedup_decision(inc, best).collect()} == {"n1": "updated", "n2": "duplicate", "n3": "created"}
    scores = spark.createDataFrame([(0.95,), (0.94,), (0.8,), (0.79,), (None,)], "s double")
    assert [r[0] for r in scores.select(writes.capture_decision(F.col("s"))).collect()] == ["duplicate", "reinforce", "reinforce", "store", "store"]
    hits = spark.createDataFrame([("a",), ("a",), ("a",)], "id string")
    row = writes.reinforced(df, hits, NOW).where("id = 'a'").first()
    assert row["confidence"] == 1.0 and row["reinforced_count"] == 3 and row["reinforced_at"] == NOW
    tagged = writes.tag_conflicts(df, spark.createDataFrame([("a", "b", "g1")], "a string, b string, group_id string"))
    assert {(r["id"], r["conflict_group_id"], r["conflict_status"]) for r in tagged.collect()} == {("a", "g1", "active"), ("b", "g1", "active")}
    with pytest.raises(LookupError):
        writes.delete_prefix(df, "z")
    assert ids(writes.delete_prefix(df, "a")) == ["b"] and writes.delete_all(df).count() == 0
    assert writes.schema_violations(df.unionByName(df), spark.createDataFrame([("n",)], "name string")).count() == 2


def test_contradictions(spark):
    new = spark.createDataFrame([("n", "Alice works at Initech")], "id string, content string")
    near = spark.createDataFrame([("n", "c1", "Alice works at Globex", 0.9), ("n", "c2", "Alice joined Hooli", 0.78), ("n", "c3", "Alice likes tea", 0.9), ("n", "c4", "Bob works at X", 0.7)], "id string, candidate_id string, candidate_content string, score double")
    linked = spark.createDataFrame([("n", "c5", "She was employed by Y"), ("n", "c1", "again works at")], "id string, candidate_id string, candidate_content string")
    got = {r["candidate_id"]: (r["score"], r["stage"]) for r in writes.contradictions(new, near, linked).collect()}
    assert got == {"c1": (0.9, "auto"), "c2": (0.78, "keyword"), "c5": (0.75, "keyword")}
    sure = writes.contradictions(new, near, None, F.contains("candidate_content", F.lit("Hooli"))).collect()
    assert {r["candidate_id"] for r in sure} == {"c1", "c2"}
    df = spark.createDataFrame([("He works at Initech", "works_at", "Alice works at Globex Corporation"), ("Alice works at Globex Corporation", "works_at", "Alice works at Globex Corporation"), ("no signal", "works_at", "x")], "t string, r string, f string")
    assert [r[0] for r in df.select(writes.fact_conflict(F.col("t"), F.col("r"), F.col("f"))).collect()] == [True, False, False]


def fact(**over):
    row = {f.name: None for f in FACT} | {"relation_type": "KNOWS", "fact": "f", "source_memory_ids": []}
    return tuple((row | over)[f.name] for f in FACT)


def edges(spark, *rows):
    return spark.createDataFrame([fact(id=i, source_entity_id=a, target_entity_id=b, source_memory_ids=m, expired_at=e) for i, a, b, m, e in rows], FACT)


def test_graph(spark):
    facts = edges(spark, ("f1", "A", "B", ["m1"], None), ("f2", "C", "B", ["m2", "m1"], None), ("f3", "C", "D", ["m3"], None), ("f4", "A", "D", ["m4"], NOW))
    seed = spark.createDataFrame([("A",)], "entity_id string")
    assert {(r["memory_id"], r["hops"]) for r in graph.memories_within(facts, seed).collect()} == {("m1", 1), ("m2", 2)}
    assert {r["memory_id"] for r in graph.memories_within(facts, seed, 3).collect()} == {"m1", "m2", "m3"}
    assert [(r["id"], r["rank"]) for r in graph.graph_ranks(facts, seed, 5).collect()] == [("m1", 1), ("m2", 2)]
    paths = graph.subgraph(facts, "A", 3).collect()
    assert [(r["dist"], r["entity_id"]) for r in paths] == [(1, "B"), (2, "C"), (3, "D")]
    assert ids(graph.facts_between(facts, "D", "A")) == [] and ids(graph.facts_between(facts, "B", "A")) == ["f1"]
    assert ids(graph.facts_for_entity(facts, "C")) == ["f2", "f3"] and ids(graph.facts_of_memory(facts, "m4")) == ["f4"]
    two = edges(spark, ("1", "A", "B", [], None), ("2", "B", "C", [], None), ("3", "X", "Y", [], None), ("4", "C", "X", [], NOW))
    assert {(r["entity_id"], r["community"]) for r in graph.communities(two).collect()} == {("A", "A"), ("B", "A"), ("C", "A"), ("X", "X"), ("Y", "X")}
    twice = graph.append_unique(graph.append_unique(facts, "source_memory_ids", "f1", "m9"), "source_memory_ids", "f1", "m9")
    assert twice.where("id = 'f1'").first()["source_memory_ids"] == ["m1", "m9"]
    known = spark.createDataFrame([("e", ["m1"])], "id string, memory_ids array<string>")
    assert graph.link_memory(known, "e", "m2").first()["memory_ids"] == ["m1", "m2"]
    with pytest.raises(LookupError):
        graph.link_memory(known, "nobody", "m2")
    assert graph.invalidate_fact(facts, "f1", NOW, NOW).where("expired_at is not null").count() == 2


def test_chain_communities(spark):
    n = 40
    facts = edges(spark, *[(str(i), f"n{i:03d}", f"n{i + 1:03d}", [], None) for i in range(n)])
    assert {r["community"] for r in graph.communities(facts).collect()} == {"n000"}


def test_resolution(spark):
    known = spark.createDataFrame([("e1", "Alice", ["Al"], [1.0, 0.0]), ("e2", "Bob Smith", [], [0.0, 1.0])], "id string, name string, aliases array<string>, name_embedding array<float>")
    new = spark.createDataFrame([("1", " ALICE", [], None), ("2", "al", [], None), ("3", "Bob", [], [0.01, 1.0]), ("4", "Zed", [], None), ("5", "Robert", ["bob smith"], None)], "id string, name string, aliases array<string>, embedding array<float>")
    got = {r["id"]: (r["entity_id"], r["how"]) for r in graph.resolve_entities(new, known).collect()}
    assert got == {"1": ("e1", "name"), "2": ("e1", "alias"), "3": ("e2", "embedding"), "4": (None, "new"), "5": ("e2", "alias")}
    facts = edges(spark, ("f1", "A", "B", [], None))
    fresh = edges(spark, ("n1", "A", "B", [], None), ("n2", "A", "C", [], None), ("n3", "B", "C", [], None))
    verdicts = spark.createDataFrame([("n2", "f1", "duplicate"), ("n2", "f1", "contradicted")], "id string, existing_id string, kind string")
    got = {r["id"]: r["action"] for r in graph.resolve_facts(fresh, facts, verdicts).collect()}
    assert got == {"n1": "skip", "n2": "invalidate", "n3": "insert"}
    raw = spark.createDataFrame([("alice", "bob smith"), ("alice", "Alice"), ("alice", "who")], "source_name string, target_name string")
    assert graph.valid_facts(raw, known).count() == 1


def test_stats(spark):
    df = table(spark, {"id": "a", "reinforced_count": 3, "access_count": 9, "content": "é" * 60}, {"id": "b", "reinforced_count": 11, "embedding": [1.0]})
    assert {r["tier"]: r["n"] for r in stats.tiers(df).collect()} == {"0": 0, "1-3": 1, "4-10": 0, "10+": 1}
    assert stats.top_accessed(df, 1).first()["preview"] == "é" * 40
    row = stats.summary(df, NOW).first()
    assert (row["total"], row["without_embedding"], row["storage_bytes"]) == (2, 1, 2 * 768 * 4)


def entry(**over):
    return tuple(({f.name: None for f in WAL} | {"attempts": 0, "content": "c"} | over)[f.name] for f in WAL)


def log(spark):
    at = lambda h: NOW + timedelta(hours=h)
    rows = [("a", "pending", at(0)), ("a", "processing", at(2)), ("a", "done", at(1)), ("b", "pending", at(0)), ("b", "done", at(3)), ("c", "failed", at(1)), ("d", "pending", at(5)), ("d", "processing", at(5))]
    df = spark.createDataFrame([entry(id=i, state=s, updated_at=t) for i, s, t in rows], WAL)
    return df.withColumn("seq", F.monotonically_increasing_id())


def test_wal(spark):
    df = log(spark)
    assert {(r["id"], r["state"]) for r in wal.latest(df).collect()} == {("a", "processing"), ("b", "done"), ("c", "failed"), ("d", "pending")}
    assert ids(wal.replay(df)) == ["a", "d"] and ids(wal.compact(df)) == ["a", "c", "d"]
    assert wal.status(df).first().asDict() == {"pending": 2, "failed": 1}
    work = wal.replay(df).withColumn("attempts", F.when(F.col("id") == "a", 2).otherwise(0)).withColumn("ok", F.lit(False))
    assert {(r["id"], r["state"]) for r in wal.after_attempt(work).collect()} == {("a", "failed"), ("d", "pending")}
    dead = wal.tombstones(wal.replay(df), "done", NOW).first()
    assert dead["state"] == "done" and dead["content"] is None


def test_wal_stream(spark, tmp_path):
    log(spark).select("id", "seq", "state", "updated_at").write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema("id string, seq long, state string, updated_at timestamp").parquet(str(tmp_path / "log"))
    q = wal.stream_latest(source).writeStream.outputMode("update").format("memory").queryName("latest_states").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["id"]: r["state"] for r in spark.sql("select * from latest_states").collect()}
    assert got == {"a": "processing", "b": "done", "c": "failed", "d": "pending"}


def test_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"role":"human","message":{"content":"hi"}}\nbroken\n\n{"message":{"role":"assistant","content":"yo"}}\n')
    got = files.read_transcript(spark, str(tmp_path / "t.jsonl")).orderBy("line").collect()
    assert [(r["role"], r["content"]) for r in got] == [("user", "hi"), ("assistant", "yo")]
    (tmp_path / "m.json").write_text(json.dumps([{"id": "1", "content": "x", "tags": ["a"]}, {"id": "2"}]))
    assert ids(files.read_memories(spark, str(tmp_path / "m.json"), array=True)) == ["1", "2"]
    conv = {"c1": {"session_10": [{"speaker": "a", "text": "third"}], "session_2": [{"speaker": "b", "text": "last"}], "session_1": [{"speaker": "a", "text": "first"}], "question_answer_pairs": [{"question": "q", "answer": "a", "category": "Multi-hop"}]}}
    (tmp_path / "l.json").write_text(json.dumps(conv))
    row = files.locomo(spark, str(tmp_path / "l.json")).first()
    assert [t["text"] for t in row["turns"]] == ["first", "third", "last"] and row["category"] == "multi-hop"
    (tmp_path / "e.json").write_text(json.dumps([{"question_id": "q1", "question_type": "multihop", "question": "?", "answer": "!", "haystack_sessions": [[{"role": "user", "content": "a"}], [{"role": "assistant", "content": "b"}]]}]))
    row = files.longmemeval(spark, str(tmp_path / "e.json")).first()
    assert row["facts"] == ["user: a", "assistant: b"] and row["category"] == "multi-hop"
    (tmp_path / "d.json").write_text(json.dumps([{"id": "1", "turns": [{"role": "u", "text": "x"}], "query": "q", "expected_answer": "e", "hop_count": 2}]))
    row = files.dmr(spark, str(tmp_path / "d.json")).first()
    assert (row["question"], row["answer"], row["category"], row["turns"][0]["content"]) == ("q", "e", "2-hop", "x")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# T\nbody")
    (tmp_path / "docs" / "b.txt").write_text("no")
    assert files.read_markdown(spark, str(tmp_path / "docs")).count() == 1
    batch = spark.createDataFrame([("long enough text", "", "", None, 0.0), ("short", "fact", "ttl", None, 0.5), ("long enough text", "odd", "", None, 0.5)], "content string, type string, scope string, tags array<string>, confidence double")
    assert [(r["type"], r["confidence"], r["error"]) for r in files.validate_batch(batch).collect()] == [("fact", 0.9, None), ("fact", 0.5, "content is too short"), ("odd", 0.5, "unknown type")]
    llm = spark.createDataFrame([('[{"type":"fact","content":"x"}]',), ('{"memories":[{"content":"y"}]}',)], "t string")
    assert [r[0][0]["content"] for r in llm.select(files.parse_llm_memories(F.col("t"))).collect()] == ["x", "y"]


def test_batch_dedup_sees_earlier_rows(spark):
    stored = table(spark, {"id": "s1", "embedding": [1.0, 0.0, 0.0], "content": "short"})
    rows = [("a", [0.0, 1.0, 0.0], "a new record"), ("b", [0.0, 1.0, 0.05], "b"), ("c", [0.0, 1.0, 0.01], "c is longer than the first"), ("d", [1.0, 0.05, 0.0], "x"), ("e", [0.0, 0.0, 1.0], "alone")]
    new = table(spark, *[{"id": i, "embedding": e, "content": c} for i, e, c in rows])
    got = {r["id"]: (r["status"], r["existing_id"]) for r in writes.batch_dedup(new.withColumn("seq", F.col("id")), stored).collect()}
    assert got == {"a": ("created", None), "b": ("duplicate", "a"), "c": ("updated", "a"), "d": ("duplicate", "s1"), "e": ("created", None)}


def test_rebuild_and_counters(spark):
    df = table(spark, {"id": "a"}, {"id": "b"})
    assert wal.enqueue_all(df, NOW).where("state = 'pending'").count() == 2
    rows, seen = stats.observed(df, "rows seen")
    rows.collect()
    assert seen.get["rows"] == 2


def test_times():
    from mnemolith.functions.times import parse_duration, parse_time

    assert parse_duration("1d12h") == timedelta(days=1, hours=12) and parse_duration("-1.5m") == timedelta(seconds=-90) and parse_duration("0") == timedelta(0)
    for bad in ("", "5", "h", "1x", "1h 2m"):
        with pytest.raises(ValueError):
            parse_duration(bad)
    assert parse_time("2024-01-05", NOW, end_of_day=True) == datetime(2024, 1, 5, 23, 59, 59)
    assert parse_time("2024-01-05T02:00:00+02:00", NOW) == datetime(2024, 1, 5) and parse_time("2d", NOW) == NOW - timedelta(days=2)
    with pytest.raises(ValueError):
        parse_time("-2d", NOW)


def test_contradictions_by_facts_and_entities(spark):
    """The hub names every memory; each new memory takes the newest two that it can contradict, and the judge sees only what is open."""
    day = lambda n: datetime(2024, 1, n)
    memories = table(spark, *[{"id": f"m{i}", "content": f"text {i}", "created_at": day(i + 1)} for i in range(9)], {"id": "n", "created_at": day(20), "content": "Bo moved to Oslo"})
    told = [(f"f{i}", "bo", "hub", "LIVES_IN" if i != 7 else "KNOWS", "Bo lives in Paris", [f"m{i}"], day(2) if i == 8 else None) for i in range(9)]
    facts = spark.createDataFrame([fact(id=i, source_entity_id=a, target_entity_id=b, relation_type=r, fact=f, source_memory_ids=m, expired_at=e) for i, a, b, r, f, m, e in told], FACT)
    new = spark.createDataFrame([("n", "Bo moved to Oslo"), ("p", "Bo lives in Paris"), ("q", "nothing"), ("r", None)], "id string, content string")
    near = spark.createDataFrame([("n", "m0", 0.9), ("n", "m1", 0.8), ("n", "m2", 0.7), ("p", "m0", 0.9), ("q", "m0", 0.9), ("r", "m0", 0.9)], "id string, candidate_id string, score double")
    got = {(r["id"], r["candidate_id"]): (r["score"], r["stage"]) for r in contradiction.find_contradictions(new, near, memories, facts, most_linked=2).collect()}
    # m7 has no fact of a place, m8's fact has expired, so m6 and m5 are the newest.
    assert got == {("n", "m0"): (0.9, "auto"), ("n", "m1"): (0.8, "heuristic"), ("n", "m6"): (0.75, "heuristic"), ("n", "m5"): (0.75, "heuristic")}
    asked = []

    def judge(pairs):
        asked.extend(sorted(r["candidate_id"] for r in pairs.collect()))
        return pairs.where("candidate_content = 'text 6'")

    found = contradiction.find_contradictions(new, near, memories, facts, judge, most_linked=2)
    assert {(r["candidate_id"], r["stage"]) for r in found.collect()} == {("m0", "auto"), ("m6", "confirmed")} and asked == ["m1", "m5", "m6"]
    after, left = contradiction.invalidate_contradicted(memories, facts.withColumn("source_memory_ids", F.when(F.col("id") == "f6", F.array(F.lit("m6"), F.lit("m4"))).otherwise(F.col("source_memory_ids"))), found, day(28))
    assert sorted(r["id"] for r in after.where("valid_to is not null").collect()) == ["m0", "m6"]
    assert sorted(r["id"] for r in left.where(F.col("expired_at") == F.lit(day(28))).collect()) == ["f0"]


def test_linked_by_entity_takes_the_newest(spark):
    day = lambda n: datetime(2024, 1, n)
    memories = table(spark, *[{"id": f"m{i}", "created_at": day(i + 1)} for i in range(6)])
    facts = edges(spark, *[(f"f{i}", "hub", f"e{i}", [f"m{i}"], None) for i in range(6)], ("g", "e0", "x", ["m0", "gone"], None), ("h", "hub", "y", ["m5"], day(3)))
    got = {(r["id"], r["rank"]): r["candidate_id"] for r in graph.linked_by_entity(memories, facts, 2).collect()}
    assert got == {(f"m{i}", n + 1): c for i in range(6) for n, c in enumerate([f"m{k}" for k in range(5, -1, -1) if k != i][:2])}


def test_a_memory_of_many_entities_takes_few_of_their_rows(spark):
    """Thirty hubs with a newest memory each, all of which name m0: the newest list alone has enough for it."""
    start = datetime(2024, 1, 1)
    memories = table(spark, {"id": "m0", "created_at": start}, *[{"id": f"m{h}-{i}", "created_at": start + timedelta(hours=10 * h + i + 1)} for h in range(30) for i in range(3)])
    facts = edges(spark, *[(f"f{h}-{m}", f"hub{h}", f"x{h}-{m}", [m], None) for h in range(30) for m in ("m0", *(f"m{h}-{i}" for i in range(3)))])
    taken = []
    plain = graph._new_enough
    graph._new_enough = lambda *a: taken.append(plain(*a)) or taken[0]
    try:
        got = [(r["candidate_id"], r["rank"]) for r in graph.linked_by_entity(memories, facts, 2).where("id = 'm0'").collect()]
    finally:
        graph._new_enough = plain
    assert sorted(got, key=lambda r: r[1]) == [("m29-2", 1), ("m29-1", 2)]
    assert taken[0].where("id = 'm0'").count() == 3  # not three for each hub


def test_texts_are_lowered_once(spark, monkeypatch):
    """The condition on signals was pushed below the dealing out of the texts, where it lowered each text for every phrase."""
    plans, cut = [], contradiction.cut_off
    monkeypatch.setattr(contradiction, "cut_off", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    new = spark.createDataFrame([("n1", "She works at Initech")], "id string, content string")
    near = spark.createDataFrame([], "id string, candidate_id string, score double")
    memories = spark.createDataFrame([("m1", "Old", datetime(2024, 1, 1))], "id string, content string, created_at timestamp")
    facts = spark.createDataFrame([], "id string, source_entity_id string, target_entity_id string, relation_type string, fact string, expired_at timestamp, source_memory_ids array<string>")
    contradiction.find_contradictions(new, near, memories, facts)
    assert plans[0].count("lower(") == 1
