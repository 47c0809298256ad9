"""Segments under a manifest, capture batch by batch, and embedding with backfill."""

from __future__ import annotations

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from mnemolith.operators import embedding
from mnemolith.plans.stores import letter_model
from mnemolith.schema import MEMORY
from mnemolith.streaming import capture
from mnemolith.streaming.segments import SegmentLog


def numbers(spark, *ns):
    return spark.createDataFrame([(n,) for n in ns], "n long").coalesce(1)


def held(log, version=None):
    return sorted(r["n"] for r in log.read(version).collect())


def test_readers_see_a_version_whole(spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path / "log"), "n long")
    assert held(log) == [] and log.version().number == 0 and not log.compact(lambda rows: rows)
    assert log.append(numbers(spark, 1, 2), "a") and log.append(numbers(spark, 3), "b")
    assert not log.append(numbers(spark, 9), "a") and held(log) == [1, 2, 3]
    before, reading = log.version(), log.read()

    def keep(rows):
        # While the compaction works, a reader sees the old version, and an append goes through.
        assert held(log) == [1, 2, 3]
        SegmentLog(spark, log.path, "n long").append(numbers(spark, 4), "c")
        assert held(log) == [1, 2, 3, 4]
        return rows.where("n <> 2")

    assert log.compact(keep)
    assert held(log) == [1, 3, 4] and len(log.version().segments) == 2 and log.version().batches == ("a", "b", "c")
    # Who began with the old version can end with it.
    assert sorted(r["n"] for r in reading.collect()) == [1, 2, 3] and held(log, before) == [1, 2, 3]
    assert log.sweep() == 2 and held(log) == [1, 3, 4]


def test_a_writer_that_died_leaves_nothing_to_read(spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path / "log"), "n long")
    log.append(numbers(spark, 1), 1)
    log._write(numbers(spark, 5))  # a segment without a manifest
    assert held(log) == [1]
    assert log.append(numbers(spark, 5), 2) and held(log) == [1, 5] and log.sweep() == 1


def test_a_compaction_that_was_overtaken_changes_nothing(spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path / "log"), "n long")
    log.append(numbers(spark, 1))
    log.append(numbers(spark, 2))
    other = SegmentLog(spark, log.path, "n long")
    assert not log.compact(lambda rows: other.compact(lambda r: r) and rows.where("n = 1"))
    assert held(log) == [1, 2]


def batch(spark, *rows):
    return spark.createDataFrame(rows, "id string, seq long, content string, embedding array<double>")


def test_capture_batches(spark, tmp_path):
    store = SegmentLog(spark, str(tmp_path / "store"), capture.STORE)
    run = capture.capture_into(store, 0.9)
    first = batch(spark, ("a", 1, "short", [1.0, 0.0]), ("b", 2, "a longer text", [0.99, 0.01]), ("c", 3, "other", [0.0, 1.0]), ("d", 4, None, None))
    run(first, 0)
    got = lambda: {r["id"]: (r["content"], r["reinforced"]) for r in capture.records(store.read()).collect()}
    # b came after a in the same batch and is longer, so it has a's place.
    assert got() == {"a": ("a longer text", 1), "c": ("other", 0), "d": ("", 0)}
    run(first, 0)
    assert got() == {"a": ("a longer text", 1), "c": ("other", 0), "d": ("", 0)}
    run(batch(spark, ("e", 5, "x", [1.0, 0.02]), ("f", 6, "other, longer", [0.05, 1.0]), ("g", 7, "y", [0.0, 1.0])), 1)
    want = {"a": ("a longer text", 2), "c": ("other, longer", 2), "d": ("", 0)}
    assert got() == want
    capture.compact_records(store)
    assert got() == want and len(store.version().segments) == 1
    run(first, 0)
    assert got() == want


def test_capture_as_a_stream_run_twice(spark, tmp_path):
    from mnemolith.streaming.wal import capture_stream

    source, store = str(tmp_path / "in"), SegmentLog(spark, str(tmp_path / "store"), capture.STORE)
    batch(spark, ("a", 1, "one", [1.0, 0.0]), ("b", 2, "two longer", [1.0, 0.0])).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("id string, seq long, content string, embedding array<double>").parquet(source)
    # The second run has lost its checkpoint, so it delivers the first batch again.
    for checkpoint in ("one", "two"):
        capture_stream(stream(), capture.capture_into(store, 0.9), str(tmp_path / checkpoint)).awaitTermination()
    assert [(r["id"], r["content"], r["reinforced"]) for r in capture.records(store.read()).collect()] == [("a", "two longer", 1)]


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    blank = {f.name: None for f in MEMORY}
    rows = [tuple((blank | {"id": f"m{i}", "content": "é" * i if i % 5 else None, "embedding": [1.0] if i % 4 == 0 else [] if i % 4 == 1 else None})[f.name] for f in MEMORY) for i in range(40)]
    memories = spark.createDataFrame(rows, MEMORY)
    done = SegmentLog(spark, str(tmp_path / "done"), "id string, embedding array<double>")
    assert embedding.backfill(memories, letter_model, done, parts=4, dry_run=True) == 30 and done.version().number == 0
    calls = []
    real, done.append = done.append, lambda df, part: (calls.append(part), real(df, part))[1] if len(calls) < 2 else 1 / 0
    with pytest.raises(ZeroDivisionError):
        embedding.backfill(memories, letter_model, done, parts=4)
    again = SegmentLog(spark, done.path, "id string, embedding array<double>")
    assert len(again.version().batches) == 2 and embedding.backfill(memories, letter_model, again, parts=4) == 2 and embedding.backfill(memories, letter_model, again, parts=4) == 0
    after = embedding.with_backfilled(memories, again)
    assert embedding.to_embed(after).count() == 0 and after.columns == memories.columns
    want = {f"m{i}": [1.0] if i % 4 == 0 else letter_model()(["é" * i if i % 5 else ""])[0] for i in range(40)}
    assert {r["id"]: list(r["embedding"]) for r in after.select("id", "embedding").collect()} == want


def test_embedding_keeps_the_order_and_counts(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(30)], "n int, content string")
    sizes = lambda: lambda texts: [[float(len(t)), float(len(texts))] for t in texts]
    got = embedding.embed(rows.coalesce(1), sizes, batch_texts=7).collect()
    assert all(r["embedding"][0] == r["n"] for r in got) and {r["embedding"][1] for r in got} == {7.0, 2.0}
    with pytest.raises(PythonException, match="0 vectors"):
        embedding.embed(rows, lambda: lambda texts: []).select(F.sum(F.size("embedding"))).collect()
