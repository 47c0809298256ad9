"""Queries without SQL against plain loops over the smallest tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolith.operators import graph
from mnemolith.operators.chunks import split_by_size
from mnemolith.plans import records
from mnemolith.schema import FACT
from mnemolith.sources import files
from mnemolith.sources import tables as T


@pytest.fixture(scope="module")
def memories(spark, small):
    rows = T.memories(spark, small).where("embedding is not null")
    return rows.select("id", "content", "confidence", "created_at", "scope", "visibility", "valid_to", "embedding").orderBy("id").collect()


def cosines(rows):
    m = np.array([r["embedding"] for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m @ m.T


def test_consolidate_greedy(spark, small, memories):
    mine = [r for r in memories if r["scope"] == "permanent" and r["visibility"] != "sensitive" and r["valid_to"] is None]
    mine.sort(key=lambda r: (-r["created_at"].timestamp(), r["id"]))
    alike, gone = cosines(mine) > 0.3, set()
    for i in range(len(mine)):
        for j in range(i + 1, len(mine)):
            if i not in gone and j not in gone and alike[i, j]:
                gone.add(j if (mine[i]["confidence"] or 0.0) >= (mine[j]["confidence"] or 0.0) else i)
    got = [r["id"] for r in records.consolidate_greedy(spark, small).collect()]
    assert gone and sorted(got) == sorted(mine[i]["id"] for i in gone)


def test_batch_dedup(spark, small, memories):
    score = cosines(memories)
    size = [len((r["content"] or "").encode()) for r in memories]
    holds, want = {}, {}
    for i, r in enumerate(memories):
        best = max(((score[i, at], -record, at) for record, at in holds.items()), default=None)
        if best is None or best[0] < 0.35:
            holds[i] = i
            want[str(r["id"])] = ("created", None)
        else:
            longer = size[i] > size[best[2]]
            want[str(r["id"])] = ("updated" if longer else "duplicate", str(memories[-best[1]]["id"]))
            if longer:
                holds[-best[1]] = i
    got = {r["id"]: (r["status"], r["existing_id"]) for r in records.batch_dedup(spark, small).collect()}
    assert want and got == want


def plain_pieces(text, most, overlap):
    if len(text.encode()) <= most:
        return [text]
    words, size = text.split(), lambda ws: sum(len(w.encode()) + 1 for w in ws)
    out, start, end = [], 0, 0
    while end < len(words):
        end += 1
        while end < len(words) and size(words[start : end + 1]) <= most:
            end += 1
        out.append(" ".join(words[start:end]))
        start = max([s for s in range(start, end + 1) if size(words[s:end]) >= overlap], default=start)
    return out


def test_chunk_split(spark, small):
    texts = {r["doc_id"]: r["text"] for r in T.read(spark, small, "documents").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["content"] for r in records.chunk_split(spark, small).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "content")))["content"].alias("content")).collect()}
    assert got == {k: plain_pieces(t or "", 512, 64) for k, t in texts.items()}


def test_split_by_size_edges():
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = " ".join("é" * int(k) for k in rng.integers(1, 12, rng.integers(0, 40)))
        most, overlap = int(rng.integers(1, 60)), int(rng.integers(0, 70))
        assert split_by_size(text, most, overlap) == plain_pieces(text, most, overlap)
    assert split_by_size("", 5, 1) == [""] and split_by_size("   \n   ", 5, 1) == []


def test_recall_without_seeds(spark):
    blank = {f.name: None for f in FACT}
    rows = [("f1", ["m2", "m1"]), ("f2", ["m3", "m2"])]
    facts = spark.createDataFrame([tuple((blank | {"id": i, "source_entity_id": "A", "target_entity_id": "B", "source_memory_ids": m})[f.name] for f in FACT) for i, m in rows], FACT)
    found = facts.withColumn("score", F.when(F.col("id") == "f2", 0.9).otherwise(0.5))
    ranked = lambda seeds: [r["id"] for r in graph.recall_ids(facts, seeds, found, 2).orderBy("rank").collect()]
    assert ranked(spark.createDataFrame([], "entity_id string")) == ["m3", "m2"]
    assert ranked(spark.createDataFrame([("A",)], "entity_id string")) == ["m1", "m2"]


def test_names_holding(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abÄ"), n))
    known = [(f"e{i}", word(int(rng.integers(0, 9)))) for i in range(60)]
    asked = [(str(i), word(int(rng.integers(0, 6)))) for i in range(40)] + [("none", None), ("twice", "ab"), ("twice", "ba")]
    k = spark.createDataFrame(known + [("blank", None)], "entity_id string, name string").withColumn("name_embedding", F.array(F.lit(1.0)))
    a = spark.createDataFrame(asked, "id string, name string").withColumn("embedding", F.array(F.lit(1.0)))
    got = sorted((r["id"], r["entity_id"]) for r in graph.names_holding(a, k).select("id", "entity_id").collect())
    assert got == sorted((i, e) for i, n in asked if n is not None for e, m in known if n.lower() in m.lower())


def test_csv_keeps_odd_texts(spark, small, tmp_path):
    """Empty texts are not null, and zero characters, quotes and line ends stay, over more than one of the reader's buffers."""
    odd = ["", None, " ", '"', '""', "a\0b", '"\0"', "\0\n,", "a\r\nb\r", "\\", '\\"', "x," * 600_000 + "\0\"\n"]
    rows = T.memories(spark, small).withColumn("content", F.element_at(F.array(*[F.lit(t) for t in odd]), (F.col("id") % len(odd) + 1).cast("int"))).withColumn("project", F.when(F.col("id") % 2 == 0, ""))
    files.write_csv(rows, str(tmp_path / "csv"))
    got = {r["id"]: (r["content"], r["project"]) for r in files.read_csv(spark, str(tmp_path / "csv")).collect()}
    assert got == {str(r["id"]): (r["content"], r["project"]) for r in files.csv_rows(rows).collect()}
