"""Retrieval by shared words and evaluation runs against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolith.operators import retrieval
from mnemolith.operators.evaluation import summarise


def bag(text):
    stop = {"the", "and", "for", "that", "this", "with", "from", "have", "been", "they"}
    bare = (w.strip(".,;:\"'()") for w in (text or "").lower().split())
    return {w for w in bare if len(w.encode()) >= 4 and w not in stop}


def plain_most_shared(questions, documents, k):
    out = {}
    for s, q, text in questions:
        found = sorted((-len(bag(text) & bag(t)), d) for z, d, t in documents if z == s and bag(text) & bag(t))
        out |= {(q, d): (-n, i + 1) for i, (n, d) in enumerate(found[:k])}
    return out


@pytest.fixture(scope="module")
def texts():
    """Words of very different frequency, one in most documents; equal documents, blank ones, two stores."""
    rng = np.random.default_rng(9)
    shares = 1 / np.arange(1, 301)
    word = lambda n: " ".join(f"word{i}" for i in rng.choice(300, n, p=shares / shares.sum()))
    docs = [(i % 2, i, word(int(rng.integers(1, 40)))) for i in range(400)]
    docs += [(i % 2, 1000 + i, docs[8 + i % 2][2]) for i in range(30)] + [(0, 2000, None), (1, 2001, ""), (0, 2002, "a the . ,;")]
    asked = [(i % 2, f"q{i}", docs[i * 7][2] if i % 3 else word(12)) for i in range(40)] + [(0, "blank", ""), (0, "none", None), (1, "unheard", "neverseen words"), (0, "marks", "(WORD1), 'word2';")]
    return asked, docs


@pytest.mark.parametrize(("k", "room"), [(1, 20), (3, 20), (5, 0), (50, 2)])
def test_most_shared_is_exact(spark, texts, monkeypatch, k, room):
    monkeypatch.setattr(retrieval, "ROOM", room)
    asked, docs = texts
    q = spark.createDataFrame(asked, "scope int, question_id string, question string")
    d = spark.createDataFrame(docs, "scope int, doc_id long, content string")
    got = {(r["question_id"], r["doc_id"]): (r["shared"], r["rank"]) for r in retrieval.most_shared(q, d, k).collect()}
    assert got == plain_most_shared(asked, docs, k)


@pytest.mark.parametrize("k", [1, 3, 500])
def test_most_shared_by_blocks_is_exact(spark, texts, monkeypatch, k):
    monkeypatch.setattr(retrieval, "FEW_MEETINGS", 0)
    monkeypatch.setattr(retrieval, "BLOCK_SAID", 300)
    monkeypatch.setattr(retrieval, "BLOCK_ASKED", 120)
    asked, docs = texts
    q = spark.createDataFrame(asked, "scope int, question_id string, question string")
    d = spark.createDataFrame(docs, "scope int, doc_id long, content string")
    got = {(r["question_id"], r["doc_id"]): (r["shared"], r["rank"]) for r in retrieval.most_shared(q, d, k).collect()}
    assert got == plain_most_shared(asked, docs, k)


def test_what_shares_words_often_is_not_joined(spark):
    """300 questions and 5000 documents share 30 words each: 45 million meetings, of which joins make a row each."""
    common = " ".join(f"common{i}" for i in range(30))
    q = spark.range(300).selectExpr("0 as scope", "id as question_id", f"concat('{common} rare', id) as question")
    d = spark.range(5000).selectExpr("0 as scope", "id as doc_id", f"concat('{common} rare', id % 1000) as content")
    found = retrieval.most_shared(q, d, 3)
    assert {(r["question_id"], r["doc_id"], r["rank"]) for r in found.collect()} == {(i, i + 1000 * n, n + 1) for i in range(300) for n in range(3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan


def test_no_documents_or_questions(spark, texts):
    q = spark.createDataFrame(texts[0], "scope int, question_id string, question string")
    d = spark.createDataFrame(texts[1], "scope int, doc_id long, content string")
    assert retrieval.most_shared(q, d.limit(0), 3).collect() == [] and retrieval.most_shared(q.limit(0), d, 3).collect() == []


@pytest.fixture(scope="module")
def run(spark):
    pairs = spark.createDataFrame([(1, "q1", "where does Alice work", "globex", "1-hop"), (2, "q2", "where does Alice live", "oslo", ""), (3, "q3", "what", "nothing", "")], "pair_id int, question_id string, question string, ground_truth string, category string")
    turns = spark.createDataFrame([(1, 10, "user: Alice said where her work is: Globex"), (1, 11, "user: hello there"), (2, 20, "user: Alice went there"), (2, 21, "user: where they live now: Oslo, Alice said"), (3, 30, "user: where does Alice work, Initech")], "pair_id int, doc_id int, content string")
    return pairs, turns


def test_a_pair_sees_its_own_store_or_all(spark, run):
    own = {r["question_id"]: r for r in retrieval.evaluate(*run, 1).collect()}
    assert (own["q1"]["recalled_at_k"], own["q2"]["recalled_at_k"], own["q3"]["recalled_at_k"]) == (True, True, False)
    assert own["q3"]["f1_score"] == 0.0 and not any(r["failed"] for r in own.values())
    # The turn of another pair shares more words with the first question.
    shared = {r["question_id"]: r for r in retrieval.evaluate(*run, 1, accumulate=True).collect()}
    assert (shared["q1"]["recalled_at_k"], shared["q2"]["recalled_at_k"]) == (False, True)


def test_failed_questions_count_and_all_failed_ends_the_run(spark, run):
    def failing(ids):
        def recall(questions, stored, k):
            found = retrieval.recall_by_words(questions, stored, k).withColumn("error", F.lit(None).cast("string"))
            bad = questions.where(F.col("question_id").isin(ids)).select("question_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("content"), F.lit("timed out").alias("error"))
            return found.unionByName(bad)

        return recall

    rows = retrieval.evaluate(*run, 1, recall=failing(["q1"]))
    assert {r["question_id"]: (r["failed"], r["recalled_at_k"]) for r in rows.collect()} == {"q1": (True, False), "q2": (False, True), "q3": (False, False)}
    one = retrieval.summary(rows, 1, 1, False).first()
    assert (one["n"], one["recall_failures"], one["mode"]) == (3, 1, "per-pair-reset") and one["recall_at_k"] == summarise(rows, 1, 1).first()["recall_at_k"]
    with pytest.raises(retrieval.RecallFailed, match="all 3"):
        retrieval.evaluate(*run, 1, recall=failing(["q1", "q2", "q3"]))
    assert retrieval.evaluate(run[0].limit(0), run[1], 1).collect() == []
