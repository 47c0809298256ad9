from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemolith.functions import scoring as S
from mnemolith.functions.vectors import cosine, cosine_to
from mnemolith.operators import ranking
from mnemolith.schema import Weights

NOW = datetime(2024, 2, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_factors(spark):
    assert value(spark, S.recency(F.lit(NOW - timedelta(hours=168)), NOW)) == pytest.approx(math.exp(-0.693))
    assert value(spark, S.recency(F.lit(None).cast("timestamp"), NOW)) == 0.1
    assert value(spark, S.recency(F.lit(NOW + timedelta(hours=5)), NOW)) == 1.0
    assert value(spark, S.frequency(F.lit(0))) == 0 and value(spark, S.frequency(F.lit(1023))) == 1.0
    assert value(spark, S.reinforcement(F.lit(3))) == pytest.approx(0.4)
    assert value(spark, S.type_boost(F.lit("rule"))) == 1.0 and value(spark, S.type_boost(F.lit("other"))) == pytest.approx(1 / 1.5)
    assert value(spark, S.scope_boost(F.lit("project"), F.lit("p"), "p")) == 1.0
    assert value(spark, S.scope_boost(F.lit("project"), F.lit("q"), "p")) == pytest.approx(0.8 / 1.5)
    assert value(spark, S.scope_boost(F.lit("ttl"), F.lit("q"), "")) == pytest.approx(1 / 1.5)
    assert value(spark, S.confidence(F.lit(0.0))) == 0.7 and value(spark, S.confidence(F.lit(0.3))) == 0.3
    assert value(spark, S.tag_affinity(F.array(F.lit("Go"), F.lit("error handling"), F.lit("x")), "go error  HANDLING")) == pytest.approx(2 / 3)
    assert [value(spark, S.graph_proximity(F.lit(h).cast("int"))) for h in (None, 1, 2, 3, 9)] == [0, 1, 0.5, 0.25, 0.25]


def test_weights():
    assert Weights(similarity=0.9).checked() == Weights() and Weights(similarity=-1).checked() == Weights()
    other = Weights(0.5, 0.1, 0.05, 0.1, 0.05, 0.1, 0.05, 0.05, 0.0)
    assert other.checked() is other


def results(spark, rows):
    base = "id string, score double, supersedes_id string, conflict_status string, conflict_group_id string"
    df = spark.createDataFrame(rows, base)
    fixed = dict(last_accessed=F.lit(NOW), access_count=F.lit(5), type=F.lit("fact"), scope=F.lit("permanent"), project=F.lit(""), confidence=F.lit(0.9), reinforced_count=F.lit(0), tags=F.array().cast("array<string>"), content=F.lit("some words here"))
    return df.withColumns(fixed)


def test_penalties_and_order(spark):
    rows = [("a", 0.85, "b", "", None), ("b", 0.85, "c", "active", "g"), ("c", 0.85, None, "resolved", "g")]
    got = {r["id"]: r for r in ranking.rank(results(spark, rows), "", NOW).collect()}
    assert (got["a"]["supersession_penalty"], got["b"]["supersession_penalty"], got["c"]["supersession_penalty"]) == (1.0, 0.3, 0.3)
    assert (got["a"]["conflict_penalty"], got["b"]["conflict_penalty"], got["c"]["conflict_penalty"]) == (1.0, 0.8, 1.0)
    w = Weights()
    total = w.similarity * 0.85 + w.recency + w.frequency * math.log2(6) / 10 + (w.type_boost + w.scope_boost) / 1.5 + w.confidence * 0.9
    assert got["a"]["final_score"] == pytest.approx(total) and got["b"]["final_score"] == pytest.approx(total * 0.24)


def test_proximity_beats_none(spark):
    hops = spark.createDataFrame([("far", 9), ("near", 1)], "id string, hops int")
    rows = [("near", 0.5, None, "", None), ("none", 0.5, None, "", None), ("far", 0.5, None, "", None)]
    assert [r["id"] for r in ranking.rank(results(spark, rows), "", NOW, proximity=hops).collect()] == ["near", "far", "none"]


def ranked(spark, ids):
    return spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id string, rank int")


def test_rrf(spark):
    merged = ranking.rrf_merge([ranked(spark, "ab"), ranked(spark, "bc"), ranked(spark, "ac")]).collect()
    assert [r["id"] for r in merged] == ["a", "b", "c"]
    assert [r["score"] for r in merged] == pytest.approx([2 / 61, 1 / 62 + 1 / 61, 2 / 62])
    assert len(ranking.rrf_merge([ranked(spark, "abc")], 2).collect()) == 2


@settings(max_examples=5, deadline=None)
@given(st.permutations([0, 1, 2]))
def test_rrf_ignores_the_order_of_lists(spark, order):
    lists = [ranked(spark, x) for x in ("abcd", "dbe", "ca")]
    want = [(r["id"], round(r["score"], 12)) for r in ranking.rrf_merge(lists).collect()]
    assert [(r["id"], round(r["score"], 12)) for r in ranking.rrf_merge([lists[i] for i in order]).collect()] == want


def test_blend_keeps_similarity(spark):
    v = spark.createDataFrame([("a", 1, 0.9), ("b", 2, 0.8)], "id string, rank int, score double")
    got = {r["id"]: (r["rrf"], r["similarity"]) for r in ranking.rrf_blend(v, ranked(spark, "bc")).collect()}
    assert got["a"] == (pytest.approx(0.6 / 61), 0.9) and got["b"] == (pytest.approx(0.6 / 62 + 0.4 / 61), 0.8) and got["c"] == (pytest.approx(0.4 / 62), None)


def test_hybrid_search_skips_broken_lists(spark):
    def broken(n):
        raise OSError("down")

    assert ranking.hybrid_search([broken, lambda n: ranked(spark, "ab")], 5).count() == 2
    with pytest.raises(RuntimeError):
        ranking.hybrid_search([broken], 5)


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(i, "word " * (i % 5 + 1)) for i in range(20)], "id int, content string")
    all_ids = [r["id"] for r in ranking.within_budget(df, 10**6, [F.col("id")]).orderBy("id").collect()]
    for budget in (0, 5, 17, 60):
        kept = [r["id"] for r in ranking.within_budget(df, budget, [F.col("id")]).orderBy("id").collect()]
        assert kept == all_ids[: len(kept)]
    row = ranking.format_list(df.withColumn("rank", F.col("id")).where("id < 2")).first()
    assert (row["text"], row["n"]) == ("word \n---\nword word ", 2)


def test_rerank(spark):
    df = spark.createDataFrame([(c, 1.0 - i / 100, i + 1) for i, c in enumerate("abcde")], "id string, final_score double, rank int")
    assert ranking.needs_rerank(df, 0.035).first()["needed"] and not ranking.needs_rerank(df, 0.02).first()["needed"]
    assert not ranking.needs_rerank(df.limit(3), 0.5).first()["needed"]
    order = spark.createDataFrame([(2, 0), (9, 1), (0, 2), (2, 3)], "position int, place int")
    assert "".join(r["id"] for r in ranking.apply_order(df, order, top=4).orderBy("rank").collect()) == "cabde"


def test_conflict_peers(spark):
    rows = [("aaaaaaaa1", 1.0, None, "active", "g"), ("bbbbbbbb2", 1.0, None, "active", "g"), ("short", 1.0, None, "active", "g"), ("cccccccc3", 1.0, None, "", None)]
    got = {r["id"]: r["peers"] for r in ranking.annotate_conflicts(results(spark, rows)).collect()}
    assert got == {"aaaaaaaa1": ["bbbbbbbb"], "bbbbbbbb2": ["aaaaaaaa"], "short": ["aaaaaaaa", "bbbbbbbb"], "cccccccc3": None}


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([3.0, 4.0], [-3.0, -4.0], -1.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    got = df.select(cosine(F.col("a"), F.col("b")).alias("x"), cosine(F.col("b"), F.col("a")).alias("y"), cosine_to(F.col("a"), b).alias("z")).first()
    assert got["x"] == pytest.approx(want) and got["y"] == got["x"] and got["z"] == pytest.approx(want)


def test_cosine_of_null(spark):
    assert spark.createDataFrame([(None,)], "a array<float>").select(cosine_to(F.col("a"), [1.0]).alias("z")).first()["z"] == 0.0
