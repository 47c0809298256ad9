"""Toxicity, quality, mixing and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemolith.llm import op5_toxicity as tox
from mnemolith.llm import op9_quality as qual
from mnemolith.llm import op10_mixing as mixing
from mnemolith.llm import labelled
from mnemolith.llm.op4_near_dedup import near_components

from .test_lines_and_copies import brute_components, brute_lines

MEDIUM = "/root/testdata/sf0.01"
CLASHES = ["score", "label", "target", "copies", "size", "part", "chunk", "share", "__note", "__id", "__key", "__copies", "__rows", "__copy", "repeat", "n"]


def frame(spark, rows, extra=CLASHES):
    df = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in extra})


def auc(y, s):
    rank = pd.Series(s).rank().to_numpy()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("query", "label", "folds", "held", "least"), [(tox.op5_toxicity, "toxic", 3, 1, 0.75), (qual.op9_quality, "quality", 4, 2, 0.98)])
def test_held_out(spark, query, label, folds, held, least):
    got = query(spark, MEDIUM).toPandas().set_index("doc_id")
    truth = pd.read_parquet(f"{MEDIUM}/labels.parquet").set_index("doc_id")[label]
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % folds == held for i in got.index]).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    both = got[got["held_out"]].join(truth, how="inner")
    assert auc(both[label].to_numpy(), both["score"].to_numpy()) > least
    assert (both["predicted"] == both[label]).mean() > 0.85
    again = query(spark, MEDIUM).toPandas().set_index("doc_id")
    assert (again["score"].sort_index() == got["score"].sort_index()).all()


def toy(spark):
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(50)}"
    rows, labels = [], []
    for i in range(240):
        text = [" ".join(word() for _ in range(8)) + "." for _ in range(6)]
        if i % 4 == 0:
            text[i // 4 % 6] = f"you {word()} horrible fool."
        rows.append((i, "\n".join(text), "s"))
        labels.append((i, int(i % 4 == 0), int(i % 4 == 0)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_training_takes_6000_rows_and_holds_them_on_the_executors(spark):
    """The same model as a plain loop over all of the sample, from a table and not from rows on the driver."""
    docs, labels = toy(spark)
    assert labelled.TRAINING_ROWS == 6000
    sample, stands_for = labelled.training_sample(docs, labels, "toxic", 3, 1)
    table = tox.sample_features(sample)
    rows = table.orderBy("doc_id", "features").collect()
    keys = tox.common_features(table)
    held = Counter(f for r in rows for f in set(np.frombuffer(r["features"], "<u4").tolist()))
    assert keys.tolist() == sorted(f for f, n in held.items() if n >= tox.LEAST_DOCS)
    whole = tox.Occurrences.of(rows, keys, {0: 0.25, 1: 0.5})
    parts = [tox.Occurrences.of(rows[i::3], keys, {0: 0.25, 1: 0.5}) for i in range(3)]
    w = np.linspace(-1, 1, len(keys))
    slope, bias_slope = whole.slopes(w, -0.3)
    assert np.allclose(slope, sum(p.slopes(w, -0.3)[0] for p in parts)) and np.isclose(bias_slope, sum(p.slopes(w, -0.3)[1] for p in parts))
    assert np.allclose(whole.mass(), sum(p.mass() for p in parts))
    one, again = (tox.NoisyOr.fit(t, stands_for) for t in (table, table.repartition(7)))
    assert one == again and one.weights


def test_toxic_sentences_are_found(spark):
    docs, labels = toy(spark)
    model = tox.train_toxicity(docs, labels)
    got = tox.score_toxicity(docs, model).toPandas().set_index("doc_id")
    assert all((got.loc[i, "score"] >= 0.7) == (i % 4 == 0) for i in range(240))
    assert all(got.loc[i, "worst_sentence"] == i // 4 % 6 for i in range(0, 240, 4))
    kept = tox.drop_toxic(docs, model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(240) if i % 4] and kept.columns == docs.columns
    assert tox.SentenceScores(model)("fine words. you horrible fool! more")[1:3] == (3, 1)


@pytest.mark.parametrize("module", [tox, qual])
def test_scores_of_odd_rows(spark, module):
    docs, labels = toy(spark)
    train, score = (tox.train_toxicity, tox.score_toxicity) if module is tox else (qual.train_quality, qual.score_quality)
    odd = frame(spark, [(1, None, None), (2, "", "s"), (None, "null id", "s"), (4, "x " * 30000, "s"), (4, "x " * 30000, "s"), (5, "\n . \n", "s")])
    for lab in (labels, labels.where("toxic = 0"), labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int")).withColumn("quality", F.lit(None).cast("int")), labels.unionByName(labels)):
        got = score(odd, train(docs, lab)).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
        assert got[0]["score"] == got[1]["score"]
    assert score(frame(spark, []), train(docs, labels)).count() == 0
    assert score(odd, train(docs.limit(0), labels)).count() == 6


def test_attention_gradients():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, qual.N_FEATURES)) for n in (1, 3, 5)]
    model = qual.GatedAttention.fit(bags, [0, 1, 0], {0: 1.0, 1: 1.0}, epochs=0)
    sizes = np.array([1, 3, 5])
    starts, x, y = np.cumsum(sizes) - sizes, np.concatenate(bags), np.array([0.0, 1.0, 0.0])
    loss = lambda: float(np.sum(np.logaddexp(0, (o := model.forward(x, starts, sizes)["out"])) - y * o))
    f = model.forward(x, starts, sizes)
    grad = model.backward(f, qual.sigmoid(f["out"]) - y, sizes, starts)
    for name, p in model.params.items():
        at = tuple(0 for _ in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-7)


def brute_targets(sizes, weights=(5, 2, 1)):
    """Raise the level slowly until the shares are used up."""
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        total = sum(min(2 * s, mid * weights[i % 3]) for i, s in enumerate(sizes))
        lo, hi = (mid, hi) if total < 1.5 * sum(sizes) else (lo, mid)
    return [min(2 * s, hi * weights[i % 3]) for i, s in enumerate(sizes)]


@pytest.mark.parametrize("sizes", [[100], [100, 100, 100], [10, 1000, 5, 0, 7], [0, 0, 9]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", s, 1) for i, s in enumerate(sizes)], "source string, size long, n long")
    got = [r["target"] for r in mixing.source_targets(rows).orderBy("part").collect()]
    assert got == pytest.approx(brute_targets(sizes), rel=1e-6, abs=1e-6) and sum(got) == pytest.approx(1.5 * sum(sizes))


def test_many_sources(spark):
    """Sources are numbered over ranges, by code point with null last, and none of them goes through the driver."""
    names = [f"h{i * 7919 % 30011}" for i in range(30_000)] + ["", "Z", "é", "\U0001f600", "\uffff", None]
    rows = spark.createDataFrame([(s, i % 50, 1) for i, s in enumerate(names)], "source string, size long, n long")
    got = mixing.source_targets(rows).orderBy("part").collect()
    want = sorted(names, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    assert [r["source"] for r in got] == want and [r["part"] for r in got] == list(range(len(names)))
    assert [r["target"] for r in got] == pytest.approx(brute_targets([r["source_size"] for r in got]), rel=1e-6, abs=1e-6)


def test_repeats_of_a_row_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 100)
    largest = []
    rounding = mixing.dependent_rounding

    def watched(units, most_chunks):
        largest.append(units.groupBy("part", "chunk").count().agg(F.max("count")).first()[0])
        return rounding(units, most_chunks)

    monkeypatch.setattr(mixing, "dependent_rounding", watched)
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same row").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs)
    assert got.count() == 20_000 and largest[0] < 250
    assert got.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] == pytest.approx(1.5 * 60_000, abs=3)


def test_pivotal_keeps_words_and_expectations():
    rng = np.random.default_rng(0)
    size, share = np.array([5, 40, 7, 100, 3, 60]), np.array([0.3, 0.5, 0.9, 0.25, 0.5, 0.6])
    total, runs = np.zeros(6), 20000
    for _ in range(runs):
        x, held = mixing.pivotal(share, size, rng.random(6))
        assert (x @ size) == pytest.approx(share @ size)
        assert sum(0 < v < 1 for v in x) == (held >= 0)
        total += x
    assert total / runs == pytest.approx(share, abs=0.02)


def test_mixture(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["hot", "b", "c", None][0 if rng.random() < 0.4 else int(rng.integers(4))]) for i in range(6000)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).toPandas()
    assert len(got) == 6000 and (got["copies"] <= 2).all() and (got["copies"] >= 0).all()
    by = got.assign(taken=got["size"] * got["copies"], s=got["source"].fillna("~")).groupby("s").agg(taken=("taken", "sum"), size=("size", "sum"), target=("target", "first"), stated=("source_size", "first"))
    assert (by["size"] == by["stated"]).all() and (abs(by["taken"] - by["target"]) <= 60).all()
    assert by.loc[["b", "c", "hot", "~"], "target"].tolist() == pytest.approx(brute_targets(by.loc[["b", "c", "hot", "~"], "size"].tolist()))
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert got.set_index("doc_id")["copies"].sort_index().equals(again.set_index("doc_id")["copies"].sort_index())
    taken = mixing.take_mixture(docs)
    assert taken.columns == docs.columns
    n = taken.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert n.sort_index().to_dict() == got[got["copies"] > 0].set_index("doc_id")["copies"].sort_index().to_dict()


def test_mixture_edges(spark):
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.take_mixture(frame(spark, [])).count() == 0
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y z", "a"), (3, "x " * 30000, None), (4, "same row", "b"), (4, "same row", "b")]
    docs = frame(spark, rows)
    got = mixing.mix(docs).toPandas()
    assert len(got) == 6 and set(got["size"]) == {0, 2, 3, 30000}
    taken = mixing.take_mixture(docs)
    assert taken.count() == got["copies"].sum() and taken.columns == docs.columns
    assert {r["__id"] for r in taken.collect()} == {"own __id"}


def test_many_chunks_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 20)
    monkeypatch.setattr(mixing, "FANIN", 4)
    docs = frame(spark, [(i, "w " * (i % 17 + 1), "ab"[i % 2]) for i in range(1200)])
    got = mixing.mix(docs).toPandas()
    by = got.assign(taken=got["size"] * got["copies"]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert len(got) == 1200 and (abs(by["taken"] - by["target"]) <= 9).all()


def test_rows_and_tables_share_their_workers(spark):
    """Toxicity is trained on rows and scored on a table; workers of each kind, with what they hold, stayed beside those of the other."""

    def forks(batches):
        import os

        for _ in batches:
            yield pd.DataFrame({"of": [os.getppid()]})

    def fork(_):
        import os

        return os.getppid()

    of_tables = {r["of"] for r in spark.range(8).mapInPandas(forks, "of long").collect()}
    assert set(spark.sparkContext.parallelize(range(8)).map(fork).collect()) == of_tables and len(of_tables) == 1


def test_pipeline(spark, small):
    """Each stage on what its predecessor kept, against brute force."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, small)
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        at[name] = (before, docs)
        if name != "encoding":
            assert docs.columns == names
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    before, after = at["toxicity"]
    model = tox.train_toxicity(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    one = tox.SentenceScores(model)
    assert sorted(rows(after)) == sorted(r for r in rows(before) if one(r[1])[0] < tox.THRESHOLD)
    before, after = at["line_dedup"]
    lost = {i: {int(x) for x in d.split(",")} for i, (_, _, d) in brute_lines(rows(before)).items()}
    want = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in lost.get(i, ()))) for i, t in rows(before)]
    assert sorted(rows(after)) == sorted((i, t) for i, t in want if i not in lost or t.strip())
    before, after = at["near_dedup"]
    assert sorted(r["doc_id"] for r in after.collect()) == [i for i, _, _, kept in brute_components(rows(before), 80) if kept]
    before, after = at["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}
    before, after = at["encoding"]
    assert after.count() == before.count() and after.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.run(spark, small).count() == after.count()


def test_components_of_documents_match_the_kept_flag(spark, small):
    got = near_components(spark.read.parquet(f"{small}/documents.parquet")).toPandas()
    assert (got["kept"] == (got["doc_id"] == got["component_id"])).all()
