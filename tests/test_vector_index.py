"""The vector index and the order-bound choices against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolith.operators import greedy, lifecycle, search, vector_index, writes
from mnemolith.operators.filters import SearchFilters
from mnemolith.operators.vector_index import build_index, ensure_index, neighbours, open_index
from mnemolith.schema import MEMORY
from mnemolith.session import cut_off


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors():
    """Clusters of three dimensions' worth of spread in 16, some equal vectors, a second length, and vectors without a direction."""
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.25, 16)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000 + i, [3 * x for x in rows[5][1]]) for i in range(3)]
    rows += [(3000 + i, rng.normal(0, 1, 3).tolist()) for i in range(30)]
    bad = [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [None] + [1.0] * 15), (4004, [float("nan")] * 16), (4005, [float("inf")] + [1.0] * 15)]
    return rows, bad


def frame(spark, vectors):
    return spark.createDataFrame([*vectors[0], *vectors[1]], "id long, embedding array<double>").repartition(4)


@pytest.fixture(scope="module")
def index(spark, vectors):
    return build_index(frame(spark, vectors))


def cosines(rows):
    """(ids, cosines), 0 between lengths."""
    ids = np.array([i for i, _ in rows])
    out = np.zeros((len(rows), len(rows)))
    for d in {len(v) for _, v in rows}:
        at = np.array([k for k, (_, v) in enumerate(rows) if len(v) == d])
        u = unit(np.array([rows[k][1] for k in at]))
        out[np.ix_(at, at)] = u @ u.T
    return ids, out


def brute_neighbours(rows, asked, k):
    ids, s = cosines(rows)
    size = np.array([len(v) for _, v in rows])
    out = {}
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        mine = np.flatnonzero(size == size[at])
        out[q] = sorted(mine.tolist(), key=lambda j: (-round(s[at, j], 12), ids[j]))[:k]
    return {q: [(int(ids[j]), round(s[int(np.flatnonzero(ids == q)[0]), j], 9)) for j in v] for q, v in out.items()}


def test_exact_neighbours(spark, vectors, index):
    rows, _ = vectors
    asked = [r[0] for r in rows if r[0] % 7 == 0]
    got: dict = {}
    for r in neighbours(index, frame(spark, vectors).where("id % 7 = 0"), 12, exact=True).collect():
        got.setdefault(r["id"], []).append((r["neighbour_id"], round(r["score"], 9)))
    want = brute_neighbours(rows, asked, 12)
    assert set(got) == set(want) and all(np.allclose(sorted(s for _, s in got[k]), sorted(s for _, s in want[k]), atol=1e-8) for k in want)
    assert {k: {i for i, _ in v} for k, v in got.items()} == {k: {i for i, _ in v} for k, v in want.items()}


def test_probing_has_its_recall_and_reads_fewer_lists(spark, vectors, index):
    rows, _ = vectors
    asked = [r[0] for r in rows if r[0] % 5 == 0]
    want = {(q, i) for q, v in brute_neighbours(rows, asked, 10).items() for i, _ in v}
    got = {(r["id"], r["neighbour_id"]) for r in neighbours(index, frame(spark, vectors).where("id % 5 = 0"), 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert index.probes < sum(len(x.numbers) for x in index.lists.values()) / 2 and index.meta["recall"] >= vector_index.RECALL


def test_pairs_of_all_rows(spark, vectors, index):
    rows, _ = vectors
    ids, s = cosines(rows)
    for threshold in (0.93, 0.4):
        i, j = np.nonzero((s > threshold) & (ids[:, None] < ids[None, :]))
        got = {(r["a"], r["b"]): r["score"] for r in vector_index.row_pairs_above(index, threshold).collect()}
        assert set(got) == set(zip(ids[i].tolist(), ids[j].tolist(), strict=True))
        assert all(abs(got[int(ids[a]), int(ids[b])] - s[a, b]) < 1e-9 for a, b in zip(i, j, strict=True))


@pytest.mark.parametrize("block_rows", [100, 5000])
def test_search_gives_the_same_by_index_and_by_product(spark, vectors, block_rows):
    rows, _ = vectors
    ids, s = cosines(rows)
    got = {(r["a"], r["b"]) for r in search.similar_pairs(frame(spark, vectors), 0.9, block_rows).collect()}
    i, j = np.nonzero((s > 0.9) & (ids[:, None] < ids[None, :]))
    assert got == set(zip(ids[i].tolist(), ids[j].tolist(), strict=True))
    best = {}
    for at, q in enumerate(ids.tolist()):
        before = [(-round(s[at, k], 9), int(ids[k])) for k in np.flatnonzero(ids < q)]
        if before and -min(before)[0] >= 0.5:
            best[q] = min(before)[1]
    assert {r["id"]: r["existing_id"] for r in search.nearest_before(frame(spark, vectors), 0.5, block_rows).collect()} == best


def test_blocks_that_cannot_reach_are_not_met(spark, vectors, index):
    """At a high threshold a vector asks few of the lists."""
    rows = [v for _, v in vectors[0] if len(v) == 16]
    lists = index.lists[16]
    asked = lists.reach(unit(np.array(rows)), np.full(len(rows), 0.92)).sum()
    assert asked < 0.6 * len(rows) * len(lists.numbers)


def test_an_index_is_checked_and_rebuilt(spark, vectors, tmp_path):
    path, rows = str(tmp_path / "index"), frame(spark, vectors)
    assert open_index(spark, path) is None
    first = ensure_index(rows, path, calibrate=False)
    assert ensure_index(rows.repartition(2), path, calibrate=False).meta == first.meta
    changed = rows.withColumn("embedding", F.when(F.col("id") == 3, F.reverse("embedding")).otherwise(F.col("embedding")))
    second = ensure_index(changed, path, calibrate=False)
    assert second.meta["version"] != first.meta["version"] and second.meta["built"] == 2 and open_index(spark, path).meta == second.meta
    named = ensure_index(changed.withColumn("name_embedding", F.col("embedding")), path, "name_embedding", calibrate=False)
    assert named.meta["column"] == "name_embedding" and named.meta["built"] == 3
    # A reader of the old version still has its files.
    assert first.blocks().count() > 0


def test_knn_indexed_with_filters(spark, vectors, index):
    rows, _ = vectors
    blank = {f.name: None for f in MEMORY}
    made = [tuple((blank | {"id": str(i), "type": ["fact", "rule"][i % 2], "visibility": "sensitive" if i % 9 == 0 else "shared", "scope": "permanent", "embedding": [float(np.float32(x)) for x in v]})[f.name] for f in MEMORY) for i, v in rows]
    memories = spark.createDataFrame(made, MEMORY)
    mine = build_index(memories.select("id", "embedding"), calibrate=False)
    query = rows[77][1]
    for filters in (None, SearchFilters(type="rule")):
        want = [(r["id"], round(r["score"], 6)) for r in search.knn(memories, query, 15, filters).collect()]
        got = [(r["id"], round(r["score"], 6)) for r in vector_index.knn_indexed(mine, memories, query, 15, filters, exact=True).collect()]
        assert sorted(s for _, s in got) == sorted(s for _, s in want) and len({i for i, _ in got} & {i for i, _ in want}) >= 13
    assert vector_index.knn_indexed(mine, memories, [1.0, 2.0], 5).collect() == [] and vector_index.knn_indexed(mine, memories, [0.0] * 16, 5).collect() == []


def test_no_vectors(spark):
    empty = build_index(spark.createDataFrame([(1, None), (2, [0.0])], "id long, embedding array<double>"))
    asked = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    assert neighbours(empty, asked, 3).collect() == [] and neighbours(empty, asked, 3, exact=True).collect() == [] and vector_index.row_pairs_above(empty, 0.5).collect() == []


# ---- rounds


def plain_thin_out(rows, alike):
    """rows: (id, place, trust); alike: function of two ids."""
    order, gone = sorted(rows, key=lambda r: r[1]), set()
    for n, (i, _, trust) in enumerate(order):
        for j, _, other in order[n + 1 :]:
            if i in gone:
                break
            if j not in gone and alike(i, j):
                gone.add(j if trust >= other else i)
    return gone


def plain_take_in(new, old, score, threshold):
    """new: (id, seq, size); old: (id, size). Holders are (row, record)."""
    size = {("s", i): n for i, n in old} | {("n", i): n for i, _, n in new}
    held, out = {("s", i): ("s", str(i)) for i, _ in old}, {}
    for i, _, n in sorted(new, key=lambda r: (r[1], r[0])):
        near = [(-round(score("n", i, *row), 12), (record[0] == "n", record), row) for row, record in held.items() if score("n", i, *row) >= threshold]
        if not near:
            held["n", i] = ("n", str(i))
            out[str(i)] = ("created", None)
            continue
        _, (_, record), row = min(near)
        if n > size[row]:
            del held[row]
            held["n", i] = record
        out[str(i)] = ("updated" if n > size[row] else "duplicate", record[1])
    return out


def graph_rows(kind, rng):
    """Vectors on a circle: alike if near each other."""
    if kind == "chain":
        turns = np.arange(60) * 0.3
    elif kind == "equal":
        turns = np.zeros(80)
    else:
        turns = np.round(rng.uniform(0, 40, 120) * 4) / 4 * 0.1  # many equal ones
    return [(i, [float(np.cos(t)), float(np.sin(t)), 0.5 if kind == "mixed" else 0.0]) for i, t in enumerate(turns)]


@pytest.mark.parametrize("kind", ["chain", "equal", "mixed"])
@pytest.mark.parametrize("rest", [0, 50_000])
def test_thin_out_like_a_plain_loop(spark, kind, rest):
    rng = np.random.default_rng(len(kind))
    rows = graph_rows(kind, rng)
    if kind == "chain" and not rest:
        rows = rows[:14]  # a round for every few of them
    trust = np.round(rng.uniform(0, 1, len(rows)), 1).tolist()
    threshold = float(np.cos(0.35)) if kind != "mixed" else 0.99
    ids, s = cosines(rows)
    place = rng.permutation(len(rows)).tolist() if kind == "mixed" else list(range(len(rows)))
    want = plain_thin_out(list(zip(ids.tolist(), place, trust, strict=True)), lambda a, b: s[a, b] > threshold)
    df = spark.createDataFrame([(i, v, place[i], trust[i]) for i, v in rows], "id long, embedding array<double>, k long, trust double")
    classes, links = greedy.alike_classes(df, threshold)
    ready = df.join(classes, "id").select("id", "class", greedy.places(F.col("k"), F.col("id")).alias("place"), "trust")
    assert {r["id"] for r in greedy.thin_out(ready, links, rest_rows=rest, rest_links=rest * 4).collect()} == want and want


@pytest.mark.parametrize("kind", ["chain", "equal", "mixed"])
@pytest.mark.parametrize("rest", [0, 50_000])
def test_batch_dedup_like_a_plain_loop(spark, kind, rest):
    rng = np.random.default_rng(7 + len(kind))
    rows = graph_rows(kind, rng)
    rows = rows[:18] if kind == "chain" else rows[:70]
    sizes = rng.integers(1, 30, len(rows)).tolist()
    stored = [i for i, _ in rows if i % 4 == 0 and kind != "equal" or i in (3, 50)]
    ids, s = cosines(rows)
    threshold = 0.9 if kind != "mixed" else 0.99
    want = plain_take_in([(i, i * 5 % 71, sizes[i]) for i in ids.tolist() if i not in stored], [(i, sizes[i]) for i in stored], lambda _, a, __, b: s[a, b], threshold - 1e-12)
    df = spark.createDataFrame([(i, v, i * 5 % 71, "x" * sizes[i]) for i, v in rows] + [(900, None, 1, "lone")], "id long, embedding array<double>, seq long, content string")
    got = writes.batch_dedup(df.where(~F.col("id").isin(stored)), df.where(F.col("id").isin(stored)), threshold, rest_rows=rest, rest_links=rest * 4).collect()
    assert {r["id"]: (r["status"], r["existing_id"]) for r in got} == want | {"900": ("created", None)}
    if rest:
        assert {r[0] for r in want.values()} > {"duplicate"}


def test_running_max_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), i, int(v)) for i, (g, v) in enumerate(zip(rng.choice([0, 0, 0, 1, 2], 400), rng.integers(0, 1000, 400), strict=True))]
    got = {r["place"]: r["top"] for r in greedy.running_max(spark.createDataFrame(rows, "g int, place long, v long"), "g", "place", "v", "top").collect()}
    assert got == {p: max((w for h, q, w in rows if h == g and q < p), default=None) for g, p, _ in rows}


def test_nothing_alike(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1, "a"), (2, [0.0, 1.0], 2, "b")], "id long, embedding array<double>, seq long, content string")
    assert {(r["id"], r["status"]) for r in writes.batch_dedup(rows, rows.limit(0), 0.9).collect()} == {("1", "created"), ("2", "created")}
    blank = {f.name: None for f in MEMORY}
    memories = spark.createDataFrame([tuple((blank | {"id": "a", "scope": "permanent", "visibility": "shared"})[f.name] for f in MEMORY)], MEMORY)
    assert lifecycle.consolidate(memories).collect() == []


def test_a_task_holds_two_groups_and_two_blocks_meet_once(spark, vectors, index, monkeypatch):
    """However small the groups are, and however few rows a task holds."""
    rows, _ = vectors
    ids, s = cosines(rows)
    monkeypatch.setattr(vector_index, "GROUP_BYTES", 4096)
    monkeypatch.setattr(vector_index, "HELD_ROWS", 50)
    i, j = np.nonzero((s > 0.4) & (ids[:, None] < ids[None, :]))
    got = [(r["a"], r["b"]) for r in vector_index.row_pairs_above(index, 0.4).collect()]
    assert len(got) == len(set(got)) and set(got) == set(zip(ids[i].tolist(), ids[j].tolist(), strict=True))
    # A vector is sent once for each group and once more, not for each list.
    assert vector_index._dealt(index).count() == index.blocks().count() * (vector_index._groups(index) + 1) and vector_index._groups(index) > vector_index.LEAST_GROUPS


@pytest.mark.parametrize("block_rows", [100, 5000])
def test_nearest_few_before(spark, vectors, block_rows):
    rows, _ = vectors
    ids, s = cosines(rows)
    want = set()
    for at, q in enumerate(ids.tolist()):
        before = sorted((-round(s[at, k], 12), int(ids[k])) for k in np.flatnonzero((ids < q) & (s[at] > 0.5)))
        want |= {(q, i) for _, i in before[:4]}
    got = [(r["id"], r["existing_id"]) for r in search.nearest_few_before(frame(spark, vectors), 0.5, 4, block_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("rest", [0, 30])
def test_take_in_by_pairs_like_a_plain_loop(spark, rest, monkeypatch):
    """Random vectors in random order, alike to many, some equal; of stored and new rows."""
    monkeypatch.setattr(greedy, "_mostly_single", lambda *_: True)
    walked = []
    monkeypatch.setattr(greedy, "_walk_pairs", lambda pairs, rows, plain=greedy._walk_pairs: walked.append(pairs.count()) or plain(pairs, rows))
    rng = np.random.default_rng(5)
    drawn = rng.normal(0, 1, (30, 4)).round(2)
    rows = [(i, drawn[i % 26].tolist()) for i in range(30)]
    seq, sizes, stored = rng.permutation(30).tolist(), rng.integers(1, 12, 30).tolist(), [4, 9, 27]
    ids, s = cosines(rows)
    want = plain_take_in([(i, seq[i], sizes[i]) for i in ids.tolist() if i not in stored], [(i, sizes[i]) for i in stored], lambda _, a, __, b: s[a, b], 0.6 - 1e-12)
    df = spark.createDataFrame([(i, v, seq[i], "x" * sizes[i]) for i, v in rows], "id long, embedding array<double>, seq long, content string")
    got = writes.batch_dedup(df.where(~F.col("id").isin(stored)), df.where(F.col("id").isin(stored)), 0.6, rest_rows=rest, rest_links=rest).collect()
    assert {r["id"]: (r["status"], r["existing_id"]) for r in got} == want
    # Settled by rounds alone, or by rounds and a walk.
    assert len(walked) == (rest > 0) and all(n <= rest for n in walked)


@pytest.mark.parametrize("rest", [0, 400])
def test_thin_out_of_rows_alike_to_many_takes_few_rounds(spark, rest, monkeypatch):
    """Where each row is alike to many, all rows are within two links of each other; they don't wait for each other one by one."""
    made, walked = [], []
    monkeypatch.setattr(greedy, "cut_off", lambda df, plain=greedy.cut_off: made.append(1) or plain(df))
    monkeypatch.setattr(greedy, "_walk_met", lambda pairs, placed, plain=greedy._walk_met: walked.append(pairs.count()) or plain(pairs, placed))
    rng = np.random.default_rng(8)
    vectors, trust, place = rng.normal(0, 1, (150, 6)).round(2), rng.integers(0, 9, 150).tolist(), rng.permutation(150).tolist()
    ids, s = cosines([(i, v.tolist()) for i, v in enumerate(vectors)])
    want = plain_thin_out(list(zip(ids.tolist(), place, trust, strict=True)), lambda a, b: s[a, b] > 0.5)
    df = spark.createDataFrame([(i, v.tolist(), place[i], trust[i]) for i, v in enumerate(vectors)], "id long, embedding array<double>, place long, trust long")
    classes, links = greedy.alike_classes(df.select("id", "embedding"), 0.5)
    found = greedy.thin_out(df.drop("embedding").join(classes, "id").select("id", "class", "place", "trust"), links, rest_rows=rest, rest_links=rest).collect()
    assert {r["id"] for r in found} == want and len(found) == len(want) > 50
    assert len(made) <= 20 and len(walked) == (rest > 0) and all(n <= rest for n in walked)


def test_estimates_do_not_grow_with_rounds(spark):
    """A checkpoint had the estimate of its plan, a product of its sides', whose digits tripled with every round; the estimates of indexed_notes took minutes."""
    rows = spark.range(60).select("id", (F.col("id") % 7).alias("class"))
    for _ in range(5):
        firsts = cut_off(rows.groupBy("class").agg(F.min("id").alias("first")))
        rows = cut_off(rows.join(firsts, "class").join(firsts.withColumnRenamed("first", "again"), "class").select("id", "class"))
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 30
    assert sorted(map(tuple, rows.collect())) == [(i, i % 7) for i in range(60)]


@pytest.mark.parametrize("kind", ["chain", "mixed", "lengths"])
@pytest.mark.parametrize("block_rows", [6, 2000])
def test_first_come_like_a_plain_loop(spark, kind, block_rows, monkeypatch):
    monkeypatch.setattr(vector_index, "ASKED_BYTES", 200)
    rng = np.random.default_rng(5)
    threshold = 0.9
    if kind == "chain":
        turn = rng.permutation(14) * 0.3
        vectors = [[float(np.cos(t)), float(np.sin(t)), 0.1] for t in turn]
    else:
        centres = rng.normal(0, 1, (6, 8))
        vectors = [(centres[i % 6] + rng.normal(0, 0.3, 8)).tolist()[: 5 if kind == "lengths" and i % 3 == 0 else 8] for i in range(90)]
        vectors += vectors[10:16]
    rows = list(enumerate(vectors, -3))
    plain, held, want = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows], [], []
    for i, u in plain:
        if i < 0 or not any(len(u) == len(w) and u @ w > threshold for w in held):
            held.append(u)
            want += [i] if i >= 0 else []
    got = greedy.first_come(spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3), threshold, block_rows).collect()
    assert sorted(r["id"] for r in got) == want and len(want) < len(rows) - 3


@pytest.mark.parametrize("passing", [1, 250])
def test_pairs_pass_a_walk_by(spark, passing, monkeypatch):
    """More pairs than are held at once: they went in rounds, at 1 GB in so many that the job did not end."""
    stored, cut = [], greedy.cut_off
    monkeypatch.setattr(greedy, "cut_off", lambda df: stored.append(df.columns) or cut(df))
    monkeypatch.setattr(greedy, "PASSING", passing, raising=False)
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.cos(t)), float(np.sin(t)), 0.2]) for i, t in enumerate(rng.uniform(0, 6, 60))]
    sizes = rng.integers(1, 30, 60).tolist()
    old = [3, 20, 21]
    ids, s = cosines(rows)
    want = plain_take_in([(i, i * 5 % 71, sizes[i]) for i in ids.tolist() if i not in old], [(i, sizes[i]) for i in old], lambda _, a, __, b: s[a, b], 0.9 - 1e-12)
    df = spark.createDataFrame([(i, v, i * 5 % 71, "x" * sizes[i]) for i, v in rows], "id long, embedding array<double>, seq long, content string")
    got = writes.batch_dedup(df.where(~F.col("id").isin(old)), df.where(F.col("id").isin(old)), 0.9, rest_rows=30, rest_links=30).collect()
    assert {r["id"]: (r["status"], r["existing_id"]) for r in got} == want
    assert passing == 1 or sum("y_size" in columns for columns in stored) <= 2
