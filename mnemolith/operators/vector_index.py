"""A stored index of vectors: inverted lists around centroids, searched by probing some lists or, exactly, all that can matter.

Vectors stand in the list of their nearest centroid, in blocks ordered by their angle to it. Two vectors whose angles to a
centroid differ by more than theirs to each other cannot exist (angles obey the triangle inequality), so a search within an
angle needs only lists whose range of angles comes near enough. That makes three searches out of one table:

* probing: the lists of the nearest centroids, as many as a calibration against exact answers asked for;
* exact neighbours: the same, and then every list that could still hold something nearer than what was found;
* exact pairs above a threshold: for each vector the lists that can hold a partner.

Centroids are fitted on at most ``SAMPLE_ROWS`` vectors, those of the smallest hashes of their ids; there are about as many as
the root of the number of vectors and at most ``MOST_LISTS``, so they fit a broadcast. All vectors are in the index; equal ones once,
with their other ids in a table beside it. Vectors of different lengths never meet: their cosine is 0, and lists hold one length each.

Not in the index are vectors without a direction: null, empty, with null or non-finite elements, or of norm 0. Their cosine
with anything is 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_off, scratch
from .filters import SearchFilters

SAMPLE_ROWS, MOST_LISTS, FIT_ROUNDS = 20_000, 4096, 8
#: A block's bytes and vectors at most.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 1024
#: Vectors that a task holds while others pass by, the groups that there are at least, and the rows found that it holds.
GROUP_BYTES, LEAST_GROUPS, HELD_ROWS = 32 << 20, 12, 1 << 19
#: Packed queries that a task holds at once.
ASKED_BYTES = 16 << 20
#: Calibration: queries, neighbours of each, and the share of them that probing has to find.
ASKED, NEIGHBOURS, RECALL = 100, 10, 0.95
#: Angles are compared with this slack, far above their rounding.
SLACK = 1e-6
#: From this threshold on few vectors of two blocks are alike.
SPARSE = 0.7

META = "version string, column string, id_type string, vectors long, checksum long, probes int, recall double, built long"
LISTS = "list int, dimension int, centroid array<double>, lo double, hi double, rows long"


def has_direction(v: Column) -> Column:
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & real & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, for rows of any magnitude."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def fit_centroids(sample: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """At most ``k`` directions for unit vectors: Lloyd's rounds, then the largest groups are halved while others stay empty."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(FIT_ROUNDS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=k)
        # A centre that nothing is near takes a vector of the largest group.
        for empty in np.flatnonzero(counts == 0):
            members = np.flatnonzero(nearest == counts.argmax())
            sums[empty] = sample[rng.choice(members)]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


@dataclass(frozen=True)
class Lists:
    """Centroids and ranges of angles of one length's lists."""

    numbers: np.ndarray
    centres: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def near(self, u: np.ndarray, n: int) -> np.ndarray:
        """For each unit vector the positions of the nearest ``n`` centroids, as a mask."""
        cosines = u @ self.centres.T
        mask = np.zeros(cosines.shape, dtype=bool)
        if len(self.numbers):
            np.put_along_axis(mask, np.argsort(-cosines, axis=1, kind="stable")[:, :n], True, axis=1)
        return mask

    def reach(self, u: np.ndarray, least: np.ndarray) -> np.ndarray:
        """A mask of the lists that can hold a vector of cosine ``least`` or more with each unit vector."""
        at, within = angles(u @ self.centres.T), angles(least)[:, None] + SLACK
        return (at - within <= self.hi) & (at + within >= self.lo)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    meta: dict
    #: By length of vector.
    lists: dict[int, Lists]

    @property
    def probes(self) -> int:
        return self.meta["probes"]

    def blocks(self) -> DataFrame:
        """(list, dimension, ids, lo, hi, block): unit vectors as doubles."""
        return self.spark.read.schema(f"list int, dimension int, ids array<{_id_type(self)}>, lo double, hi double, block binary").parquet(f"{self.path}/{self.meta['version']}/blocks")

    def others(self) -> DataFrame:
        """(first, id): vectors equal to one that is in the blocks."""
        return self.spark.read.schema(f"first {_id_type(self)}, id {_id_type(self)}").parquet(f"{self.path}/{self.meta['version']}/others")

    def is_of(self, vectors: DataFrame, column: str = "embedding") -> bool:
        """Whether the index was made of these rows' column as it is now."""
        return self.meta["column"] == column and (self.meta["vectors"], self.meta["checksum"]) == _mark(vectors, column)


def _mark(vectors: DataFrame, column: str) -> tuple[int, int]:
    row = vectors.where(has_direction(F.col(column))).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("id", column)), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def _read_lists(spark: SparkSession, path: str, version: str) -> dict[int, Lists]:
    # At most MOST_LISTS rows, and one for each length that the sample has not.
    rows = spark.read.schema(LISTS).parquet(f"{path}/{version}/lists").orderBy("list").collect()
    out = {}
    for d in {r["dimension"] for r in rows}:
        mine = [r for r in rows if r["dimension"] == d]
        out[d] = Lists(np.array([r["list"] for r in mine]), np.array([r["centroid"] for r in mine]), np.array([r["lo"] for r in mine]), np.array([r["hi"] for r in mine]))
    return out


def open_index(spark: SparkSession, path: str) -> VectorIndex | None:
    """The index built last at ``path``, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    meta = spark.read.schema(META).parquet(f"{path}/meta").orderBy(F.desc("built"), "version").first()
    return VectorIndex(spark, path, meta.asDict(), _read_lists(spark, path, meta["version"])) if meta else None


def ensure_index(vectors: DataFrame, path: str, column: str = "embedding", **options) -> VectorIndex:
    """The index at ``path`` if it was made of this column of these rows, else a new one in its place. Readers of the old one keep its files."""
    found = open_index(vectors.sparkSession, path)
    return found if found is not None and found.is_of(vectors, column) else build_index(vectors, path, column, **options)


def build_index(vectors: DataFrame, path: str | None = None, column: str = "embedding", *, lists: int | None = None, calibrate: bool = True, merge: bool = True) -> VectorIndex:
    """Index (id, column); without ``merge`` equal vectors stay rows of their own. The version is written whole before its line in ``meta`` makes it the current one."""
    spark = vectors.sparkSession
    path, version = path or scratch(spark, "vector-index"), uuid.uuid4().hex
    kind = vectors.schema["id"].dataType.simpleString()
    n, checksum = _mark(vectors, column)
    rows = vectors.where(has_direction(F.col(column))).select("id", F.transform(column, lambda x: x.cast("double")).alias("v"))
    # Equal vectors are one row from here on.
    each = rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")) if merge else rows.select("v", "id", F.lit(1).alias("n"))
    distinct = cut_off(each)
    repeated = distinct.where("n > 1").select("v", F.col("id").alias("first"))
    rows.join(repeated, "v").where("id <> first").select("first", "id").write.parquet(f"{path}/{version}/others")

    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    found: dict[int, np.ndarray] = {}
    lengths = sample.map(len).to_numpy(dtype=int)
    for d in np.unique(lengths):
        mine = unit(matrix(sample[lengths == d]))
        share = len(mine) / len(sample)
        found[int(d)] = fit_centroids(mine, round(lists or min(MOST_LISTS, np.sqrt(max(1, n))) * share))
    firsts = dict(zip(found, np.cumsum([0] + [len(c) for c in found.values()]).tolist(), strict=False))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(list, dimension, angle, id, u); a length that the sample has not gets a list of its own, with a negative number."""
        for batch in batches:
            sizes = batch["v"].map(len).to_numpy(dtype=int)
            for d in np.unique(sizes):
                some = batch[sizes == d]
                u = unit(matrix(some["v"]))
                centres = found.get(int(d))
                cosines = u @ centres.T if centres is not None else u[:, :1] * 0
                nearest = cosines.argmax(axis=1)
                number = nearest + firsts[int(d)] if centres is not None else nearest - int(d)
                yield pd.DataFrame({"list": number.astype(np.int32), "dimension": np.int32(d), "angle": angles(cosines[np.arange(len(u)), nearest]), "id": some["id"], "u": list(u)})

    assigned = cut_off(distinct.select("id", "v").mapInPandas(assign, f"list int, dimension int, angle double, id {kind}, u array<double>"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows that follow each other in a list, as blocks."""
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            rows = pd.concat(held)
            held.clear()
            return pd.DataFrame({"list": [rows["list"].iloc[0]], "dimension": [rows["dimension"].iloc[0]], "ids": [rows["id"].to_numpy()], "lo": [rows["angle"].min()], "hi": [rows["angle"].max()], "block": [matrix(rows["u"]).astype("<f8").tobytes()]})

        for batch in batches:
            edges = np.flatnonzero(np.diff(batch["list"].to_numpy())) + 1
            for some in np.split(np.arange(len(batch)), edges):
                part = batch.iloc[some]
                if held and held[0]["list"].iloc[0] != part["list"].iloc[0]:
                    yield flush()
                size = block_rows(int(part["dimension"].iloc[0]))
                while len(part):
                    room = size - sum(map(len, held))
                    held.append(part.iloc[:room])
                    part = part.iloc[room:]
                    if sum(map(len, held)) == size:
                        yield flush()
        if held:
            yield flush()

    order = ["list", "angle", "id"]
    blocks = assigned.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pack, f"list int, dimension int, ids array<{kind}>, lo double, hi double, block binary")
    blocks.write.partitionBy("list").parquet(f"{path}/{version}/blocks")
    bounds = assigned.groupBy("list", "dimension").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("rows")).collect()
    centre = lambda r: found[r["dimension"]][r["list"] - firsts[r["dimension"]]].tolist() if r["list"] >= 0 else [0.0] * r["dimension"]
    # A list without a centroid is within reach of everything of its length.
    lines = [(r["list"], r["dimension"], centre(r), r["lo"] if r["list"] >= 0 else 0.0, r["hi"] if r["list"] >= 0 else np.pi, r["rows"]) for r in bounds]
    spark.createDataFrame(lines, LISTS).coalesce(1).write.parquet(f"{path}/{version}/lists")
    meta = {"version": version, "column": column, "id_type": kind, "vectors": n, "checksum": checksum, "probes": max(1, len(lines)), "recall": 1.0}
    index = VectorIndex(spark, path, meta, _read_lists(spark, path, version))
    if calibrate and lines:
        meta["probes"], meta["recall"] = _calibrated(index, distinct)
    before = open_index(spark, path)
    meta["built"] = before.meta["built"] + 1 if before else 1
    spark.createDataFrame([tuple(meta.values())], META).coalesce(1).write.mode("append").parquet(f"{path}/meta")
    return VectorIndex(spark, path, meta, index.lists)


def block_rows(dimension: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dimension)))


def _calibrated(index: VectorIndex, distinct: DataFrame) -> tuple[int, float]:
    """The fewest probes that find ``RECALL`` of the exact neighbours of ``ASKED`` vectors, and the share that they find."""
    asked = distinct.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(ASKED).select("id", F.col("v").alias("embedding"))
    # At most ASKED x NEIGHBOURS rows; the list of each is that of its nearest centroid.
    pairs = neighbours(index, asked, NEIGHBOURS + 1, exact=True).join(distinct.select(F.col("id").alias("found"), "v"), F.col("neighbour_id") == F.col("found"))
    rows = pairs.join(asked, "id").where("id <> neighbour_id").select("embedding", "v").collect()
    places = []
    for r in rows:
        lists = index.lists[len(r["v"])]
        asks, own = (unit(np.array([x])) @ lists.centres.T for x in (r["embedding"], r["v"]))
        places.append(int((-asks[0]).argsort(kind="stable").argsort()[own[0].argmax()]) + 1)
    if not places:
        return 1, 1.0
    places.sort()
    probes = places[int(np.ceil(RECALL * len(places))) - 1]
    return probes, float(np.mean(np.array(places) <= probes))


def _asking(index: VectorIndex, queries: DataFrame, mask: str, probes: int) -> DataFrame:
    """(list, asked, block, least): queries (id, embedding[, least]) packed by the lists that they probe.

    ``mask``: nearest probes those of the nearest centroids, reach all that can hold a cosine of ``least``, rest the latter without the former."""
    spread, kind = index.spark.sparkContext.broadcast(index.lists), queries.schema["id"].dataType.simpleString()
    columns = ["list", "asked", "asked_block", "least"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len).to_numpy(dtype=int)
            out, held = [], 0
            for d in np.unique(sizes):
                lists = spread.value.get(int(d))
                if lists is None:
                    continue
                some = batch[sizes == d]
                u, least, ids = unit(matrix(some["embedding"])), some["least"].to_numpy(dtype=float), some["id"].to_numpy()
                hit = lists.near(u, probes) if mask == "nearest" else lists.reach(u, least)
                if mask == "rest":
                    hit &= ~lists.near(u, probes)
                size = block_rows(int(d))
                for at in np.flatnonzero(hit.any(axis=0)):
                    mine = np.flatnonzero(hit[:, at])
                    out += [(int(lists.numbers[at]), ids[p], u[p].astype("<f8").tobytes(), least[p]) for p in (mine[i : i + size] for i in range(0, len(mine), size))]
                    held += len(mine) * int(d) * 8
                    # Where many lists are in reach, the queries of a batch are held for some of them at a time.
                    if held > ASKED_BYTES:
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    ready = queries.where(has_direction(F.col("embedding"))).select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), *([F.col("least")] if "least" in queries.columns else [F.lit(-1.0).alias("least")]))
    return ready.mapInPandas(pack, f"list int, asked array<{kind}>, asked_block binary, least array<double>")


def _products(row: tuple) -> np.ndarray:
    """Cosines of a block of queries with a block of vectors."""
    a, b = (np.frombuffer(x, "<f8") for x in (row.asked_block, row.block))
    return a.reshape(len(row.asked), -1) @ b.reshape(len(row.ids), -1).T


def _best(index: VectorIndex, packed: DataFrame, k: int, kinds: tuple[str, str]) -> DataFrame:
    """(id, neighbour_id, score): of each query with each block of its lists the best ``k``, and those as good as the last."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                cosines = np.clip(_products(row), -1.0, 1.0)
                last = np.partition(cosines, -k, axis=1)[:, -k] if cosines.shape[1] > k else np.full(len(cosines), -2.0)
                i, j = np.nonzero(cosines >= np.maximum(last, np.asarray(row.least) - 1e-9)[:, None])
                yield pd.DataFrame({"id": np.asarray(row.asked)[i], "neighbour_id": np.asarray(row.ids)[j], "score": cosines[i, j]})

    joined = packed.join(index.blocks().select("list", "ids", "block"), "list").select("asked", "asked_block", "least", "ids", "block")
    return joined.mapInPandas(score, f"id {kinds[0]}, neighbour_id {kinds[1]}, score double")


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each id; the limit also holds before the shuffle."""
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.round("score", 12)), "neighbour_id"))
    return rows.withColumn("__n", place).where(F.col("__n") <= k).drop("__n")


def _with_others(index: VectorIndex, rows: DataFrame, k: int) -> DataFrame:
    """Rows of equal vectors beside the one that stands for them: no more than ``k`` of each can be among the best."""
    place = F.row_number().over(W.partitionBy("first").orderBy("id"))
    others = index.others().withColumn("__n", place).where(F.col("__n") <= k).select("first", F.col("id").alias("__other"))
    more = rows.join(others, F.col("neighbour_id") == F.col("first")).select("id", F.col("__other").alias("neighbour_id"), "score")
    return rows.unionByName(more)


def neighbours(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(id, neighbour_id, score): the ``k`` most alike indexed rows of every query (id, embedding), of equal scores the smaller ids.

    Probing finds about the calibrated share of them; with ``exact`` a second pass looks into every list that can hold better ones."""
    kinds = queries.schema["id"].dataType.simpleString(), _id_type(index)
    # What is exact later needs no more than a start.
    probes = probes or (min(index.probes, 8) if exact else index.probes)
    found = _top(_best(index, _asking(index, queries, "nearest", probes), k, kinds), k)
    if exact:
        found = cut_off(found)
        worst = found.groupBy("id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n"))
        least = F.when(F.col("n") >= k, F.col("s")).otherwise(-1.0)
        again = queries.select("id", "embedding").join(worst, "id", "left").select("id", "embedding", F.coalesce(least, F.lit(-1.0)).alias("least"))
        found = _top(found.unionByName(_best(index, _asking(index, again, "rest", probes), k, kinds)), k)
    return _top(_with_others(index, found, k), k)


def with_alike(index: VectorIndex, queries: DataFrame, threshold: float) -> DataFrame:
    """(id) of the queries (id, embedding) whose cosine with an indexed vector is above the threshold. Only those that have none in the nearest lists look into all that can hold one."""
    kinds, asking = (queries.schema["id"].dataType.simpleString(), _id_type(index)), queries.select("id", "embedding", F.lit(threshold).alias("least"))
    found = lambda rows, mask: _best(index, _asking(index, rows, mask, min(index.probes, 8)), 1, kinds).where(F.col("score") > threshold).select("id").distinct()
    near = cut_off(found(asking, "nearest"))
    return near.unionByName(found(asking.join(near, "id", "left_anti"), "rest"))


class _Tile:
    """A block's vectors in a meeting."""

    def __init__(self, row: tuple):
        self.list, self.lo, self.hi, self.ids = row.list, row.lo, row.hi, np.asarray(row.ids)
        self.u = np.frombuffer(row.block, "<f8").reshape(len(self.ids), -1)
        self.place = (row.list, self.ids[0])
        self.rough = None

    def roughly(self) -> np.ndarray:
        if self.rough is None:
            self.rough = self.u.astype(np.float32)
        return self.rough

    def reached(self, other: _Tile, lists: Lists, within: float) -> np.ndarray:
        """Which of the vectors can have a partner in the other block."""
        at = angles(self.u @ lists.centres[np.searchsorted(lists.numbers, other.list)])
        return (at - within <= other.hi) & (at + within >= other.lo)


def _groups(index: VectorIndex) -> int:
    return max(LEAST_GROUPS, -(-8 * max(index.lists, default=1) * index.meta["vectors"] // GROUP_BYTES))


def _dealt(index: VectorIndex) -> DataFrame:
    """Blocks by two groups x and y, x not after y: those of x (side 0) before those of y (side 1)."""
    groups = _groups(index)
    blocks = index.blocks().withColumn("g", F.pmod(F.xxhash64("list", F.element_at("ids", 1)), F.lit(groups)).cast("int"))
    rest = ["list", "ids", "lo", "hi", "block"]
    first = blocks.select("dimension", F.col("g").alias("x"), F.explode(F.sequence("g", F.lit(groups - 1))).alias("y"), F.lit(0).alias("side"), *rest)
    second = blocks.select("dimension", F.explode(F.sequence(F.lit(0), "g")).alias("x"), F.col("g").alias("y"), F.lit(1).alias("side"), *rest)
    return first.unionByName(second).repartition(groups * (groups + 1) // 2, "dimension", "x", "y").sortWithinPartitions("dimension", "x", "y", "side", "list")


def _meetings(index: VectorIndex, threshold: float, work: Callable, columns: str, condense: Callable | None = None) -> DataFrame:
    """``work(cosines, ids of the rows, ids of the columns, whether both are the same block)`` for every two blocks, with their vectors that can reach the threshold.

    Blocks are dealt into groups of ``GROUP_BYTES`` or so, and a task has two groups at a time: it holds the first and the blocks of the second pass by. So a vector is
    sent once for each group, not for each list, and two blocks meet once. ``condense`` keeps of the rows of two groups those that still matter."""
    spread = index.spark.sparkContext.broadcast(index.lists)
    within = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + SLACK

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, held, n, most = None, [], [], 0, HELD_ROWS
        for batch in batches:
            for row in batch.itertuples(index=False):
                if key != (row.dimension, row.x, row.y):
                    if held:
                        yield condense(pd.concat(held)) if condense else pd.concat(held)
                    key, first, held, n, most = (row.dimension, row.x, row.y), [], [], 0, HELD_ROWS
                lists, b = spread.value[row.dimension], _Tile(row)
                if row.side == 0:
                    first.append(b)
                    continue
                for a in first:
                    same = row.x == row.y and a.place == b.place
                    if row.x == row.y and a.place > b.place:
                        continue
                    i, j = a.reached(b, lists, within), b.reached(a, lists, within)
                    if same:
                        i[:], j[:] = True, True
                    if not (i.any() and j.any()):
                        continue
                    if threshold >= SPARSE and not same:
                        # Single precision tells where nothing is near the threshold; its error is smaller than this slack.
                        near = a.roughly()[i] @ b.roughly()[j].T > threshold - (a.u.shape[1] + 4) * 1e-7
                        i[i], j[j] = near.any(axis=1), near.any(axis=0)
                        if not i.any():
                            continue
                    held.append(work(np.clip(a.u[i] @ b.u[j].T, -1.0, 1.0), a.ids[i], b.ids[j], same))
                    n += len(held[-1])
                    if n > most:
                        some = pd.concat(held)
                        if condense:
                            held = [condense(some)]
                            n = len(held[0])
                            most = max(HELD_ROWS, 2 * n)
                        else:
                            yield some
                            held, n = [], 0
        if held:
            yield condense(pd.concat(held)) if condense else pd.concat(held)

    return _dealt(index).mapInPandas(meet, columns)


def _id_type(index: VectorIndex) -> str:
    return index.meta["id_type"]


def pairs_above(index: VectorIndex, threshold: float) -> DataFrame:
    """(a, b, score), a < b, of every pair of distinct indexed vectors with a cosine above the threshold; of equal vectors only the first is there."""

    def above(cosines: np.ndarray, asked: np.ndarray, ids: np.ndarray, same: bool) -> pd.DataFrame:
        i, j = np.nonzero(cosines > threshold)
        a, b = asked[i], ids[j]
        keep = a < b if same else np.ones(len(a), dtype=bool)
        return pd.DataFrame({"a": np.where(a < b, a, b)[keep], "b": np.where(a < b, b, a)[keep], "score": cosines[i, j][keep]})

    kind = _id_type(index)
    return _meetings(index, threshold, above, f"a {kind}, b {kind}, score double")


def row_pairs_above(index: VectorIndex, threshold: float) -> DataFrame:
    """(a, b, score) of ``pairs_above`` for all rows: equal vectors in each other's place, and paired with each other."""
    others, found = index.others(), pairs_above(index, threshold)
    if others.isEmpty():
        return found
    # All rows of a repeated vector; pairs pass by once for each side.
    members = others.unionByName(others.select("first", F.col("first").alias("id")).distinct())
    for side in ("a", "b"):
        rest = "b" if side == "a" else "a"
        found = found.join(members, F.col(side) == F.col("first"), "left").select(F.coalesce("id", side).alias(side), rest, "score")
    equal = others.select("first", F.col("id").alias("b")).join(members, "first").select(F.col("id").alias("a"), "b", F.lit(1.0).alias("score")).where((F.col("a") < F.col("b")) & (F.lit(1.0) > threshold))
    return found.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def first_alike(index: VectorIndex, threshold: float) -> DataFrame:
    """(id, first): for every vector that has any, the smallest of the smaller ids with a cosine above the threshold.

    The index must hold each row by itself, as ``build_index`` makes it with ``merge=False``. A meeting of two groups gives one row a vector at most."""

    def first(cosines: np.ndarray, asked: np.ndarray, ids: np.ndarray, same: bool) -> pd.DataFrame:
        hit, found = cosines > threshold, []
        for near, new, old in ((hit, asked, ids),) if same else ((hit, asked, ids), (hit.T, ids, asked)):
            some = np.flatnonzero(near.any(axis=1))
            order = np.argsort(old, kind="stable")
            at = near[np.ix_(some, order)].argmax(axis=1)
            rows = pd.DataFrame({"id": new[some], "first": old[order][at]})
            found.append(rows[rows["first"] < rows["id"]])
        return pd.concat(found)

    kind = _id_type(index)
    each = _meetings(index, threshold, first, f"id {kind}, first {kind}", lambda rows: rows.groupby("id", as_index=False)["first"].min())
    return each.groupBy("id").agg(F.min("first").alias("first"))


def _first_rows(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The ``k`` best of (id, existing_id, score) of each id."""
    return lambda rows: rows.sort_values(["id", "score", "existing_id"], ascending=[True, False, True]).groupby("id", sort=False).head(k)


def most_alike_before(index: VectorIndex, above: float, k: int) -> DataFrame:
    """(id, existing_id, score): for every row the ``k`` most alike of those with a smaller id, the first among equals (to twelve digits), of a cosine above ``above``.

    The index must hold each row by itself, as ``build_index`` makes it with ``merge=False``."""

    def best(cosines: np.ndarray, asked: np.ndarray, ids: np.ndarray, same: bool) -> pd.DataFrame:
        cosines, found = np.round(cosines, 12), []
        for s, new, old in ((cosines, asked, ids),) if same else ((cosines, asked, ids), (cosines.T, ids, asked)):
            i, j = np.nonzero((s > above) & (old[None, :] < new[:, None]))
            rows = pd.DataFrame({"id": new[i], "existing_id": old[j], "score": s[i, j]})
            found.append(few(rows) if len(rows) > k * len(new) else rows)
        return pd.concat(found)

    few, kind = _first_rows(k), _id_type(index)
    each = _meetings(index, above - SLACK, best, f"id {kind}, existing_id {kind}, score double", few)
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "existing_id"))
    return each.withColumn("__n", place).where(F.col("__n") <= k).drop("__n")


def best_before(index: VectorIndex, at_least: float) -> DataFrame:
    """(id, existing_id, score): for every row the most alike of those with a smaller id, the first among equals (to nine digits), if its cosine is ``at_least``.

    A meeting of two groups gives one row a vector at most, and of equal vectors all but the first have that one."""

    def best(cosines: np.ndarray, asked: np.ndarray, ids: np.ndarray, same: bool) -> pd.DataFrame:
        cosines, found = np.round(cosines, 9), []
        for s, new, old in ((cosines, asked, ids),) if same else ((cosines, asked, ids), (cosines.T, ids, asked)):
            order = np.argsort(old, kind="stable")
            allowed = np.where(old[order][None, :] < new[:, None], s[:, order], -np.inf)
            at = allowed.argmax(axis=1)
            top = allowed[np.arange(len(new)), at]
            found.append(pd.DataFrame({"id": new, "existing_id": old[order][at], "score": top})[top >= at_least])
        return pd.concat(found)

    kind = _id_type(index)
    each = _meetings(index, at_least - SLACK, best, f"id {kind}, existing_id {kind}, score double", _first_rows(1))
    ranked = each.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "existing_id")).alias("m")).select("id", "m.existing_id", (-F.col("m.s")).alias("score"))
    ranked = cut_off(ranked)
    # An equal vector's first row scores 1, and only what scores 1 with that one as well can come before it.
    parallel = ranked.where("score >= 1").select(F.col("id").alias("first"), F.col("existing_id").alias("__earlier"))
    others = index.others().join(parallel, "first", "left").select("id", F.coalesce("__earlier", "first").alias("existing_id"), F.lit(1.0).alias("score"))
    return ranked.unionByName(others.where(F.col("score") >= at_least))


def knn_indexed(index: VectorIndex, memories: DataFrame, query: list[float], limit: int, filters: SearchFilters | None = None, *, probes: int | None = None, exact: bool = False) -> DataFrame:
    """What ``search.knn`` gives, from the index: memories that the filters pass, with ``score``, best first.

    Only lists that are probed are read. With ``exact`` they are followed by all lists that can hold a better row than the last that was found."""
    q = np.asarray(query, dtype=float)
    lists = index.lists.get(len(q))
    if lists is None or not np.isfinite(q).all() or not q.any():
        return memories.limit(0).withColumn("score", F.lit(0.0))
    u, passed = unit(q[None, :]), (filters or SearchFilters()).apply(memories)

    def best(hit: np.ndarray) -> DataFrame:
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    yield pd.DataFrame({"id": row.ids, "score": np.clip(np.frombuffer(row.block, "<f8").reshape(len(row.ids), -1) @ u[0], -1.0, 1.0)})

        rows = index.blocks().where(F.col("list").isin([int(x) for x in lists.numbers[hit]])).select("ids", "block").mapInPandas(score, f"id {_id_type(index)}, score double")
        more = rows.join(index.others().withColumnRenamed("id", "other"), F.col("id") == F.col("first")).select(F.col("other").alias("id"), "score")
        return passed.join(rows.unionByName(more), "id").orderBy(F.desc("score"), "id").limit(limit)

    near = lists.near(u, probes or (min(index.probes, 8) if exact else index.probes))[0]
    found = best(near)
    if not exact:
        return found
    found = cut_off(found)
    last = found.agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).first()
    rest = lists.reach(u, np.array([last["s"] if last["n"] >= limit else -1.0]))[0] & ~near
    return found.unionByName(best(rest)).orderBy(F.desc("score"), "id").limit(limit) if rest.any() else found
