"""Exact integer k-means with the dimensions dealt out over tasks.

Vectors are stored as chunks of rows, and every chunk as blocks of columns. Blocks of one shard of columns meet only the
matching slice of the centroids: a task gives the exact partial squared distances of its block to all slices,
``reduceByKey`` adds the blocks of a chunk, and the smallest sum of a row is its cluster. The assignment goes back to the
blocks, which stay where they are (the same partitioner on both sides, so only cluster numbers move), each shard adds up
its own columns for each cluster, and makes its own slice of the next centroids. No task needs a whole vector or a whole
centroid, and the driver holds k x d centroid components and k sums, whatever the number of vectors.

Chunks are of equal size whatever their vectors are, so equal vectors make no hot key. Blocks come from a table in the
shared folder; an executor that is lost costs the recomputation of its partitions.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out; rows that
share an id are vectors of their own; a null id hashes as the empty text and stays null; seeds with equal hashes are
ordered by their components; with fewer vectors than centroids every vector is a seed; centroids that are equal leave all
their vectors to the smallest number; components are held to +-2**27 (x beyond +-524,288 counts as that), so that every
distance fits a long; an empty table gives no row; columns other than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

K, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Columns of a shard, and vectors of a chunk at most.
SHARD_COLUMNS, CHUNK_ROWS = 16, 1024
LIMIT = 1 << 27
#: Below it, 16 products of components and their sums are exact in double precision.
EXACT = 1 << 24


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of the right length without null or non-finite components, as integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * x.cast("double")))).cast("int"))
    return vectors.where((F.size("embedding") == dimensions) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hashes of seed and id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(key, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def column_blocks(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(chunk, shard, rows, ids, block), stored: a chunk's vectors by shards of columns; the ids stand with the first shard."""
    shards = [(i, at, min(at + SHARD_COLUMNS, dimensions)) for i, at in enumerate(range(0, dimensions, SHARD_COLUMNS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = batch.column("v").flatten().to_numpy().astype("<i4").reshape(-1, dimensions)
            for at in range(0, len(matrix), CHUNK_ROWS):
                some = matrix[at : at + CHUNK_ROWS]
                ids = batch.column("vec_id")[at : at + CHUNK_ROWS].to_pylist()
                rows = {"shard": [i for i, _, _ in shards], "rows": [len(some)] * len(shards), "ids": [ids if i == 0 else None for i, _, _ in shards], "block": [some[:, a:b].tobytes() for _, a, b in shards]}
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("shard", pa.int32()), ("rows", pa.int32()), ("ids", pa.list_(pa.int64())), ("block", pa.binary())]))

    rows = vectors.mapInArrow(run, "shard int, rows int, ids array<long>, block binary")
    # The shards of a chunk come one after the other in a partition, so their numbers differ by less than their count.
    numbered = rows.select((F.monotonically_increasing_id() - F.col("shard")).alias("chunk"), "*")
    return cut(numbered, "vector-blocks")


def partial_distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two integer matrices of the same columns."""
    block, centroids = block.astype(np.int64), centroids.astype(np.int64)
    if max(np.abs(block).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT and block.shape[1] <= SHARD_COLUMNS:
        products = (block.astype(np.float64) @ centroids.astype(np.float64).T).astype(np.int64)
        return (block**2).sum(axis=1)[:, None] - 2 * products + (centroids**2).sum(axis=1)[None, :]
    return np.stack([((block - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def cluster_sums(block: np.ndarray, clusters: np.ndarray, k: int) -> np.ndarray:
    """(k, columns) sums of a block's rows by cluster."""
    out = np.zeros((k, block.shape[1]), dtype=np.int64)
    np.add.at(out, clusters, block.astype(np.int64))
    return out


class ShardedLloyd:
    """Lloyd's rounds over a table of column blocks."""

    def __init__(self, blocks: DataFrame, centroids: np.ndarray):
        self.context = blocks.sparkSession.sparkContext
        self.k, self.shards = len(centroids), -(-centroids.shape[1] // SHARD_COLUMNS)
        self.slices = {i: centroids[:, i * SHARD_COLUMNS : (i + 1) * SHARD_COLUMNS] for i in range(self.shards)}
        self.parts = max(shuffle_partitions(blocks.sparkSession), blocks.rdd.getNumPartitions())
        read = blocks.select("chunk", "shard", "rows", "block").rdd.map(lambda r: ((r["chunk"], r["shard"]), np.frombuffer(bytes(r["block"]), "<i4").reshape(r["rows"], -1)))
        # Dealt out once; every round reads the same shuffled blocks.
        self.blocks: RDD = read.partitionBy(self.parts, _place)

    def distances(self) -> RDD:
        """(chunk, (cluster, distance) arrays): blocks give partial distances, which are added by chunk."""
        slices = self.context.broadcast(self.slices)  # k x d integers
        partial = self.blocks.map(lambda b: (b[0][0], partial_distances(b[1], slices.value[b[0][1]])))
        return partial.reduceByKey(lambda a, b: a + b, self.parts, _place).mapValues(_nearest)

    def step(self) -> None:
        """One round: assign, then every shard makes its own slice of the centroids from its own columns."""
        k, shards = self.k, self.shards
        slices = self.context.broadcast(self.slices)
        clusters = self.distances().flatMap(lambda c: [((c[0], s), c[1][0]) for s in range(shards)])

        def added(pairs: Iterator) -> Iterator:
            """Sums and counts of a partition for each shard that it holds."""
            found: dict[int, list[np.ndarray]] = {}
            for (_, shard), (block, nearest) in pairs:
                sums, counts = cluster_sums(block, nearest, k), np.bincount(nearest, minlength=k)
                if shard in found:
                    found[shard][0] += sums
                    found[shard][1] += counts
                else:
                    found[shard] = [sums, counts]
            # As Python integers, so that sums over all partitions stay exact at any number of vectors.
            return iter((s, (sums.astype(object), counts.astype(object))) for s, (sums, counts) in found.items())

        def moved(item: tuple) -> tuple[int, np.ndarray]:
            shard, (sums, counts) = item
            new = [[x // n for x in row] if n else old for row, n, old in zip(sums.tolist(), counts.tolist(), slices.value[shard].tolist(), strict=True)]
            return shard, np.array(new, dtype=np.int64)

        both = self.blocks.join(clusters.partitionBy(self.parts, _place))
        sums = both.mapPartitions(added).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), shards)
        self.slices |= dict(sums.map(moved).collect())  # k x d integers in all

    def centroids(self) -> np.ndarray:
        return np.concatenate([self.slices[s] for s in range(self.shards)], axis=1)


def _place(key: int | tuple[int, int]) -> int:
    """Partition of a chunk or of a block: neighbours, and the shards of a chunk, are in different tasks."""
    return hash((key,))


def _nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return distances.argmin(axis=1).astype(np.int32), distances.min(axis=1)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector of (ids, cluster, distance) of chunks."""
    for batch in batches:
        for ids, cluster, distance in zip(*(batch.column(c) for c in ("ids", "cluster", "distance")), strict=True):
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(cluster.as_py(), "<i4")), pa.array(np.frombuffer(distance.as_py(), "<i8"))], ["vec_id", "cluster", "distance"])


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, *, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``OUT`` for every usable row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dimensions, scale)
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], OUT)
    blocks = column_blocks(whole, dimensions)
    lloyd = ShardedLloyd(blocks, centroids)
    for _ in range(rounds):
        lloyd.step()
    stored = lloyd.distances().map(lambda c: (c[0], bytearray(c[1][0].astype("<i4").tobytes()), bytearray(c[1][1].astype("<i8").tobytes())))
    assigned = spark.createDataFrame(stored, "chunk long, cluster binary, distance binary").join(blocks.where("shard = 0").select("chunk", "ids"), "chunk")
    rows = cut(assigned.select("ids", "cluster", "distance").mapInArrow(_unpacked, "vec_id long, cluster int, distance long"), "vector-clusters")
    # One row a cluster: at most k.
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    final = lloyd.centroids()
    about = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, final[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    known = spark.createDataFrame(pd.DataFrame(about, columns=["cluster", "cluster_inertia", "inertia", "centroid_sha256"]), "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql() -> str:
    """The rounds one after the other: c0 are the seeds, a0 the first assignment, c1 the centroids after a round, and so on."""
    parts = []
    for r in range(ROUNDS + 1):
        parts.append(f"""
d{r} AS (SELECT row_id, cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(kept.v, c{r}.v)])::bigint AS distance FROM kept, c{r}),
a{r} AS (SELECT row_id, cluster, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, cluster) = 1)""")
        if r < ROUNDS:
            parts.append(f"""
s{r} AS (SELECT cluster, i, sum(x)::bigint AS s, count(*)::bigint AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {DIMENSIONS} + 1)) AS i FROM a{r} JOIN kept USING (row_id)) GROUP BY cluster, i),
c{r + 1} AS (SELECT c{r}.cluster, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY cluster) m USING (cluster))""")
    return ",".join(parts)


SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS row_id, vec_id, [floor({SCALE} * x::double)::bigint FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIMENSIONS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::varchar, '')), v) - 1 AS cluster, v FROM kept ORDER BY cluster LIMIT {K}),{_rounds_sql()}
SELECT vec_id, cluster::int AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::bigint AS cluster_inertia, (sum(distance) OVER ())::bigint AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (row_id) JOIN c{ROUNDS} USING (cluster)
"""
