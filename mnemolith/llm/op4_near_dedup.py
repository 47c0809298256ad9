"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation, components.

A document's set is its distinct runs of five words. Documents are linked if intersection / union of their sets reaches
the threshold; a component is what links reach.

1. Equal sets become one node, so copies are never paired. Every node gets a MinHash signature.
2. Bands of the signature put nodes into buckets. Nodes of a small bucket are paired with each other; in a large one each
   is paired only with the bucket's centre, the node that is in the most large buckets.
3. A pair's signatures are compared batch by batch. With m of n positions equal and a uniform prior, the similarity has
   a Beta(m + 1, n - m + 1) posterior; the pair is dropped once the posterior chance of reaching the threshold is below
   ``MISS``. Survivors are confirmed on their full sets.
4. What the centres missed is settled by differences. Large buckets that share nodes make a family, and a family gets a
   core: the shingles that most of a few of its members have. A member's difference D is what it lacks of the core or has
   besides. With S = (100 + t) |D| - (100 - t) n, two members of n and n' shingles reach t per cent if and only if
   S + S' <= 2 (100 + t) |D and D'|. So all whose S and the family's least S sum to 0 or less are linked to the member
   that has the least, members with too few elements that any other has too can't be linked, and families whose other
   members all are in one component are done. For the rest:
   a. The differences of a linked pair are alike, the more so the longer they are: with s = (|D| + |D'|) / (n + n') and
      f = (100 - t) / (100 + t) they overlap by (s - f) / (s + f) at least, while those of unlinked members, being rid
      of what all have in common, hardly overlap. So bands of MinHash values of the differences find the pairs; there
      is a level of bands for each range of s, with as many bands as the least overlap of the range needs. A pair that
      shares a band is still left out, within the join, if one-bit sketches of the differences rule its overlap out.
   b. Pairs of so short differences that even (a) would need too many bands are joined on the elements themselves.
   Only pairs of different components count in either, and those found go through step 3 like all others. Any core gives
   right results; a good one short differences.
5. Components come from alternating star operations on the link table.

Chances of a miss: a pair at the threshold shares no band with a chance of 3e-7 (26 bands of 5), or no band of differences
or by their sketches with a chance of ``LEVEL_MISS`` each, and is pruned with a chance of about ``MISS``.

Defined results: null and blank texts have an empty set and are their own component; fewer than five words are one
shingle; ids may be null: a component's id is the smallest that is not null, and a null id is kept only if its component
has no other; rows that share an id are one document; an empty table gives an empty result; columns other than the id
and the text are not read by ``near_components``, and passed through by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, inf, lgamma, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, new_names, shuffle_partitions
from .components import connected
from .word_cache import WordCache

WORDS, THRESHOLD = 5, 85  # per cent
BANDS, ROWS = 26, 5
HASHES = BANDS * ROWS
MISS = 1e-7
BATCH = 26
#: Nodes of a bucket up to which all its pairs are compared; members that a family's core is made from.
SMALL_BUCKET, CORE_SAMPLE = 24, 64
#: Bands over differences: rows of a band, and the least overlap of differences that it is for; chance that a pair with this overlap shares none.
LEVELS, LEVEL_MISS = ((5, 0.58), (4, 0.50), (3, 0.42), (3, 0.36), (2, 0.30)), 1e-6
#: Longs of a one-bit sketch of a difference, and standard deviations by which its unequal bits may exceed what is expected.
SKETCH, SPREAD = 8, 5.0

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
LEVEL_BANDS = [ceil(log(LEVEL_MISS) / log(1 - overlap**rows)) for rows, overlap in LEVELS]
LEVEL_FACTORS = _rng.integers(0, 1 << 63, max(b * r for b, (r, _) in zip(LEVEL_BANDS, LEVELS, strict=True)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LEVEL_OFFSETS = _rng.integers(0, 1 << 63, len(LEVEL_FACTORS), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


class ShingleSets:
    """Sorted distinct 64-bit hashes of a text's runs of words."""

    def __init__(self, words: int = WORDS):
        self.n, self.known = words, WordCache(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = min(self.n, len(h))
        run = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            run = run * np.uint64(0xD1342543DE82EF95) + h[k : len(h) - n + 1 + k]
        return np.unique(mixed(run))


def signature(shingles: np.ndarray, factors: np.ndarray = FACTORS, offsets: np.ndarray = OFFSETS) -> np.ndarray:
    out, step = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32), max(1, (1 << 18) // len(factors))
    for at in range(0, len(shingles), step):
        part = shingles[at : at + step, None] * factors + offsets
        out = np.minimum(out, (part >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, seed: int = 0) -> np.ndarray:
    rows, keys = sig.astype(np.uint64).reshape(bands, -1), np.arange(bands, dtype=np.uint64) + np.uint64(seed)
    for k in range(rows.shape[1]):
        keys = mixed(keys * np.uint64(0xA24BAED4963EE407) + rows[:, k])
    return keys.astype(np.int64)


def beta_tail(a: int, b: int, x: float) -> float:
    """Chance that a Beta(a, b) variable with whole a, b exceeds x: at most a - 1 of a + b - 1 draws hit with chance x."""
    n = a + b - 1
    term = lambda k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(x) + (n - k) * log(1 - x)
    return sum(exp(term(k)) for k in range(a))


@lru_cache
def least_matches(threshold: int, miss: float) -> tuple[int, ...]:
    """For each number of batches compared, the matches below which a pair is pruned."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        out.append(next(m for m in range(n + 1) if beta_tail(m + 1, n - m + 1, threshold / 100) >= miss))
    return tuple(out)


def text_key(docs: DataFrame) -> Column:
    """128 bits of the text; with the id it names a row, as an id alone need not: it may be null or shared."""
    return F.unhex(F.md5(docs["text"].cast("binary")))


def nodes_of(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, sig, bands); node is a 128-bit hash of the set, null for an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = ShingleSets(words)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = sets(text)
                if len(s):
                    sig = signature(s)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), sig.tobytes(), band_keys(sig)))
                else:
                    rows.append((0, None, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "node", "sig", "bands"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            out.insert(1, "text_key", batch["text_key"].to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("text_key"), F.col("text").alias("text")).mapInPandas(run, "doc_id long, text_key binary, n_shingles long, node binary, sig binary, bands array<long>")


def verified_by_signature(pairs: DataFrame, nodes: DataFrame, threshold: int, miss: float) -> DataFrame:
    """(a, b): pairs that no batch of signature positions rules out."""
    need = least_matches(threshold, miss)

    @F.pandas_udf("boolean")
    def plausible(a: pd.Series, b: pd.Series) -> pd.Series:
        if a.empty:
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(map(bytes, s)), np.uint32).reshape(-1, HASHES) for s in (a, b))
        left, matches = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for k, least in enumerate(need):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches[left] += (x[left, part] == y[left, part]).sum(axis=1)
            left = left[matches[left] >= least]
        out = np.zeros(len(x), dtype=bool)
        out[left] = True
        return pd.Series(out)

    sigs = nodes.select("node", "sig")
    a, b = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(a, "a").join(b, "b").where(plausible("sig_a", "sig_b")).select("a", "b")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the documents in ``wanted`` (node, doc_id, text_key)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = ShingleSets(words)
        for batch in batches:
            found = [sets(t) for t in batch["text"]]
            node = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
            same = np.array([bytes(w) == n for w, n in zip(batch["node"], node, strict=True)], dtype=bool)
            yield pd.DataFrame({"node": node, "shingles": [s.astype(np.int64) for s in found]})[same]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("text_key"), F.col("text").alias("text"))
    same_row = F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("text_key") == F.col("w_key"))
    return texts.join(wanted.select(F.col("doc_id").alias("w"), F.col("text_key").alias("w_key"), "node"), same_row).select("node", "text").mapInPandas(run, "node binary, shingles array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): pairs whose full sets reach the threshold."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        both = ((len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in zip(a, b, strict=True))
        return pd.Series([100 * i >= threshold * (n - i) for i, n in both], dtype=bool)

    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").where(linked("set_a", "set_b")).select("a", "b")


def differences(sets: DataFrame, families: DataFrame, threshold: int) -> DataFrame:
    """(node, fam, d, n, m, s) of every member of (node, fam): its difference from the family's core, the size of its set, how
    many elements of the difference another member has too, and its S."""
    sizes = families.groupBy("fam").agg(F.count(F.lit(1)).alias("size"))
    few = families.join(sizes, "fam").where(F.pmod(F.xxhash64("node"), F.col("size")) < CORE_SAMPLE).select("node", "fam")
    held = few.join(sets, "node").select("fam", F.explode("shingles").alias("e")).groupBy("fam", "e").agg(F.count(F.lit(1)).alias("holders"))
    half = few.groupBy("fam").agg((F.count(F.lit(1)) / 2).alias("half"))
    core = held.join(half, "fam").where("holders > half").groupBy("fam").agg(F.collect_list("e").alias("core"))
    none = F.array().cast("array<long>")
    members = sets.join(families, "node").join(core, "fam", "left")
    apart = cut(members.select("node", "fam", F.size("shingles").alias("n"), F.array_except(F.coalesce("core", none), "shingles").alias("lacks"), F.array_except("shingles", F.coalesce("core", none)).alias("has")), "differences")
    alone = apart.select("node", "fam", F.explode("has").alias("e")).groupBy("fam", "e").agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("node")).where("holders = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    size = F.size("lacks") + F.size("has")
    # An element that is lacking and one that is there besides never are the same, so both can be in one array.
    return apart.join(alone, "node", "left").select("node", "fam", F.concat("lacks", "has").alias("d"), "n", (size - F.coalesce("u", F.lit(0))).alias("m"), ((100 + threshold) * size - (100 - threshold) * F.col("n")).cast("long").alias("s"))


def level_ranges(threshold: int) -> list[tuple[float, float]]:
    """For each level the range of (|D| + |D'|) / (n + n') that it is for."""
    f, high, out = (100 - threshold) / (100 + threshold), inf, []
    for _, overlap in LEVELS:
        low = f * (1 + overlap) / (1 - overlap)
        out.append((low, high))
        high = low
    return out


def reach(d: int, n: int, least: float, threshold: int) -> tuple[float, float]:
    """The least and the largest (|D| + |D'|) / (n + n') of a node with any node that it can be linked to, where no |D'| / n' is below ``least``."""
    f, t = (100 - threshold) / (100 + threshold), threshold / 100
    with_least = min((d + least * other) / (n + other) for other in (n * t, n / t))
    return max(2 * d / (n * (1 + 1 / t)) - f, with_least), 2 * d / (n * (1 + t)) + f


def difference_keys(members: DataFrame, threshold: int) -> DataFrame:
    """(key, node, n, low, root): keys of the bands of each node's difference, at every level that a pair of the node's may be on.

    In a pair of a level, one node at least is low: its own share of differences is below the level's upper bound."""
    ranges = level_ranges(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, fam, d, n, share, root in zip(batch["node"], batch["fam"], batch["d"], batch["n"], batch["share"], batch["root"], strict=True):
                sig = signature(np.asarray(d, dtype=np.int64).astype(np.uint64), LEVEL_FACTORS, LEVEL_OFFSETS)
                least, most = reach(len(d), n, share, threshold)
                for level, ((rows, _), bands, (low, high)) in enumerate(zip(LEVELS, LEVEL_BANDS, ranges, strict=True)):
                    if least < high and most >= low:
                        keys = band_keys(sig[: bands * rows], bands, xxhash.xxh3_64_intdigest(bytes(fam), seed=level) >> 1)
                        yield pd.DataFrame({"key": keys, "node": [bytes(node)] * bands, "n": n, "low": len(d) < high * n, "root": root})

    # Nodes of one family lie together; they are dealt out evenly before the work on each.
    rows = members.select("node", "fam", "d", "n", "share", F.xxhash64("root").alias("root")).repartition(shuffle_partitions(members.sparkSession))
    return rows.mapInPandas(run, "key long, node binary, n int, low boolean, root long")


def sketched(members: DataFrame) -> DataFrame:
    """(node, size, k0, k1, ..): the size of each node's difference, and a bit of each of its first MinHash values."""
    names = [f"k{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = [signature(np.asarray(d, dtype=np.int64).astype(np.uint64), LEVEL_FACTORS[: 64 * SKETCH], LEVEL_OFFSETS[: 64 * SKETCH]) & 1 for d in batch["d"]]
            words = np.packbits(np.array(bits, dtype=np.uint8).reshape(-1, 64 * SKETCH), axis=1).view(np.int64)
            yield pd.DataFrame({"node": batch["node"], "size": [len(d) for d in batch["d"]]} | {c: words[:, i] for i, c in enumerate(names)})

    return members.select("node", "d").repartition(shuffle_partitions(members.sparkSession)).mapInPandas(run, "node binary, size int, " + ", ".join(f"{c} long" for c in names)).dropDuplicates(["node"])


def alike_sketches(threshold: int) -> Column:
    """Whether two sketches (columns with and without a 2) leave it possible that the differences overlap as much as those of a linked pair."""
    f = (100 - threshold) / (100 + threshold)
    share = (F.col("size") + F.col("size2")) / (F.col("n") + F.col("n2"))
    unequal = F.greatest(F.lit(0.0), 1 - (share - f) / (share + f)) / 2
    most = 64 * SKETCH * unequal + SPREAD * F.sqrt(64 * SKETCH * unequal * (1 - unequal))
    return sum((F.bit_count(F.col(f"k{i}").bitwiseXOR(F.col(f"k{i}2"))) for i in range(SKETCH)), F.lit(0)) <= most


def across(rows: DataFrame, on: list[str], threshold: int, possible: Column, more: DataFrame | None = None) -> DataFrame:
    """Pairs of nodes with equal ``on`` whose roots differ, of which one at least is low, and that are ``possible``.

    The columns of the second have a 2 behind their names; those of ``more`` (node, ..) are there too."""
    mixed = rows.groupBy(*on).agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.max("low").alias("any_low")).where("r1 <> r2 and any_low").select(*on)
    met = rows.join(mixed, on)
    met = cut(met if more is None else met.join(more, "node"), "met")
    other = met.select(*on, *[F.col(c).alias(f"{c}2") for c in met.columns if c not in on])
    near_size = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * threshold
    return met.where("low").join(other, on).where((F.col("root") != F.col("root2")) & (~F.col("low2") | (F.col("node") < F.col("node2"))) & near_size & possible)


def family_links(found: DataFrame, sets: DataFrame, families: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of links that need no comparison, and (a, b) of pairs that may be linked: both hold all that connect members of a family."""
    apart = cut(differences(sets, families, threshold), "apart")
    least = apart.groupBy("fam").agg(F.min(F.struct("s", "node")).alias("l")).select("fam", F.col("l.s").alias("least"), F.col("l.node").alias("near"))
    placed = apart.join(least, "fam")
    pair = (F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
    sure = placed.where("node <> near and s + least <= 0").select("node", F.col("near").alias("node2")).select(*pair)
    roots = connected(found.unionByName(sure))
    unit = 2 * (100 + threshold)
    open_nodes = placed.where(F.col("s") + F.col("least") <= unit * F.col("m")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart_still = open_nodes.groupBy("fam").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min(F.size("d") / F.col("n")).alias("share")).where("r1 <> r2").select("fam", "share")
    members = cut(open_nodes.join(apart_still, "fam").select("node", "fam", "d", "n", "m", "s", "root", "share"), "open")
    banded = across(difference_keys(members, threshold), ["key"], threshold, alike_sketches(threshold), sketched(members)).select(*pair)
    low = level_ranges(threshold)[-1][0]
    f, t = (100 - threshold) / (100 + threshold), threshold / 100
    short = members.where(2 * F.size("d") / (F.col("n") * (1 + 1 / t)) - f < low)
    elements = short.select("fam", F.explode("d").alias("e"), "node", "n", "m", "s", (F.size("d") < low * F.col("n")).alias("low"), F.xxhash64("root").alias("root"))
    joined = across(elements, ["fam", "e"], threshold, F.col("s") + F.col("s2") <= unit * F.least("m", "m2"))
    counted = joined.groupBy("node", "node2").agg(F.count(F.lit(1)).alias("common"), F.first(F.col("s") + F.col("s2")).alias("need")).where(F.col("need") <= unit * F.col("common"))
    return sure, banded.unionByName(counted.select(*pair)).distinct()


def links(docs: DataFrame, nodes: DataFrame, *, words: int, threshold: int, miss: float) -> DataFrame:
    """(a, b): links that connect all nodes that any links connect."""
    banded = cut(nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key")), "bands")
    size = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut(banded.join(size, ["band", "key"]), "shared-bands")
    small, large = shared.where(F.col("size") <= SMALL_BUCKET), shared.where(F.col("size") > SMALL_BUCKET)
    other = small.select("band", "key", F.col("node").alias("b"), F.col("n_shingles").alias("n2"))
    near_size = (F.least("n_shingles", "n2") * 100 >= F.greatest("n_shingles", "n2") * threshold)
    pairs = small.withColumnRenamed("node", "a").join(other, ["band", "key"]).where((F.col("a") < F.col("b")) & near_size).select("a", "b")
    degree = large.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    members = large.join(degree, "node")
    centre = members.groupBy("band", "key").agg(F.max(F.struct("degree", "node"))["node"].alias("c"))
    spokes = members.join(centre, ["band", "key"]).where("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
    survivors = cut(verified_by_signature(pairs.unionByName(spokes).distinct(), nodes, threshold, miss), "survivors")
    wanted = survivors.select(F.col("a").alias("node")).unionByName(survivors.select(F.col("b").alias("node"))).unionByName(degree.select("node")).distinct()
    sets = cut(sets_of(docs, nodes.select("node", "doc_id", "text_key").join(wanted, "node"), words), "sets")
    found = cut(confirmed(survivors, sets, threshold), "links")
    if large.isEmpty():
        return found
    families = cut(connected(spokes.distinct()).withColumnRenamed("root", "fam"), "families")
    sure, rest = family_links(found, sets, families, threshold)
    more = cut(verified_by_signature(rest, nodes, threshold, miss), "family-survivors")
    return found.unionByName(sure).unionByName(confirmed(more, sets, threshold))


def placed_rows(docs: DataFrame, words: int, threshold: int, miss: float) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of every row."""
    rows = cut(nodes_of(docs, words), "shingled")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    found = rows.where("node is not null").groupBy("node").agg(one.alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(found.select("node", "one.doc_id", "one.text_key", "n_shingles", "sig", "bands", "copies"), "nodes")
    roots = connected(links(docs, nodes, words=words, threshold=threshold, miss=miss))
    placed = nodes.select("node", "doc_id", "copies").join(roots, "node", "left")
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    grouped = placed.where("root is not null or copies > 1").join(least, "root", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"), F.lit(True).alias("grouped"))
    out = rows.select("doc_id", "text_key", "n_shingles", "node").join(grouped, "node", "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_components(docs: DataFrame, *, words: int = WORDS, threshold: int = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return placed_rows(docs, words, threshold, miss).drop("text_key")


def keep_one(docs: DataFrame, *, words: int = WORDS, threshold: int = THRESHOLD, miss: float = MISS) -> DataFrame:
    """The rows of ``docs`` that ``near_components`` keeps: ids may be null or shared, so a row goes by its id and its text."""
    of, key = new_names(docs, "__gone", "__gone_key")
    gone = placed_rows(docs, words, threshold, miss).where("not kept").select(F.col("doc_id").alias(of), F.col("text_key").alias(key)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(of)) & text_key(docs).eqNullSafe(F.col(key)), "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 85 * (m.n + n.n - count(*))
), reached AS (
  WITH RECURSIVE walk(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT w.x, l.y FROM walk w JOIN links l ON w.y = l.x)
  SELECT x AS doc_id, min(y) AS component_id FROM walk GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
