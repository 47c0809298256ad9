"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words. A document of a source is to be taken target / source size times on average;
the whole part is taken for certain and the rest is a fractional copy. Fractional copies are paired, and words are moved
at random from one to the other until one of the two is integral: the words taken in a pair never change, and each
copy's expectation stays what it was. Within a chunk of a source this leaves one fractional copy at most; the left-over
copies of the chunks are paired in turn in a reduction tree, until each source has one, which is rounded to the nearer
number. So a source misses its target by half a document at most.

Defined results: a null text has size 0; a document of size 0 is rounded on its own by its fraction, as it cannot move
words; the null source is one source, after all others; rows are told apart by id and text, and rows equal in both by a
number, so that repeats of a row are spread over the chunks like other rows; an empty table gives an empty result; columns other than the id,
the text and the source are not read. Reruns give the same result: all chance comes from hashes of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, documents, new_names

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents in a chunk, about; left-over copies that meet in one step of the tree; bytes of targets up to which they are broadcast.
CHUNK, FANIN, BROADCAST_BYTES = 4_000, 256, 8 << 20
KEYS = ["part", "chunk"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """(source, size, n, part): ``part`` counts the sources from 0 by code point, null last. Ranges are sorted each on its own."""
    ranges = cut(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id()), "mix-ranges")
    within = W.partitionBy("range").orderBy(F.asc_nulls_last("source"))
    # One row a range, of which there are as many as shuffle partitions.
    before = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("rows")).withColumn("before", F.sum("rows").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)))
    placed = ranges.withColumn("place", F.row_number().over(within)).join(before.select("range", F.coalesce("before", F.lit(0)).alias("before")), "range")
    return placed.select("source", "size", "n", (F.col("before") + F.col("place") - 1).alias("part"))


def shared_out(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, size, n, part, target): ``share`` of all words by weight, none above ``most`` times its size.

    Each round takes the sources that would be above out and shares what they leave among the others; once out, a source
    stays out, as the others' shares only grow. The driver sees three sums a round."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("part") % len(weights) + 1).cast("int"))
    rows = cut(sources.withColumn("weight", weight), "mix-sources")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,12)"))
    filled = rows.where("size > 0")
    total = filled.agg(F.count(F.lit(1)).alias("n"), exact("weight").alias("weight"), F.sum("size").alias("size")).first()
    free, left, n_out = float(total["weight"] or 0), share * (total["size"] or 0), 0
    out = F.lit(False)
    while free > 0:
        out = F.col("weight") / F.lit(free) * F.lit(left) > F.lit(float(most)) * F.col("size")
        gone = filled.where(out).agg(F.count(F.lit(1)).alias("n"), exact("weight").alias("weight"), F.sum("size").alias("size")).first()
        if gone["n"] == n_out:
            break
        n_out, free, left = gone["n"], float(total["weight"] - gone["weight"]), share * total["size"] - most * gone["size"]
    part = F.col("weight") / F.lit(free) * F.lit(left) if free > 0 else F.lit(float(most)) * F.col("size")
    target = F.when(F.col("size") <= 0, 0.0).when(out, F.lit(float(most)) * F.col("size")).otherwise(part)
    return rows.select("source", "size", "n", "part", target.alias("target"))


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, part, source_size, target, chunks) of (source, size, n), where a row stands for n equal ones."""
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n"))
    targets = shared_out(numbered(found), weights, share, most)
    return cut(targets.select("source", "part", F.col("size").alias("source_size"), "target", F.ceil(F.col("n") / CHUNK).alias("chunks")), "mix-targets")


def small_enough(targets: DataFrame) -> DataFrame:
    """Broadcast up to a number of bytes; beyond it, an ordinary join."""
    about = targets.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    return F.broadcast(targets) if about <= BROADCAST_BYTES else targets


def pivotal(share: np.ndarray, size: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, int]:
    """Move words between fractional copies in order; returns copies, and the place of the one still fractional or -1.

    ``share``: fractions from 0 to 1; ``chance``: a number from 0 to 1 for each row."""
    x, held = share.astype(float).copy(), -1
    for i in range(len(x)):
        if size[i] <= 0:
            x[i] = float(chance[i] < x[i])
            continue
        if not 0 < x[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b, sa, sb = x[held], x[i], size[held], size[i]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        give_up = chance[i] * (up + down) < down
        moved = up if give_up else -down
        full_a = moved == (1 - a) * sa if give_up else -moved == a * sa
        a, b = a + moved / sa, b - moved / sb
        if full_a:
            x[held], x[i], held = round(a), b, i
        else:
            x[held], x[i] = a, round(b)
        if not 1e-12 < x[held] < 1 - 1e-12:
            x[held], held = round(x[held]), -1
    return x, held


ROW = "part long, chunk long, doc_key long, order_key long, doc_id long, size long, whole long, share double, settled boolean"


def _level(level: int):
    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: a left-over copy then wanders in ever smaller steps, and what is left last is small.
        rows = rows.sort_values(["size", "order_key", "doc_key"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        mixed = (rows["order_key"].to_numpy().astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        chance = (mixed >> np.uint64(11)).astype(float) / 2**53
        share, held = pivotal(rows["share"].to_numpy(), rows["size"].to_numpy(), chance)
        settled = np.ones(len(rows), dtype=bool)
        if held >= 0:
            settled[held] = False
        return rows.assign(share=share, settled=settled)

    return run


def dependent_rounding(units: DataFrame, most_chunks: int) -> DataFrame:
    """(part, doc_key, doc_id, size, copies): settle every row of ``units`` (columns of ROW)."""
    done, level = None, 0
    rows = units
    while True:
        rows = cut(rows.groupBy(*KEYS).applyInPandas(_level(level), ROW), "mix")
        settled, left = rows.where("settled"), rows.where("not settled")
        done = settled if done is None else done.unionByName(settled)
        if most_chunks <= 1:
            break
        most_chunks, level = -(-most_chunks // FANIN), level + 1
        rows = left.withColumn("chunk", F.expr(f"chunk div {FANIN}"))
    done = done.unionByName(left.withColumn("share", F.round("share")))
    return done.select("part", "doc_key", "doc_id", "size", (F.col("whole") + F.col("share").cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) of every row of (doc_id, text, source)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("doc_key"))
    rows = cut(own.groupBy("doc_id", "source", "size", "doc_key").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    targets = source_targets(rows, weights, share, most)
    most_chunks = targets.agg(F.max("chunks")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    side = small_enough(targets)
    each = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    # A random order within a source, the same in every run, which also chooses the chunk.
    units = each.join(side, each["source"].eqNullSafe(side["source"])).select(
        "part",
        F.pmod(F.xxhash64("doc_key", "repeat", F.lit(7)), F.col("chunks")).alias("chunk"),
        "doc_key",
        F.xxhash64("doc_key", "repeat", F.lit(11)).alias("order_key"),
        "doc_id",
        "size",
        F.floor(rate).alias("whole"),
        (rate - F.floor(rate)).alias("share"),
        F.lit(False).alias("settled"),
    )
    copies = dependent_rounding(units, most_chunks)
    return copies.join(side, "part").select("doc_id", "doc_key", "size", "source", "source_size", "target", "copies")


def take_mixture(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: every row of ``docs`` with all its columns, as often as it is taken.

    Rows equal in id and text are repeats of one row: together they appear as often as they are taken together."""
    *key, copies, times, copy = new_names(docs, "__id", "__key", "__copies", "__rows", "__copy")
    keyed = docs.withColumn(key[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(key[1], F.xxhash64("doc_id", "text"))
    mixed = mix(docs, **how).groupBy(F.coalesce("doc_id", F.lit(-1)).alias(key[0]), F.col("doc_key").alias(key[1]))
    taken = cut(mixed.agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(times)), "mix-taken").where(F.col(copies) > 0)
    once = keyed.join(taken.where(F.col(times) == 1), key)
    repeated = keyed.join(taken.where(F.col(times) > 1), key).dropDuplicates(key)
    every = once.unionByName(repeated).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return every.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
