"""SimHash fingerprints of documents and a search for all fingerprints within a Hamming radius; DataFrame functions only.

Terms are runs of three words (shorter ones at the end of a text), lower-cased. Each occurrence of a term votes, with
the bytes of its first word as weight, on the 64 bits of the term's hash: a bit of the fingerprint is set if more than
half of the weight has it set. The votes on two bits are summed in one 64-bit number, 32 bits each, which cannot
overflow as a text has less than 2**31 bytes. Likeness is 1 minus the share of bits that differ.

The search cuts fingerprints into blocks. Of radius + extra blocks, at least ``extra`` agree in full between fingerprints
within the radius, so a table for each choice of ``extra`` blocks, joined on those bits, finds every such pair; a pair is
counted in the first table that has it.

Defined results: a null text counts as empty, and its fingerprint is 0, as is that of white space alone; the next
document is the next row by id, null ids first, rows of one id by text, and after the last row comes the first; a lone
row is its own next; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket_of, cut, documents, order_bounds, shuffle_partitions

RADIUS, EXTRA_BLOCKS = 3, 2
SPACES = r"[\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
FIELD = 1 << 32
PAIRS = [f"v{b}" for b in range(32)]


def votes(term_hash: Column, weight: Column) -> list[Column]:
    """For b below 32 the weight of bit b in the low half and of bit b + 32 in the high half."""
    return [((F.shiftright(term_hash, b).bitwiseAND(1) + F.shiftright(term_hash, b + 32).bitwiseAND(1) * FIELD) * weight).alias(f"v{b}") for b in range(32)]


def fingerprints(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys..., fp) of every row; ``keys`` tell rows apart. Terms are counted where the row lies, then one row a document is shuffled."""
    words = rows.withColumn("__w", F.split(F.lower(F.btrim(F.col(text), F.lit(BLANKS))), SPACES))
    shifted = [F.slice(F.col("__w"), F.lit(k), F.greatest(F.size("__w") - (k - 1), F.lit(0))) for k in (2, 3)]
    terms = words.select(*keys, F.explode(F.arrays_zip(F.col("__w").alias("a"), shifted[0].alias("b"), shifted[1].alias("c"))).alias("t"))
    weight = F.octet_length("t.a").cast("long")
    counted = terms.select(*keys, weight.alias("w"), *votes(F.xxhash64("t.a", "t.b", "t.c"), weight)).groupBy(*keys).agg(F.sum("w").alias("w"), *[F.sum(v).alias(v) for v in PAIRS])
    low = [F.when(F.col(v).bitwiseAND(FIELD - 1) * 2 > F.col("w"), F.lit(1 << b)).otherwise(F.lit(0).cast("long")) for b, v in enumerate(PAIRS)]
    high = [F.when(F.shiftrightunsigned(F.col(v), 32) * 2 > F.col("w"), F.lit((1 << b + 32) - (1 << 64 if b == 31 else 0))).otherwise(F.lit(0).cast("long")) for b, v in enumerate(PAIRS)]
    fp = F.lit(0).cast("long")
    for bit in (*low, *high):
        fp = fp.bitwiseOR(bit)
    return counted.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def block_masks(radius: int, extra: int) -> list[int]:
    """Bits of each table: every choice of ``extra`` of radius + extra blocks."""
    n = radius + extra
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    return [sum(c) for c in combinations(blocks, extra)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, extra: int = EXTRA_BLOCKS) -> DataFrame:
    """(fp, near): for every distinct ``fp`` of ``queries``, the sum of ``n`` over the fingerprints (fp, n) of ``corpus`` within the radius.

    ``corpus`` has distinct fingerprints, so copies count without being paired."""
    masks = [signed(m) for m in block_masks(radius, extra)]
    keyed = lambda df, *more: df.select(F.col("fp"), *more, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))
    q, c = keyed(queries.select("fp").distinct()), keyed(corpus, "n").withColumnRenamed("fp", "other")
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    first = F.lit(True)
    for i, m in enumerate(masks):
        first = first & ((F.col("table") <= i) | (differ.bitwiseAND(F.lit(m)) != 0))
    return q.join(c, ["table", "key"]).where((F.bit_count(differ) <= radius) & first).groupBy("fp").agg(F.sum("n").alias("near"))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, place, copy, doc_id, text, next_text): rows of a range of ids in order; a ``copy`` is the first row of the next range, for what precedes it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bounds = order_bounds(rows, "doc_id", buckets)
    first = rows.select(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("m")).first()["m"]
    start = F.lit(None).cast("long") if first is None or not first["known"] else F.lit(first["doc_id"])
    last = len(bounds)
    # A range begins with the rows of its bound; they also end the range before. The very first rows end the last range.
    if bounds and first["known"] and bounds[0] == first["doc_id"]:
        bounds, last = bounds[1:], last - 1
    bucket = bucket_of(F.col("doc_id"), bounds)
    begins = F.array_contains(F.array(*[F.lit(b) for b in bounds]), F.col("doc_id")) if 0 < len(bounds) <= 256 else F.lit(False)
    if len(bounds) > 256:
        begins = bucket != bucket_of(F.col("doc_id") - 1, bounds)
    wraps = F.col("doc_id").eqNullSafe(start)
    spots = F.array(F.struct(bucket.alias("b"), F.lit(0).alias("copy")), F.when(F.coalesce(begins, F.lit(False)), F.struct((bucket - 1).alias("b"), F.lit(1).alias("copy"))), F.when(wraps, F.struct(F.lit(last).alias("b"), F.lit(2).alias("copy"))))
    placed = rows.select("doc_id", "text", F.explode(F.filter(spots, lambda s: s.isNotNull())).alias("s")).select("s.b", "s.copy", "doc_id", "text")
    order = W.partitionBy("bucket").orderBy("copy", F.asc_nulls_first("doc_id"), "text")
    return placed.withColumnRenamed("b", "bucket").withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))


def fingerprint_table(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    n = 4 * shuffle_partitions(docs.sparkSession)
    rows = with_next(docs, n)
    size = F.char_length("text")
    swap = F.floor(size / 4).cast("int")
    edited = F.concat(F.left(F.col("text"), size - swap), F.left(F.coalesce(F.col("next_text"), F.lit("")), swap))
    own = ["bucket", "place", "copy", "doc_id", "n_chars", "edited_sha256"]
    both = rows.withColumn("edited", edited).select("bucket", "place", "copy", "doc_id", size.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.when(F.col("copy") == 0, F.array("text", "edited")).otherwise(F.array("text"))).alias("kind", "body"))
    fps = fingerprints(both, "body", [*own, "kind"])
    paired = fps.groupBy(*own).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    order = W.partitionBy("bucket").orderBy("place")
    found = cut(paired.withColumn("next_fp", F.lead("fp").over(order)).where("copy = 0").drop("bucket", "place", "copy"), "fingerprints")
    near = within_radius(found.where("doc_id % 100 = 0"), found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), radius)
    as_hex = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return found.join(near, "fp", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex("fp").alias("fingerprint"),
        as_hex("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.col("near")).alias("n_within_radius"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_table(documents(spark, sf_dir))
