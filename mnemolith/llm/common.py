"""What the training-data operators share: table access, scratch tables, ordered buckets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Only a local session may leave it unset; it gets one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, so that later work starts from there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its letters' case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lit_array(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values]) if values else F.expr("cast(array() as array<bigint>)")


#: Bounds of one level of the bucket lookup; beyond it a second level is used.
FANOUT = 256


def order_bounds(df: DataFrame, id_col: str, n: int) -> list[int]:
    """At most ``n`` - 1 increasing ids of ``df`` that cut its rows into ranges of about equal counts.

    One aggregation; the driver gets only the bounds."""
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    found = df.select(F.percentile_approx(F.col(id_col).cast("long"), shares, max(10000, 20 * n)).alias("b")).first()
    return sorted(set(found["b"] or []))


def bucket_of(id_col: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the id, by one or two levels of comparisons; null ids are in bucket 0, before all others."""
    at_or_below = lambda array: F.size(F.filter(array, lambda b: b <= id_col))
    if len(bounds) <= FANOUT:
        found = at_or_below(lit_array(bounds))
    else:
        step = -(-len(bounds) // FANOUT)
        groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
        coarse = at_or_below(lit_array([g[0] for g in groups]))
        fine = F.element_at(F.array(*[lit_array(g) for g in groups]), F.greatest(coarse, F.lit(1)))
        found = F.greatest(coarse - 1, F.lit(0)) * step + at_or_below(fine)
    return F.when(id_col.isNull(), F.lit(0)).otherwise(found).cast("int")
