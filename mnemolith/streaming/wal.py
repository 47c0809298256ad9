"""A write-ahead log of capture work: latest state of every entry, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import WAL

MAX_RETRIES = 3
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def append_log(entries: DataFrame, path: str) -> None:
    """Add entries to a log of JSON lines."""
    entries.write.options(**TIMES).mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log, with their place in it as ``seq``; lines that can't be read are left out."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.schema(WAL).options(**TIMES).json(path).withColumn("seq", place).where("id is not null")


def latest(log: DataFrame) -> DataFrame:
    """The newest entry of every id; of entries equally new, the first written."""
    order = W.partitionBy("id").orderBy(F.desc("updated_at"), "seq")
    return log.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def replay(log: DataFrame) -> DataFrame:
    """Entries still to be worked on."""
    return latest(log).where(F.col("state").isin("pending", "processing"))


def compact(log: DataFrame) -> DataFrame:
    """Latest entries without those that are done."""
    return latest(log).where("state <> 'done'")


def status(log: DataFrame) -> DataFrame:
    return latest(log).agg(F.count_if(F.col("state").isin("pending", "processing")).alias("pending"), F.count_if(F.col("state") == "failed").alias("failed"))


def tombstones(entries: DataFrame, state: str, when) -> DataFrame:
    """Log lines that end entries: only id, state and time, the rest blank."""
    known = {"id": F.col("id"), "state": F.lit(state), "updated_at": F.lit(when)}
    return entries.select(*[known.get(c, F.lit(None).cast(entries.schema[c].dataType)).alias(c) for c in entries.columns])


def after_attempt(entries: DataFrame, worked: str = "ok", max_retries: int = MAX_RETRIES) -> DataFrame:
    """Entries after one attempt; the boolean column ``worked`` says how it went: done, back to pending, or failed at the last try."""
    tries = F.col("attempts") + 1
    state = F.when(F.col(worked), "done").when(tries >= max_retries, "failed").otherwise("pending")
    return entries.withColumn("state", state).withColumn("attempts", tries).drop(worked)


def stream_latest(log: DataFrame) -> DataFrame:
    """The same as a stream, in update mode: (id, state, updated_at) of every id that came up in a batch, as ``latest`` has it by then; a line that is
    no newer gives out what holds. An id's state is its newest entry alone."""
    first = F.struct(F.coalesce(-F.unix_micros("updated_at"), F.lit((1 << 63) - 1)), "seq")
    return log.groupBy("id").agg(F.min_by(F.struct("state", "updated_at"), first).alias("new")).select("id", "new.state", "new.updated_at")


def capture_stream(turns: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str):
    """Run the capture pipeline on each micro-batch of a stream of turns, all that is there now, and stop."""
    return turns.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inactive_sessions(turns: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Sessions of (session_id, ts), ended by a gap; on a stream, set a watermark first."""
    return turns.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("turns")).select("session_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "turns")


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` turns of every conversation (conv_id, turn, ..)."""
    return turns.withColumn("__n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("__n") <= n).drop("__n")


def last_of_role(turns: DataFrame) -> DataFrame:
    """(conv_id, user_msg, assistant_msg): the last text of each role."""
    of = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))).alias(f"{role}_msg")
    return turns.groupBy("conv_id").agg(of("user"), of("assistant"))


def enqueue_all(memories: DataFrame, now) -> DataFrame:
    """Log entries that have all memories worked on again."""
    return memories.select(F.sha2(F.concat(F.lit("rebuild:"), F.col("id").cast("string")), 256).alias("id"), F.col("id").alias("memory_id"), "content", "project", F.lit(now).alias("enqueued_at"), F.lit(0).alias("attempts"), F.lit("pending").alias("state"), F.lit(now).alias("updated_at"))
