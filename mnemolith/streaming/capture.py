"""What a stream of captured memories does to the store, batch by batch, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.writes import DEDUP, batch_dedup
from ..session import cut_off
from .segments import SegmentLog

#: Rows of the store: a record's newest row holds; ``reinforced`` counts are added up.
STORE = "id string, content string, embedding array<double>, reinforced long"


def records(rows: DataFrame) -> DataFrame:
    """``STORE`` of every record: its newest content, and how often it was met again."""
    newest = F.max_by(F.struct("content", "embedding"), F.when(F.col("content").isNotNull(), F.col("segment"))).alias("new")
    return rows.groupBy("id").agg(newest, F.sum("reinforced").alias("reinforced")).select("id", "new.content", "new.embedding", "reinforced")


def capture_batch(batch: DataFrame, number: int | str, store: SegmentLog, threshold: float = DEDUP) -> bool:
    """Take in (id, seq, content, embedding): rows see the store and the rows of their batch before them. False if the batch was taken in before.

    A new record is added; a longer text takes its record's place; and a record is reinforced by every row that it takes in."""
    if store.has(number):
        return False
    rows = cut_off(batch.select(F.col("id").cast("string").alias("id"), "seq", F.coalesce("content", F.lit("")).alias("content"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
    decided = batch_dedup(rows, records(store.read()), threshold).join(rows, "id")
    record, new = F.coalesce("existing_id", "id").alias("record"), F.col("status") != "duplicate"
    last = F.max_by(F.struct("content", "embedding"), F.when(new, F.struct("seq", "id"))).alias("last")
    changes = decided.groupBy(record).agg(last, F.count_if(F.col("status") != "created").alias("reinforced"))
    return store.append(changes.select(F.col("record").alias("id"), "last.content", "last.embedding", "reinforced"), number)


def capture_into(store: SegmentLog, threshold: float = DEDUP, ready: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ``ready`` makes (id, seq, content, embedding) of a micro-batch. A batch that is run again after a failure changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        capture_batch(ready(batch) if ready else batch, number, store, threshold)

    return run


def compact_records(store: SegmentLog) -> bool:
    """One row for each record."""
    return store.compact(records)


def in_batches(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``batch``, ``n`` parts of about equal size in order of ``seq``."""
    bounds = rows.agg(F.percentile_approx("seq", [i / n for i in range(1, n)], 10_000).alias("b")).first()["b"] or []
    return rows.withColumn("batch", sum(((F.col("seq") > b).cast("int") for b in bounds), F.lit(0)))
