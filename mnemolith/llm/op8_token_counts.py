"""Token-count rollups kept up to date by signed deltas.

A change inserts, deletes or revises the count of a document under a source, a language and a tokenizer version. It
becomes signed deltas of documents and tokens (a revision takes the old count away and adds the new one), which are
summed for each batch and key and stored under the batch's number. A batch that is delivered again replaces itself, so
commits are idempotent, and after a failure the batch is simply committed again. Totals are the sums over all batches;
older batches can be folded into a base, which keeps their
numbers: a folded batch is final, and is skipped when it is delivered again. A delivery without rows is told by its number.

Defined results: null sources, languages and versions are keys of their own; a null count is 0; an empty batch changes
nothing; keys whose documents and tokens are both back at 0 are left out of the totals; columns other than those named
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, documents, scratch_path
from .op3_token_files import encoder
from .op6_sentencepiece import piece_encoder

KEY = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"
PARTS = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"


def deltas(changes: DataFrame) -> DataFrame:
    """(batch, KEY..., docs, tokens) of (batch, op, KEY..., tokens, old_source, old_lang, old_tokenizer, old_tokens).

    ``op`` is insert, delete or revise; deletes and revisions take the old count from the old key."""
    old = [F.col(f"old_{c}").alias(c) for c in KEY]
    n = lambda c, sign: (F.coalesce(F.col(c), F.lit(0)).cast("long") * sign).alias("tokens")
    added = changes.where("op in ('insert', 'revise')").select("batch", *KEY, F.lit(1).cast("long").alias("docs"), n("tokens", 1))
    removed = changes.where("op in ('delete', 'revise')").select("batch", *old, F.lit(-1).cast("long").alias("docs"), n("old_tokens", -1))
    return added.unionByName(removed).groupBy("batch", *KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals in a folder that all executors share: a part for each committed batch, and a base of folded batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def has_base(self) -> bool:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/folded")
        return base.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(base)

    def deltas(self) -> DataFrame:
        return self.spark.read.schema(f"{SUMS}, batch long").parquet(f"{self.path}/deltas")

    def base(self) -> DataFrame:
        return self.spark.read.schema(SUMS).parquet(f"{self.path}/base") if self.has_base() else self.spark.createDataFrame([], SUMS)

    def folded(self) -> DataFrame:
        """(batch): numbers of the batches that the base holds."""
        return self.spark.read.schema("batch long").parquet(f"{self.path}/folded") if self.has_base() else self.spark.createDataFrame([], "batch long")

    def commit(self, changes: DataFrame, batches: Iterable[int] = ()) -> None:
        """Store the deltas of all batches in ``changes``, each in place of an earlier delivery of the same batch; those in the base are skipped.

        ``batches`` are numbers that were delivered, with rows or without: a delivery that has no rows any more takes the place of one that had some."""
        marks = self.spark.createDataFrame([(int(n),) for n in batches], "batch long")
        if self.has_base():
            changes, marks = (df.join(self.folded(), "batch", "left_anti") for df in (changes, marks))
        # A delta of nothing, which is in no total.
        nothing = marks.select("batch", *[F.lit(None).cast("string").alias(c) for c in KEY], *[F.lit(0).cast("long").alias(c) for c in ("docs", "tokens")])
        rows = deltas(changes).unionByName(nothing)
        rows.repartition("batch", *KEY).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/deltas")

    def totals(self) -> DataFrame:
        rows = self.deltas().drop("batch").unionByName(self.base()) if self.has_base() else self.deltas()
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def fold(self, path: str, up_to: int) -> Rollup:
        """A rollup at ``path`` with the batches up to ``up_to`` in its base, beside their numbers, and the others as they are.

        A batch up to ``up_to`` that comes only later is not in the base, so it is still added."""
        old = F.coalesce(F.col("batch") <= up_to, F.lit(False))
        rows = self.deltas()
        rows.where(~old).repartition("batch", *KEY).write.partitionBy("batch").parquet(f"{path}/deltas")
        base = rows.where(old).drop("batch").unionByName(self.base())
        base.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{path}/base")
        rows.where(old).select("batch").unionByName(self.folded()).distinct().write.parquet(f"{path}/folded")
        return Rollup(self.spark, path)


def pattern_count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def document_history(docs: DataFrame) -> DataFrame:
    """The changes that a corpus goes through: all documents arrive counted in words, English ones are counted anew in
    parts, and documents of fewer than 50 words are deleted and then inserted again, so that all are counted in the end."""
    counted = docs.select("source", "lang", pattern_count(F.col("text"), WORD).alias("words"), pattern_count(F.col("text"), PARTS).alias("parts"))
    change = lambda batch, op, new, old: F.struct(F.lit(batch).cast("long").alias("batch"), F.lit(op).alias("op"), *[F.lit(v).alias(k) for k, v in (("tokenizer", new), ("old_tokenizer", old))])
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    short = F.col("words") < 50
    gone = F.when(english, change(3, "delete", None, "parts-1")).otherwise(change(3, "delete", None, "words-1"))
    back = F.when(english, change(4, "insert", "parts-1", None)).otherwise(change(4, "insert", "words-1", None))
    steps = F.filter(F.array(change(1, "insert", "words-1", None), F.when(english, change(2, "revise", "parts-1", "words-1")), F.when(short, gone), F.when(short, back)), lambda s: s.isNotNull())
    count = lambda c: F.when(F.col(c) == "parts-1", F.col("parts")).when(F.col(c) == "words-1", F.col("words"))
    return counted.withColumn("s", F.explode(steps)).select("s.*", "source", "lang", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), "words", "parts").withColumn("tokens", count("tokenizer")).withColumn("old_tokens", count("old_tokenizer"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = cut(document_history(documents(spark, sf_dir)), "token-changes")
    rollup = Rollup(spark, scratch_path(spark, "token-counts"))
    rollup.commit(history)
    rollup.commit(history.where("batch = 2"))  # delivered again
    return rollup.totals()


BYTES, PIECES = "byte_bpe_50k", "piece_bpe_32k"


def tokenizer_history(docs: DataFrame) -> DataFrame:
    """Changes that end with every document counted by both tokenizers: all arrive counted in ``byte_bpe_50k``, with their words in place of their
    count in ``piece_bpe_32k``, which is revised then; documents of fewer than 50 words are deleted, and a later batch inserts them again."""
    import public_tokenizers

    bytes_path, pieces_path = public_tokenizers.path(f"{BYTES}.json"), public_tokenizers.path(f"{PIECES}.model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, pieces = encoder(bytes_path, 2), piece_encoder(pieces_path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            yield batch[["source", "lang", "words"]].assign(whole=[len(whole(t)) // 2 for t in texts], pieces=[len(pieces.encode(t)) for t in texts])

    counted = docs.select("source", "lang", pattern_count(F.col("text"), WORD).alias("words"), "text").mapInPandas(run, "source string, lang string, words long, whole long, pieces long")
    lit = lambda v: F.lit(v).cast("string")
    n = lambda c: F.lit(None).cast("long") if c is None else F.col(c)

    def change(batch: int, op: str, tokenizer: str | None, tokens: str | None, old: str | None = None, old_tokens: str | None = None) -> Column:
        return F.struct(F.lit(batch).cast("long").alias("batch"), F.lit(op).alias("op"), lit(tokenizer).alias("tokenizer"), n(tokens).alias("tokens"), lit(old).alias("old_tokenizer"), n(old_tokens).alias("old_tokens"))

    always = [change(1, "insert", BYTES, "whole"), change(1, "insert", PIECES, "words"), change(2, "revise", PIECES, "pieces", PIECES, "words")]
    counts = ((BYTES, "whole"), (PIECES, "pieces"))
    again = [change(3, "delete", None, None, t, c) for t, c in counts] + [change(4, "insert", t, c) for t, c in counts]
    steps = F.when(F.col("words") < 50, F.array(*always, *again)).otherwise(F.array(*always))
    return counted.withColumn("s", F.explode(steps)).select("s.*", "source", "lang", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"))


def op8_tokenizer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every document, in tokens of both tokenizers."""
    history = cut(tokenizer_history(documents(spark, sf_dir)), "token-changes")
    rollup = Rollup(spark, scratch_path(spark, "token-counts"))
    rollup.commit(history)
    rollup.commit(history.where("batch = 2"))  # delivered again
    return rollup.totals()


SQL = rf"""
WITH counted AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words, len(regexp_extract_all(coalesce(text, ''), '{PARTS}')) AS parts FROM documents
)
SELECT source, lang, CASE WHEN lang = 'en' THEN 'parts-1' ELSE 'words-1' END AS tokenizer, count(*)::bigint AS n_docs, sum(CASE WHEN lang = 'en' THEN parts ELSE words END)::bigint AS n_tokens
FROM counted GROUP BY ALL
"""
