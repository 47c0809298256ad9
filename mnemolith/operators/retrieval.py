"""Documents for questions by shared words, and runs of an evaluation over question and answer pairs.

The documents that share most words with a question are found without pairing all that share any. A document that has
none of a question's ``p`` rarest words shares at most the other ``n - p``; so a few rare words give first candidates, the
``k``-th best of them tells how many words any better document must share, and that how many more of the rarer words have to be
looked up. Words that most documents have are looked up for candidates only. The answer is exact.

Where questions and documents share words too often for joins, blocks of questions meet blocks of documents, and a task counts what
its two blocks share; it keeps the best ``k`` of each question. That is exact too, and no pair of a question and a document becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import MARKS, SPACE, STOP_WORDS, strip_marks
from ..session import cut_off, spread
from .contradiction import first_of
from .evaluation import results, summarise

#: First candidates looked up for each of the k, at least.
ROOM = 20
#: Distinct words of all questions up to which they are sent to every task.
BROADCAST_WORDS = 200_000
#: How often questions and documents may share a word, counted over all, for joins of them.
FEW_MEETINGS = 1_000_000
#: Words of documents, and of questions, in one block.
BLOCK_SAID, BLOCK_ASKED = 2_000_000, 1_000_000


def word_rows(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, word) of each row's significant words, each once: lower case, without marks around them, four bytes or more, no stop words."""
    each = rows.select(*keys, F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE)).alias("word"))
    bare = each.withColumn("word", strip_marks(F.col("word"), MARKS))
    return bare.where((F.octet_length("word") >= 4) & ~F.col("word").isin(STOP_WORDS))


def most_shared(questions: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(question_id, doc_id, shared, rank): the ``k`` documents (scope, doc_id, content) of its scope that share most distinct significant words
    with each question (scope, question_id, question), one at least; of equals the smaller ids."""
    sought = cut_off(word_rows(questions, "question", "scope", "question_id").distinct())
    words = sought.select("word").distinct()
    few = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    # Words that nobody asks for are dropped where they are read.
    told = cut_off(word_rows(spread(documents), "content", "scope", "doc_id").join(F.broadcast(words) if few else words, "word", "left_semi").distinct())
    held = told.groupBy("scope", "word").agg(F.count(F.lit(1)).alias("holders"))
    meetings = sought.join(held, ["scope", "word"]).agg(F.sum("holders").alias("n")).first()["n"] or 0
    if meetings > FEW_MEETINGS:
        return _ranked(_most_shared_by_blocks(sought, told, k), k)
    by_rarity = W.partitionBy("question_id").orderBy("holders", "word")
    ranked = cut_off(
        sought.join(held, ["scope", "word"])
        .withColumn("place", F.row_number().over(by_rarity))
        .withColumn("before", F.coalesce(F.sum("holders").over(by_rarity.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("n", F.count(F.lit(1)).over(W.partitionBy("question_id")))
    )

    def counted(some: DataFrame) -> DataFrame:
        """(question_id, doc_id, shared) of all documents that have one of these words, over all words of the question."""
        met = some.select("scope", "question_id", "word").join(told, ["scope", "word"]).select("scope", "question_id", "doc_id").distinct()
        asked = met.join(ranked.select("question_id", "word"), "question_id")
        return asked.join(told, ["scope", "doc_id", "word"]).groupBy("question_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))

    opening = F.col("before") < ROOM * k
    first = cut_off(_best(counted(ranked.where(opening)), k))
    last = first.groupBy("question_id").agg(F.min("shared").alias("least"), F.count(F.lit(1)).alias("found")).select("question_id", F.when(F.col("found") >= k, F.col("least")).otherwise(0).alias("least"))
    # As good as the last one is not enough to leave a document out: its id may be smaller.
    more = ranked.where(~opening).join(last, "question_id", "left").where(F.col("place") <= F.col("n") - F.coalesce("least", F.lit(0)) + 1)
    both = first.unionByName(counted(more)).distinct()
    return _ranked(both, k)


def _best(rows: DataFrame, k: int) -> DataFrame:
    return first_of(rows, ["question_id"], [F.desc("shared"), F.asc("doc_id")], k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return _best(rows, k).withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("shared"), "doc_id")))


def _most_shared_by_blocks(sought: DataFrame, told: DataFrame, k: int) -> DataFrame:
    """(question_id, doc_id, shared): of each block of documents the ``k`` that share most words with each question, of equals the smaller ids."""
    # A word of another scope is another word.
    numbers = cut_off(sought.select("scope", "word").distinct().withColumn("w", F.monotonically_increasing_id()))
    few = numbers.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    bags = lambda rows, *keys: rows.dropna(subset=[*keys]).join(F.broadcast(numbers) if few else numbers, ["scope", "word"]).groupBy(*keys).agg(F.collect_list("w").alias("w"))
    n_d = max(told.sparkSession.sparkContext.defaultParallelism, -(-told.count() // BLOCK_SAID))
    n_q = max(1, -(-sought.count() // BLOCK_ASKED))
    dealt = lambda n, *keys: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    docs = bags(told, "scope", "doc_id").select("doc_id", "w", dealt(n_d, "scope", "doc_id").alias("d"), every(n_q).alias("q"))
    asked = bags(sought, "scope", "question_id").select("question_id", "w", dealt(n_q, "question_id").alias("q"), every(n_d).alias("d"))

    def shared(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("doc_id", kind="stable")
        n, ids = len(docs), docs["doc_id"].to_numpy()
        found: list[tuple] = []
        if n and len(asked):
            said = np.concatenate(docs["w"].to_numpy())
            holder = np.repeat(np.arange(n, dtype=np.int32), docs["w"].map(len))
            order = np.argsort(said, kind="stable")
            words, starts = np.unique(said[order], return_index=True)
            ends, holder = np.append(starts[1:], len(said)), holder[order]
            for question, sought in zip(asked["question_id"], asked["w"], strict=True):
                at = np.searchsorted(words, sought)
                at = [i for i, w in zip(at.tolist(), sought, strict=True) if i < len(words) and words[i] == w]
                if not at:
                    continue
                counts = np.bincount(np.concatenate([holder[starts[i] : ends[i]] for i in at]), minlength=n)
                least = max(1, int(np.partition(counts, n - k)[n - k])) if k < n else 1
                good = np.flatnonzero(counts >= least)
                good = good[np.argsort(-counts[good], kind="stable")[:k]]
                found += [(question, ids[i], int(counts[i])) for i in good]
        return pd.DataFrame(found, columns=["question_id", "doc_id", "shared"])

    kind = lambda rows, c: rows.schema[c].dataType.simpleString()
    dealt_out = lambda rows: rows.repartition(n_d * n_q, "d", "q").groupBy("d", "q")
    return dealt_out(docs).cogroup(dealt_out(asked)).applyInPandas(shared, f"question_id {kind(sought, 'question_id')}, doc_id {kind(told, 'doc_id')}, shared long")


Recall = Callable[[DataFrame, DataFrame, int], DataFrame]


def recall_by_words(questions: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """(question_id, rank, content) by ``most_shared``; contents are read for these only."""
    few = cut_off(most_shared(questions, stored, k).select("question_id", "doc_id", "rank"))
    return few.join(stored.select("doc_id", "content"), "doc_id").select("question_id", "rank", "content")


class RecallFailed(RuntimeError):
    """No question of a run could be asked."""


def evaluate(pairs: DataFrame, turns: DataFrame, k: int, *, accumulate: bool = False, recall: Recall = recall_by_words) -> DataFrame:
    """(question_id, category, exact_match, f1_score, recalled_at_k, failed) of every pair (pair_id, question_id, question, ground_truth, category).

    What is stored are the turns (pair_id, doc_id, content). By default each pair starts with an empty store and sees its own turns; with
    ``accumulate`` all turns are stored first, and all questions asked then. ``recall`` may add a column ``error``: a question with one
    counts as failed and has retrieved nothing. If all fail, the run does."""
    scope = F.lit(0) if accumulate else F.col("pair_id")
    asked = pairs.select(scope.alias("scope"), "question_id", "question")
    stored = turns.select(scope.alias("scope"), "doc_id", "content")
    found = recall(asked, stored, k)
    error = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
    found = cut_off(found.select("question_id", "rank", "content", error.alias("error")))
    failed = found.where("error is not null").select("question_id").distinct()
    n = pairs.count()
    if n and failed.count() == n:
        raise RecallFailed(f"all {n} questions failed")
    usable = found.join(failed, "question_id", "left_anti").select("question_id", "rank", "content")
    rows = results(pairs, usable.join(pairs.select("question_id", "ground_truth"), "question_id"), k)
    return rows.join(failed.withColumn("failed", F.lit(True)), "question_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


def summary(rows: DataFrame, k: int, k2: int, accumulate: bool) -> DataFrame:
    """One row: the measures, how many questions failed, and the mode."""
    failures = rows.agg(F.count_if("failed").alias("recall_failures"))
    return summarise(rows, k, k2).join(F.broadcast(failures), how="cross").withColumn("mode", F.lit("accumulate" if accumulate else "per-pair-reset"))
