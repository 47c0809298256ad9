"""Toxicity by multiple-instance learning: sentences are scored, a document is toxic if any of them is.

Each sentence has a logistic score over hashed words and word beginnings. The scores of a document's sentences are
combined by noisy-or, 1 - prod(1 - p), and weights are learned from document labels alone through that combination. The
sentences that carry a document's score are then known.

Training takes a bounded sample (``labelled.TRAINING_ROWS``) of the labelled rows outside the held-out fold. Inputs are
the words of the text, nothing else. The sample's features stay in a table and on the executors.

Defined results: a null or empty text has one empty sentence and so the score of the bias alone; without usable labels
every score is 0; null and repeated document ids pass through; an empty table gives an empty result; columns other than
the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import cut, documents, labels
from .labelled import TRAINING_ROWS, held_out, training_sample
from .word_cache import WordCache

FOLDS, HELD, THRESHOLD = 3, 1, 0.7
#: Lengths of the word beginnings that are features besides the word.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Sampled documents that a feature must be in; occurrences that one step of the training works on at once.
LEAST_DOCS, BLOCK = 3, 1 << 20
#: Parts of the sample at least, and bytes of features in each of them.
LEAST_PARTS, PART_BYTES = 6, 8 << 20
EDGES = ".,;:!?\"'()[]{}|$%&*#-_"
ENDS = (".", "!", "?")


def word_features(token: str) -> list[int]:
    """Hashed features of a token without the marks around it."""
    word = token.strip(EDGES).lower()
    if not word:
        return []
    seen = [f"w{word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(s.encode("utf-8", "replace")) for s in seen]


def sentences(text: str) -> list[list[str]]:
    """Tokens of each sentence: it ends with a line or with a token that ends in a full stop or the like."""
    out: list[list[str]] = []
    for line in (text or "").split("\n"):
        now: list[str] = []
        for token in line.split():
            now.append(token)
            if token.endswith(ENDS):
                out.append(now)
                now = []
        if now:
            out.append(now)
    return out or [[]]


@dataclass
class NoisyOr:
    """Weights of the hashed features, those that are not 0, and the bias of a sentence."""

    weights: dict[int, float]
    bias: float

    def token_weight(self, token: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(token))

    @classmethod
    def fit(cls, sample: DataFrame, stands_for: dict[int, float], epochs: int = 150, rate: float = 1.0, shrink: float = 0.6) -> NoisyOr:
        """``sample``: a table as of ``sample_features``.

        Accelerated full-batch gradient steps; after each, weights shrink towards 0, the more the fewer documents there
        are, which drops features of chance. The sums of a step are made by Spark, so the driver has weights only."""
        about = {r["label"]: r for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("sizes") / 4).alias("sentences"), F.sum(F.length("features")).alias("bytes")).collect()}
        if len(about) < 2:
            return cls({}, 0.0 if 1 in about else -40.0)
        n_docs = sum(r["docs"] for r in about.values())
        total = sum(stands_for[label] * r["docs"] for label, r in about.items())
        importance = {label: stands_for[label] / total for label in about}
        keys = common_features(sample)
        sc = sample.sparkSession.sparkContext
        sent = sc.broadcast(keys)
        n_parts = int(max(LEAST_PARTS, -(-sum(r["bytes"] for r in about.values()) // PART_BYTES)))
        # What is in a part and the order of its rows depend on the sample alone, and so do sums of them by the number of the part.
        placed = sample.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)))
        ordered = placed.repartition(n_parts, "part").sortWithinPartitions("part", "doc_id", "features").select("part", "label", "features", "per_token", "sizes")
        each = lambda rows: ((p, Occurrences.of(mine, sent.value, importance)) for p, mine in groupby(rows, key=lambda r: r["part"]))
        shared_dir(sample.sparkSession)
        parts = ordered.rdd.mapPartitions(each).coalesce(n_parts).persist(StorageLevel.MEMORY_AND_DISK)
        # Each step is a job; without what came before the parts, the driver keeps one small stage of each.
        parts.checkpoint()
        in_order = lambda found: [x for _, x in sorted(found, key=lambda x: x[0])]
        mass = sum(in_order(parts.mapValues(Occurrences.mass).collect()), np.zeros(len(keys)))
        weights, bias = np.zeros(len(keys)), float(np.log(max(importance[1] * about[1]["docs"], 1e-4) / (sum(r["sentences"] for r in about.values()) / n_docs)))
        ahead, bias_ahead, speed = weights, bias, 1.0
        # A feature's curvature is at most its importance summed over its occurrences; steps are that much smaller.
        step = rate / np.sqrt(mass + 1e-3)
        for _ in range(epochs):
            now = sc.broadcast((ahead, bias_ahead))
            slopes = in_order(parts.mapValues(lambda part, now=now: part.slopes(*now.value)).collect())
            now.destroy()
            new = ahead - step * sum((s for s, _ in slopes), np.zeros(len(keys)))
            new = np.sign(new) * np.maximum(np.abs(new) - step * shrink / n_docs, 0)
            new_bias = bias_ahead - 0.5 * sum(s for _, s in slopes)
            faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
            drift = min((speed - 1) / faster, 0.9)
            ahead, bias_ahead = new + drift * (new - weights), new_bias + drift * (new_bias - bias)
            weights, bias, speed = new, new_bias, faster
        parts.unpersist()
        sent.destroy()
        kept = np.flatnonzero(weights)
        return cls(dict(zip(keys[kept].tolist(), weights[kept].tolist(), strict=True)), float(bias))


@dataclass
class Occurrences:
    """A part of the sample. Its different tokens: for every feature of one that is a key, the place in the keys and the number of the token.
    For every token that occurs its number and that of the sentence, the document of every sentence, and label and importance of every document."""

    n_keys: int
    features: np.ndarray
    token_of: np.ndarray
    n_tokens: int
    tokens: np.ndarray
    sentence_of: np.ndarray
    doc_of: np.ndarray
    y: np.ndarray
    importance: np.ndarray

    @classmethod
    def of(cls, rows: Iterator[Row], keys: np.ndarray, importance: dict[int, float]) -> Occurrences:
        found, counts, sizes, doc_of, y = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
        for row in rows:
            found.append(np.frombuffer(row["features"], "<u4"))
            counts.append(np.frombuffer(row["per_token"], np.uint8).astype(np.int64))
            sizes.append(np.frombuffer(row["sizes"], "<u4").astype(np.int64))
            doc_of.append(np.full(len(sizes[-1]), len(y), dtype=np.int32))
            y.append(row["label"])
        found, counts, sizes = map(np.concatenate, (found, counts, sizes))
        ends = np.cumsum(counts)
        # A token is told by its first and its last feature.
        named = found[ends - counts].astype(np.uint64) << np.uint64(32) | found[ends - 1]
        _, one, tokens = np.unique(named, return_index=True, return_inverse=True)
        token_of = np.repeat(np.arange(len(one)), counts[one])
        own = found[np.repeat((ends - counts)[one] - (np.cumsum(counts[one]) - counts[one]), counts[one]) + np.arange(len(token_of))]
        place = np.searchsorted(keys, own)
        place[place == len(keys)] = 0
        known = keys[place] == own if len(keys) else np.zeros(len(own), dtype=bool)
        sentence_of = np.repeat(np.arange(len(sizes)), sizes).astype(np.int32)
        return cls(len(keys), place[known].astype(np.int32), token_of[known].astype(np.int32), len(one), tokens.astype(np.int32), sentence_of, np.concatenate(doc_of), np.array(y, dtype=float), np.array([importance[label] for label in y], dtype=float))

    def blocks(self) -> list[slice]:
        return [slice(i, i + BLOCK) for i in range(0, len(self.tokens), BLOCK)]

    def feature_sums(self, of_sentence: np.ndarray) -> np.ndarray:
        of_token = sum((np.bincount(self.tokens[b], of_sentence[self.sentence_of[b]], self.n_tokens) for b in self.blocks()), np.zeros(self.n_tokens))
        return np.bincount(self.features, of_token[self.token_of], self.n_keys)

    def mass(self) -> np.ndarray:
        return self.feature_sums((self.importance * (0.2 + self.y))[self.doc_of])

    def slopes(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """Slopes of this part's loss in the weights and in the bias."""
        n_sentences = len(self.doc_of)
        of_token = np.bincount(self.token_of, weights[self.features], self.n_tokens)
        z = sum((np.bincount(self.sentence_of[b], of_token[self.tokens[b]], n_sentences) for b in self.blocks()), np.zeros(n_sentences)) + bias
        clear = np.bincount(self.doc_of, np.logaddexp(0, z), len(self.y))
        hit = np.maximum(-np.expm1(-clear), 1e-9)
        push = np.where(self.y == 1, -np.exp(-clear) / hit, 1.0) * self.importance
        grad_z = push[self.doc_of] / (1 + np.exp(-np.clip(z, -40, 40)))
        return self.feature_sums(grad_z), float(grad_z.sum())


def sample_features(sample: DataFrame) -> DataFrame:
    """(doc_id, label, features, per_token, sizes) of the training sample, as a stored table: features end to end, the number of
    them of each token that has any, and the number of these tokens in each sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordCache(word_features)
        for batch in batches:
            out = []
            for text in batch["text"]:
                parts = [[f for t in s if (f := known[t])] for s in sentences(text)]
                features = [x for p in parts for f in p for x in f]
                out.append((np.array(features, dtype="<u4").tobytes(), bytes(len(f) for p in parts for f in p), np.array([len(p) for p in parts], dtype="<u4").tobytes()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"]} | {c: [x[i] for x in out] for i, c in enumerate(("features", "per_token", "sizes"))})

    return cut(sample.select("doc_id", "label", "text").mapInPandas(run, "doc_id long, label int, features binary, per_token binary, sizes binary"), "toxic-sample")


def common_features(sample: DataFrame) -> np.ndarray:
    """The features that at least ``LEAST_DOCS`` documents of the sample have, in ascending order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, docs = np.unique(np.concatenate([np.zeros(0, "<u4"), *[np.unique(np.frombuffer(f, "<u4")) for f in batch["features"]]]), return_counts=True)
            yield pd.DataFrame({"feature": keys.astype(np.int64), "docs": docs.astype(np.int64)})

    found = sample.select("features").mapInPandas(run, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    return np.sort(np.array([r["feature"] for r in found.select("feature").collect()], dtype=np.uint32))


def train_toxicity(docs: DataFrame, labelled: DataFrame, *, folds: int = FOLDS, held: int = HELD, rows: int = TRAINING_ROWS) -> NoisyOr:
    sample, stands_for = training_sample(docs, labelled, "toxic", folds, held, rows)
    return NoisyOr.fit(sample_features(sample), stands_for)


class SentenceScores:
    """Scores of a text: the document's, how many sentences it has, which is the worst, and that one's."""

    def __init__(self, model: NoisyOr):
        # A token's weight, and as the imaginary part whether a sentence ends with it.
        self.known, self.bias = WordCache(lambda t: complex(model.token_weight(t), t.endswith(ENDS))), model.bias

    def __call__(self, text: str | None) -> tuple[float, int, int, float]:
        lines = [line.split() for line in (text or "").split("\n")]
        tokens = [t for line in lines for t in line]
        found = np.fromiter(map(self.known.__getitem__, tokens), complex, len(tokens))
        ends = found.imag > 0
        ends[np.cumsum([len(line) for line in lines if line], dtype=np.int64) - 1] = True
        starts = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]).astype(np.int64)
        z = (np.add.reduceat(found.real, starts) if len(tokens) else np.zeros(1)) + self.bias
        return float(-np.expm1(-np.logaddexp(0, z).sum())), len(z), int(z.argmax()), float(1 / (1 + np.exp(-np.clip(z.max(), -40, 40))))


def score_toxicity(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """(doc_id, score, n_sentences, worst_sentence, worst_score): sentences are counted from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = SentenceScores(model)
        for batch in batches:
            scores = pd.DataFrame([score(t) for t in batch["text"]], columns=["score", "n_sentences", "worst_sentence", "worst_score"])
            scores.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield scores

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInPandas(run, "doc_id long, score double, n_sentences long, worst_sentence long, worst_score double")


def drop_toxic(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = SentenceScores(model)
        for texts in parts:
            yield pd.Series([one(t)[0] for t in texts], dtype=float)

    return docs.where(score("text") < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scores = score_toxicity(docs, train_toxicity(docs, labels(spark, sf_dir)))
    return scores.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "worst_score")
