"""Document quality by attention-based multiple-instance learning over passages.

Every passage of a text is encoded from its form (word lengths, repeated words, letter cases, digits, symbols, marks) by
a learned layer. A gated attention, softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages of a document, and the
weighted passage is scored. All weights are learned together from document labels.

Training takes a bounded sample (``labelled.TRAINING_ROWS``) of the labelled rows outside the held-out fold. Inputs are
the words of the text, nothing else.

Defined results: a null or empty text has one empty passage; without usable labels of both kinds every score is the one
label's, or 0.5; null and repeated document ids pass through; an empty table gives an empty result; columns other than
the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels
from .labelled import TRAINING_ROWS, held_out, training_sample

FOLDS, HELD, THRESHOLD = 4, 2, 0.7
PASSAGE_WORDS = 64
HIDDEN, GATE = 16, 8
UPPER, DIGITS, SYMBOLS, STOPS, LOUD = (bytes(range(65, 91)), b"0123456789", b"$%&*#|<>=+~^@_/\\{}[]", b".,;:", b"!?")
N_FEATURES = 11


def passage_features(words: list[str]) -> list[float]:
    raw = " ".join(words).encode("utf-8", "replace")
    n, size = max(1, len(words)), max(1, len(raw))
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / size
    distinct = set(words)
    return [
        np.log1p(len(words)),
        size / n / 10,
        len(distinct) / n,
        sum(map(len, distinct)) / max(1, len(distinct)) / 10,
        share(UPPER),
        share(DIGITS) * 4,
        share(SYMBOLS) * 4,
        share(STOPS) * 4,
        share(LOUD) * 4,
        sum(map(str.isalpha, words)) / n,
        1.0 - share(bytes(range(128))),
    ]


def passages(text: str | None) -> np.ndarray:
    words = (text or "").split()
    return np.array([passage_features(words[i : i + PASSAGE_WORDS]) for i in range(0, max(1, len(words)), PASSAGE_WORDS)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class GatedAttention:
    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["c"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        logit = (t * s) @ p["a"]
        logit -= np.repeat(np.maximum.reduceat(logit, starts), sizes)
        e = np.exp(logit)
        alpha = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(alpha[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "alpha": alpha, "z": z, "out": z @ p["o"] + p["b"]}

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and attention of all passages end to end."""
        sizes = np.array([len(b) for b in bags])
        f = self.forward(np.concatenate(bags), np.cumsum(sizes) - sizes, sizes)
        return sigmoid(f["out"]), f["alpha"]

    @classmethod
    def fit(cls, bags: list[np.ndarray], y: list[int], stands_for: dict[int, float], epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
        rng = np.random.default_rng(seed)
        flat = np.concatenate(bags) if bags else np.zeros((1, N_FEATURES))
        shape = {"W": (N_FEATURES, HIDDEN), "c": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "o": (HIDDEN,), "b": (1,)}
        params = {k: rng.normal(0, 1 / np.sqrt(v[0]), v) * (k not in "cb") for k, v in shape.items()}
        model = cls(flat.mean(axis=0), flat.std(axis=0) + 1e-3, params)
        if len(set(y)) < 2:
            params["o"] *= 0
            params["b"] += 40.0 * (2 * y[0] - 1) if y else 0.0
            return model
        y_all, sizes_all = np.array(y, dtype=float), np.array([len(b) for b in bags])
        importance = np.where(y_all == 1, stands_for[1], stands_for[0])
        importance /= importance.mean()
        first, second, step = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2)), None, 0
        first, second = first
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                sizes = sizes_all[rows]
                starts = np.cumsum(sizes) - sizes
                f = model.forward(np.concatenate([bags[i] for i in rows]), starts, sizes)
                grad = model.backward(f, (sigmoid(f["out"]) - y_all[rows]) * importance[rows] / len(rows), sizes, starts)
                step += 1
                for k in params:
                    g = grad[k] + decay * params[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return model

    def backward(self, f: dict[str, np.ndarray], d_out: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        d_z = np.repeat(np.outer(d_out, p["o"]), sizes, axis=0)
        d_alpha = (d_z * f["h"]).sum(axis=1)
        inner = np.repeat(np.add.reduceat(d_alpha * f["alpha"], starts), sizes)
        d_logit = f["alpha"] * (d_alpha - inner)
        d_gate = np.outer(d_logit, p["a"])
        d_t, d_s = d_gate * f["s"] * (1 - f["t"] ** 2), d_gate * f["t"] * f["s"] * (1 - f["s"])
        d_h = d_z * f["alpha"][:, None] + d_t @ p["V"].T + d_s @ p["U"].T
        d_pre = d_h * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ d_pre, "c": d_pre.sum(axis=0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_s, "a": (f["t"] * f["s"]).T @ d_logit, "o": f["z"].T @ d_out, "b": np.array([d_out.sum()])}


def train_quality(docs: DataFrame, labelled: DataFrame, *, folds: int = FOLDS, held: int = HELD, rows: int = TRAINING_ROWS) -> GatedAttention:
    sample, stands_for = training_sample(docs, labelled, "quality", folds, held, rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "bag": [passages(t).astype("<f8").tobytes() for t in batch["text"]]})

    found = sample.select("doc_id", "label", "text").mapInPandas(run, "doc_id long, label int, bag binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["bag"])))
    return GatedAttention.fit([np.frombuffer(r["bag"], "<f8").reshape(-1, N_FEATURES) for r in found], [r["label"] for r in found], stands_for)


def score_quality(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """(doc_id, score, n_passages, attended): attended is the passage with the largest weight, counted from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            bags = [passages(t) for t in batch["text"]]
            scores, alpha = model.score(bags)
            edges = np.cumsum([0, *map(len, bags)])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores, "n_passages": np.diff(edges), "attended": [int(alpha[a:b].argmax()) for a, b in zip(edges[:-1], edges[1:], strict=True)]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInPandas(run, "doc_id long, score double, n_passages long, attended long")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scores = score_quality(docs, train_quality(docs, labels(spark, sf_dir)))
    return scores.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "attended")
