"""How five document filters interact: what each removes in every order of applying them, for each part of the corpus.

Every document is reduced to five bits (it fails a filter or not), and a part of the corpus to a tensor of counts of shape
2 x 2 x 2 x 2 x 2, one axis for each filter. A step of an order is then one contraction: filters applied before select
"pass" along their axis, the step's own filter selects "fail", later ones select both. All steps of all 120 orders are
rows of one selection table, so a single einsum gives them for a batch of parts.

Texts are read once, where they lie; what is shuffled is a digest, an id and five bits for each document. Whether a text
occurs under a smaller id is settled on rows that are first added up by text and part, so a text that a third of the
documents share is a handful of rows when its smallest id is looked for.

Defined results: a null text is empty, and an empty text fails A only (and E where it is repeated); a null source is the
part ''; a row with a null id neither is a repetition nor makes one, and has no labels; rows that share an id count each,
and none of them is a smaller id to another; of several labels of an id the higher counts; null labels are no labels; an
empty table has no parts and gives no row; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, labels

FILTERS = "ABCDE"
#: Failing a filter sets its bit; the first filter has the highest, so that counts by bits reshape to axes in this order.
BIT = {f: 1 << (len(FILTERS) - 1 - i) for i, f in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20
#: Selections along an axis of (pass, fail).
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
#: Parts whose rows are made at once: 600 rows each.
PARTS_AT_ONCE = 64

COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words of a UTF-8 text, a slice at a time."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        gap = SPACE.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        words = text[at:end].split()  # of bytes: at exactly the six characters of SPACE
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def own_failures(text: bytes, n_chars: int) -> int:
    """Bits of the filters that look at a text alone: A to D."""
    words, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    failed = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 2 * n_chars, "D": len(text.translate(None, MARKS)) < len(text)}
    return sum(BIT[f] for f, fails in failed.items() if fails)


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bits, digest) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.utf8_length(texts).to_pylist()
            raw = [t.as_buffer().to_pybytes() for t in texts]
            bits = [own_failures(t, n) for t, n in zip(raw, sizes, strict=True)]
            digests = [hashlib.sha256(t).digest() for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "bits", "digest"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInArrow(run, "doc_id long, part string, bits int, digest binary")


def failure_counts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents, those of quality 1 and those toxic, for each part and set of failed filters."""
    marked = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    marks = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(marked("quality").alias("good"), marked("toxic").alias("toxic"))
    rows = flagged(docs).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    same = ["digest", "part", "bits", "good", "toxic"]
    by_id = rows.groupBy(*same, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    texts = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.min(known).alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))
    least = texts.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    # The smallest id of a text passes E, in whichever part it is, and so do rows without an id.
    passed = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("bits"), passed.alias("n")), F.struct((F.col("bits") + BIT["E"]).alias("bits"), (F.col("n") - passed).alias("n")))
    cells = texts.join(least, "digest").select("part", "good", "toxic", F.inline(split))
    return cells.groupBy("part", "bits").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _selections(rows: list[dict[str, tuple[int, int]]]) -> list[np.ndarray]:
    """A (rows, 2) selection for each axis, of rows that say what each filter selects; those not named select all."""
    return [np.array([row.get(f, ALL) for row in rows], dtype=np.int64) for f in FILTERS]


STEPS = [(order, i) for order in ORDERS for i in range(len(FILTERS))]
REMOVED = _selections([dict.fromkeys(order[:i], PASS) | {order[i]: FAIL} for order, i in STEPS])
KEPT = _selections([dict.fromkeys(order[: i + 1], PASS) for order, i in STEPS])
FAILING = _selections([{f: FAIL} for f in FILTERS])
ALONE = _selections([dict.fromkeys(FILTERS, PASS) | {f: FAIL} for f in FILTERS])
#: The filter of each step, as its number.
OWN = np.array([FILTERS.index(order[i]) for order, i in STEPS])


def contract(tensor: np.ndarray, selections: list[np.ndarray]) -> np.ndarray:
    """Sums of (parts, 2, 2, 2, 2, 2) for each part and row of the selections."""
    return np.einsum("pabcde,ra,rb,rc,rd,re->pr", tensor, *selections)


def audit_rows(parts: list[str], counts: np.ndarray) -> pd.DataFrame:
    """All steps of all orders for parts with counts of shape (parts, 3, 32): documents, good, toxic."""
    n, good, toxic = (counts[:, i].reshape(len(parts), 2, 2, 2, 2, 2) for i in range(3))
    removed = contract(n, REMOVED)
    shapley = np.stack([removed[:, f == OWN].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    return pd.DataFrame({
        "part": np.repeat(np.array(parts, dtype=object), len(STEPS)),
        "filter_order": [order for order, _ in STEPS] * len(parts),
        "step": np.array([i + 1 for _, i in STEPS] * len(parts), dtype=np.int32),
        "kept": contract(n, KEPT).ravel(),
        "removed": removed.ravel(),
        "redundant": (contract(n, FAILING)[:, OWN] - removed).ravel(),
        "unique_fails": contract(n, ALONE)[:, OWN].ravel(),
        "good_lost": contract(good, REMOVED).ravel(),
        "toxic_lost": contract(toxic, REMOVED).ravel(),
        "shapley": shapley[:, OWN].ravel(),
    })


def filter_audit(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Columns of ``COLUMNS`` for every part, order of filters and step."""
    # At most 32 cells a part.
    tensors = failure_counts(docs, labelled).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PARTS_AT_ONCE):
                some = batch.iloc[at : at + PARTS_AT_ONCE]
                counts = np.zeros((len(some), 3, 1 << len(FILTERS)), dtype=np.int64)
                for i, cells in enumerate(some["cells"]):
                    for c in cells:
                        counts[i, :, c["bits"]] = c["n"], c["good"], c["toxic"]
                yield audit_rows(list(some["part"]), counts)

    return tensors.mapInPandas(run, COLUMNS)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), labels(spark, sf_dir))


SQL = rf"""
WITH marks AS (SELECT doc_id, max(coalesce(quality = 1, false)::int) AS good, max(coalesce(toxic = 1, false)::int) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
failed AS (SELECT doc_id, part, concat(
    CASE WHEN len(words) < 200 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails FROM texts),
cells AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failed LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
met AS (SELECT part, filter_order, fails, n, good, toxic, list_min([CASE WHEN contains(fails, filter_order[i]) THEN i ELSE 6 END FOR i IN [1, 2, 3, 4, 5]]) AS first FROM cells, orders),
steps AS (SELECT part, filter_order, step, filter_order[step] AS f,
    coalesce(sum(n) FILTER (first > step), 0) AS kept, coalesce(sum(n) FILTER (first = step), 0) AS removed,
    coalesce(sum(n) FILTER (first < step AND contains(fails, filter_order[step])), 0) AS redundant, coalesce(sum(n) FILTER (fails = filter_order[step]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (first = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (first = step), 0) AS toxic_lost
  FROM met, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
  good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::bigint AS shapley
FROM steps
"""
