"""Near-duplicate lines across all documents, by a deletion-neighbourhood join.

A line is its words (between ASCII white space). Lines with the same words are one class. Two classes are near if one
insertion, deletion or replacement of a word turns one into the other and the shorter has ``least_words`` words at
least: an edit is then at most that share of a line, an eighth by default. (Short lines that differ in a word, as
"Part 1" and "Part 2" do, mostly say different things; with ``least_words=1`` they are near too.) Of a class, only the earliest line stays, and none if a near class begins earlier; the order is by document id,
then text hash, then place in the document. Blank lines stay.

1. Every line gets a 128-bit hash; classes and their first lines come from one aggregation.
2. Two lines with one word edit between them share half of their words at one end, so lines that share neither end with
   another class need no variants.
3. The others emit their deletion neighbourhood: the hash of the line and of the line without each word, with its place.
   Equal hashes with the same place are a replacement, a whole line's hash equal to a variant's is an insertion or
   deletion. Only the smallest line of each key is compared, as any two lines of such a key are near: no pairs.
4. The words of each line and of the earlier line found for it are compared before it is dropped.

Defined results: a null text is empty and has no lines; null ids come first; rows equal in id and text are one document,
treated alike; an empty table gives an empty result; columns other than the id and the text are passed through by
``dedup_lines`` and not read by ``line_decisions``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, new_names
from .word_cache import WordCache

#: Words that the shorter of two near lines has at least; lines that a task holds before it hands them on.
LEAST_WORDS, SLICE = 8, 20_000
DOC = ["doc_id", "doc_key"]
AT = "struct(doc_id, doc_key, line_no) AS at"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def words_of(line: str) -> list[bytes]:
    return line.encode("utf-8", "replace").split()


def end_keys(words: list[bytes], least_words: int = LEAST_WORDS) -> list[int]:
    """Hashes of the halves at both ends: as long as any near line of the same length, or one longer or shorter, must share."""
    n = len(words)
    if n < least_words:
        return []
    halves = {n // 2, (n - 1) // 2} if n > least_words else {n // 2}
    return [xxhash.xxh3_64_intdigest(b" ".join(part), seed=2 * h + side) - (1 << 63) for h in halves for side, part in enumerate((words[:h], words[n - h :]))]


def neighbourhood(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """Hash of the whole sequence of word hashes, and of the sequence without each of its words."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(hashes) - 1, 0), MULTIPLIER)]).astype(np.uint64))
    before = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[: len(hashes)], dtype=np.uint64)])
    whole = before[-1]
    return int(whole.astype(np.int64)), (before[:-1] + (whole - before[1:]) * INVERSE).astype(np.int64)


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def with_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_key"), F.col("text").alias("text"))


def placed(batch: pd.DataFrame, rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """``rows`` as a frame, whose first column, a row number of ``batch``, becomes that row's id and key."""
    out = pd.DataFrame(rows, columns=["row", *columns])
    place = out.pop("row").to_numpy()
    out.insert(0, "doc_key", batch["doc_key"].to_numpy()[place])
    out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy()[place])
    return out


def line_table(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, doc_key, line_no, h1, h2, n, ends) of every line that is not blank."""
    columns = ["line_no", "h1", "h2", "n", "ends"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch["text"]):
                for no, line in enumerate((text or "").split("\n")):
                    words = words_of(line)
                    if words:
                        h = xxhash.xxh3_128_intdigest(b" ".join(words))
                        rows.append((i, no, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), len(words), end_keys(words, least_words)))
                        if len(rows) == SLICE:
                            yield placed(batch, rows, columns)
                            rows = []
            if rows:
                yield placed(batch, rows, columns)

    return with_key(docs).mapInPandas(run, "doc_id long, doc_key long, line_no int, h1 long, h2 long, n int, ends array<long>")


def candidates(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(at, line, whole, less) of the first line of every class that shares an end with another class."""
    columns, most = ["line_no", "line", "whole", "less"], 4 * SLICE
    ends = classes.where(F.size("ends") > 0).select(F.explode("ends").alias("end"), "h1")
    shared = ends.groupBy("end").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("end")
    chosen = classes.join(ends.join(shared, "end").select("h1").distinct(), "h1").select("at.*").groupBy(*DOC).agg(F.collect_list("line_no").alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordCache(xxhash.xxh3_64_intdigest)
        for batch in batches:
            rows, held = [], 0
            for i, (text, numbers) in enumerate(zip(batch["text"], batch["lines"], strict=True)):
                lines = (text or "").split("\n")
                for no in {int(x) for x in numbers}:
                    words = words_of(lines[no])
                    whole, less = neighbourhood(np.array([known[w] for w in words], dtype=np.uint64))
                    rows.append((i, no, " ".join(w.decode() for w in words), whole, less))
                    held += len(words)
                    if held >= most:
                        yield placed(batch, rows, columns)
                        rows, held = [], 0
            if rows:
                yield placed(batch, rows, columns)

    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.doc_key") == F.col("c.doc_key"))
    texts = with_key(docs).alias("d").join(chosen.alias("c"), same).select("d.doc_id", "d.doc_key", "d.text", "c.lines")
    found = texts.mapInPandas(run, "doc_id long, doc_key long, line_no int, line string, whole long, less array<long>")
    return cut(found.select(F.expr(AT), "line", "whole", "less"), "line-candidates")


def near_classes(found: DataFrame) -> DataFrame:
    """(at) of every candidate with an earlier line within one word edit."""
    variants = found.select("at", F.posexplode("less").alias("place", "key")).unionByName(found.select("at", F.lit(-1).alias("place"), F.col("whole").alias("key")))
    shared = variants.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key")
    members = cut(variants.join(shared, "key"), "line-variants")
    first = members.groupBy("key", "place").agg(F.min("at").alias("first"))
    whole = first.where("place = -1").select("key", F.col("first").alias("whole_at"))
    less = first.where("place >= 0").groupBy("key").agg(F.min("first").alias("less_at"))
    replaced = members.where("place >= 0").join(first, ["key", "place"]).where("at > first").select("at", F.col("first").alias("earlier"))
    longer = members.where("place >= 0").join(whole, "key").where("at > whole_at").select("at", F.col("whole_at").alias("earlier"))
    shorter = whole.join(less, "key").where("whole_at > less_at").select(F.col("whole_at").alias("at"), F.col("less_at").alias("earlier"))
    pairs = replaced.unionByName(longer).unionByName(shorter).groupBy("at").agg(F.min("earlier").alias("earlier"))
    lines = found.select("at", "line")
    both = pairs.join(lines, "at").join(lines.select(F.col("at").alias("earlier"), F.col("line").alias("earlier_line")), "earlier")

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(x.encode().split(), y.encode().split()) for x, y in zip(a, b, strict=True)], dtype=bool)

    return both.where(verified("line", "earlier_line")).select("at")


def line_decisions(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, doc_key, n_same, n_near, dropped) of every document that loses lines: how many for which reason, and their numbers."""
    lines = cut(line_table(docs, least_words), "lines")
    classes = cut(lines.groupBy("h1", "h2").agg(F.expr("min(struct(doc_id, doc_key, line_no))").alias("at"), F.count(F.lit(1)).alias("lines"), F.first("n").alias("n"), F.first("ends").alias("ends")), "line-classes")
    near = near_classes(candidates(docs, classes)).withColumn("near", F.lit(True))
    losing = classes.select("h1", "h2", "at", "lines").join(near, "at", "left").where("near or lines > 1").select("h1", "h2", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    lost = lines.join(losing, ["h1", "h2"]).where("near or struct(doc_id, doc_key, line_no) > first")
    return lost.groupBy(*DOC).agg(F.count_if(~F.col("near")).alias("n_same"), F.count_if("near").alias("n_near"), F.sort_array(F.collect_set("line_no")).alias("dropped"))


def line_report(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_same, n_near, dropped) of every document."""
    own = with_key(docs).select(*DOC, F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines"))
    lost = line_decisions(docs, least_words)
    same = F.col("o.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("o.doc_key") == F.col("l.doc_key"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return own.alias("o").join(lost.alias("l"), same, "left").select("o.doc_id", "o.n_lines", zero("n_same"), zero("n_near"), F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text`` (and ``n_chars``, if there, counted anew).

    A document that loses every line that it had is dropped; one that had none stays."""
    of, key, gone = new_names(docs, "__id", "__key", "__dropped")
    lost = line_decisions(docs, least_words).select(F.col("doc_id").alias(of), F.col("doc_key").alias(key), F.col("dropped").alias(gone))

    @F.pandas_udf("string")
    def without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        less = [set(d.tolist()) if d is not None else None for d in dropped]
        return pd.Series([t if g is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for t, g in zip(texts, less, strict=True)], dtype=object)

    joined = docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(docs["text"]) == F.col(key)), "left")
    shorter = joined.withColumn("text", without("text", gone)).where(F.col(gone).isNull() | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return shorter.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


SQL = rf"""
WITH lines AS (
  SELECT doc_id, i AS line_no, list_filter(regexp_split_to_array(string_split(text, chr(10))[i + 1], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents, unnest(range(len(string_split(text, chr(10))))) AS u(i)
), said AS (SELECT doc_id, line_no, words, array_to_string(words, ' ') AS line FROM lines WHERE len(words) > 0),
classes AS (SELECT line, any_value(words) AS words, min((doc_id, line_no)) AS pos FROM said GROUP BY line),
less AS (
  SELECT line, pos, i AS place, array_to_string(list_concat(words[1:i], words[i + 2:]), ' ') AS key
  FROM classes, unnest(range(len(words))) AS u(i) WHERE len(words) >= {LEAST_WORDS}
), near AS (
  SELECT a.line FROM less a JOIN less b ON a.key = b.key AND a.place = b.place AND b.pos < a.pos
  UNION SELECT a.line FROM less a JOIN classes b ON a.key = b.line AND b.pos < a.pos AND len(b.words) >= {LEAST_WORDS}
  UNION SELECT b.line FROM less a JOIN classes b ON a.key = b.line AND a.pos < b.pos AND len(b.words) >= {LEAST_WORDS}
), lost AS (
  SELECT s.doc_id, s.line_no, n.line IS NOT NULL AS near
  FROM said s JOIN classes c USING (line) LEFT JOIN (SELECT DISTINCT line FROM near) n USING (line)
  WHERE n.line IS NOT NULL OR (s.doc_id, s.line_no) > c.pos
), told AS (
  SELECT doc_id, count(*) FILTER (NOT near) AS n_same, count(*) FILTER (near) AS n_near, string_agg(line_no::varchar, ',' ORDER BY line_no) AS dropped FROM lost GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END::bigint AS n_lines,
  coalesce(n_same, 0)::bigint AS n_same, coalesce(n_near, 0)::bigint AS n_near, coalesce(dropped, '') AS dropped
FROM documents d LEFT JOIN told USING (doc_id)
"""
