"""Files of memories, transcripts and evaluation sets: readers and writers."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import hop_category, normalise_category, normalise_question_type, trimmed
from ..operators.filters import SearchFilters
from ..schema import MEMORY, MEMORY_TYPES, SCOPES

EXPORTED = ["id", "type", "scope", "visibility", "content", "confidence", "source", "tags", "project", "created_at", "updated_at", "access_count"]
CSV_COLUMNS = ["id", "type", "scope", "visibility", "content", "confidence", "source", "project", "created_at", "access_count"]


def read_memories(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Memories from JSON lines, or from a JSON array."""
    return spark.read.schema(MEMORY).option("multiLine", array).json(path)


def validate_batch(rows: DataFrame) -> DataFrame:
    """Rows of (content, type, scope, tags, confidence) with ``error``: null, or what is wrong; defaults filled in."""
    kind, scope = F.coalesce(F.nullif("type", F.lit("")), F.lit("fact")), F.coalesce(F.nullif("scope", F.lit("")), F.lit("permanent"))
    error = F.when(F.char_length(trimmed(F.col("content"))) < 10, "content is too short").when(~kind.isin(*MEMORY_TYPES), "unknown type").when(~scope.isin(*SCOPES), "unknown scope").when(~F.coalesce("confidence", F.lit(0.0)).between(0, 1), "confidence is not between 0 and 1")
    sure = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.9).otherwise(F.col("confidence"))
    return rows.select("content", kind.alias("type"), scope.alias("scope"), "tags", sure.alias("confidence"), error.alias("error"))


def export_rows(memories: DataFrame) -> DataFrame:
    """What an export holds: current rows that are not sensitive."""
    return SearchFilters().apply(memories).select(*EXPORTED)


def write_json(memories: DataFrame, path: str) -> None:
    export_rows(memories).write.json(path)


def csv_rows(memories: DataFrame) -> DataFrame:
    rows = SearchFilters().apply(memories)
    return rows.select(*[F.format_string("%.4f", "confidence").alias(c) if c == "confidence" else F.col(c) for c in CSV_COLUMNS])


def write_csv(memories: DataFrame, path: str) -> None:
    """Quotes are doubled, and white space at the ends of a field stays."""
    csv_rows(memories).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_csv`` wrote; a field may hold line ends. Null is a field without quotes, and an empty text one with nothing between them.

    Spark takes what equals ``nullValue`` for null, quoted or not, so that is a name which no text has; without a mark for escaped quotes it loses zero characters."""
    schema = ", ".join(f"{c} {'timestamp' if c == 'created_at' else 'long' if c == 'access_count' else 'string'}" for c in CSV_COLUMNS)
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True, nullValue=uuid.uuid4().hex, charToEscapeQuoteEscaping='"').csv(path)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of all Markdown files below a folder."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,markdown}")
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, role, content) of JSON lines: what user and assistant said, in the order of block and line.

    Lines that can't be read and other roles are left out; human is user, in any case of letters."""
    schema = T.StructType([T.StructField("role", T.StringType()), T.StructField("type", T.StringType()), T.StructField("message", _TURN)])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.from_json("value", schema).alias("t"))
    role = F.lower(F.coalesce(F.nullif("t.role", F.lit("")), "t.message.role"))
    return lines.select("file", "block", "line", F.when(role == "human", "user").otherwise(role).alias("role"), F.col("t.message.content").alias("content")).where("role in ('user', 'assistant') and content is not null")


def locomo(spark: SparkSession, path: str) -> DataFrame:
    """(id, turns, question, answer, category): a map of conversations with sessions, which are taken in the text order of their names."""
    turn = "struct<speaker:string,text:string>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("id", "body"))
    fields = raw.select("id", F.from_json("body", "map<string,string>").alias("f"))
    names = F.array_sort(F.filter(F.map_keys("f"), lambda k: F.startswith(k, F.lit("session_")) & ~F.endswith(k, F.lit("date_time"))))
    turns = F.flatten(F.transform(names, lambda k: F.coalesce(F.from_json(F.element_at("f", k), f"array<{turn}>"), F.array().cast(f"array<{turn}>"))))
    pairs = F.from_json(F.element_at("f", "question_answer_pairs"), "array<struct<question:string,answer:string,category:string>>")
    return fields.select("id", turns.alias("turns"), F.posexplode(pairs).alias("n", "qa")).select(F.concat_ws("-", "id", "n").alias("id"), "turns", F.col("qa.question").alias("question"), F.col("qa.answer").alias("answer"), normalise_category(F.col("qa.category")).alias("category"))


def longmemeval(spark: SparkSession, path: str) -> DataFrame:
    """(id, facts, question, answer, category): turns of all sessions as "role: content"."""
    schema = "question_id string, question_type string, question string, answer string, haystack_sessions array<array<struct<role:string,content:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    said = F.transform(F.flatten("haystack_sessions"), lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    return rows.select(F.col("question_id").alias("id"), said.alias("facts"), "question", "answer", normalise_question_type(F.col("question_type")).alias("category"))


def dmr(spark: SparkSession, path: str) -> DataFrame:
    """(id, turns, question, answer, category), with the other names that fields may have."""
    turn = "array<struct<speaker:string,role:string,content:string,text:string>>"
    rows = spark.read.schema(f"id string, conversation {turn}, turns {turn}, question string, query string, answer string, expected_answer string, hop_count int").option("multiLine", True).json(path)
    either = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    turns = F.when(F.size("conversation") > 0, F.col("conversation")).otherwise(F.col("turns"))
    said = F.transform(turns, lambda t: F.struct(either(t["speaker"], t["role"]).alias("speaker"), either(t["content"], t["text"]).alias("content")))
    return rows.select("id", said.alias("turns"), either(F.col("question"), F.col("query")).alias("question"), either(F.col("answer"), F.col("expected_answer")).alias("answer"), hop_category(F.col("hop_count")).alias("category"))


def parse_llm_memories(text):
    """A model's answer as an array of memories: a JSON array, or an object with one under ``memories``."""
    item = "array<struct<type:string,content:string,confidence:double,tags:array<string>>>"
    return F.when(F.startswith(trimmed(text), F.lit("[")), F.from_json(text, item)).otherwise(F.from_json(text, f"memories {item}")["memories"])


def lenient_timestamp(text):
    return F.try_to_timestamp(text)


def stamp_episode(turns: DataFrame, session: str, now: datetime) -> DataFrame:
    """Turns (user_msg, assistant_msg) as episodes."""
    return turns.select(F.sha2(F.concat_ws("|", F.lit(session), "user_msg", "assistant_msg"), 256).alias("uuid"), F.lit(session).alias("session_id"), "user_msg", "assistant_msg", F.lit(now).alias("captured_at"))
