from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mnemolith.functions import text as X
from mnemolith.operators.chunks import chunk_files, chunk_rows, section_summaries, sections, split_by_size


def each(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_estimate_tokens(spark):
    assert each(spark, X.estimate_tokens, ["", None, "one", "four words are here", "x" * 35]) == [0, 0, 1, 5, 11]


def test_truncate(spark):
    assert each(spark, lambda c: X.truncate_to_budget(c, 5), ["short", "aaaaaaaaa bbbbbbb ccc", "a" * 40]) == ["short", "aaaaaaaaa...", "a" * 15 + "..."]


def test_classify(spark):
    texts = ["You must always do it", "First install, then deploy", "I prefer tea", "yesterday we found it", "plain", "", None, "mustard", "rule:x", "rule: x", "I like what happened"]
    assert each(spark, X.classify, texts) == ["rule", "procedure", "preference", "episode", "fact", "fact", "fact", "fact", "rule", "fact", "preference"]


def test_capture_gate(spark):
    long = "x" * 20
    df = spark.createDataFrame([(long, long), ("x" * 19, long), (long, " " * 30), (long, long + "NO_REPLY"), ("é" * 10, long), (None, long)], "u string, a string")
    assert [r[0] for r in df.select(X.capture_gate(F.col("u"), F.col("a"))).collect()] == [True, False, False, False, True, False]


def test_words_and_tags(spark):
    assert each(spark, X.significant_words, ["The \"Quick\" brown, fox. with they (over)", None]) == [["quick", "brown", "over"], []]
    df = spark.createDataFrame([("How to [Deploy] it: now!", "/a/b/guide.v2.md")], "h string, p string")
    assert df.select(X.heading_tags(F.col("h"), F.col("p"))).first()[0] == ["guide.v2", "how", "deploy", "now"]
    assert each(spark, X.sanitise_query, ["a+b (c)?"]) == ["a b  c  "]


def test_escape_fences_preview(spark):
    assert each(spark, X.xml_escape, ["<a href=\"x\">'&'\n"]) == ["&lt;a href=&#34;x&#34;&gt;&#39;&amp;&#39;&#xA;"]
    assert each(spark, X.strip_code_fences, ["```json\n{\"a\": 1}\n```", "plain", " ```\nx\ny\n``` "]) == ['{"a": 1}', "plain", "x\ny"]
    assert each(spark, lambda c: X.preview(c, 3), ["ab", "a\nb\nc"]) == ["ab", "a b..."]


def test_evaluation_functions(spark):
    df = spark.createDataFrame([("the cat sat", "The Cat"), ("a b", "c"), ("x", ""), ("a a b", "a a a"), (None, "a")], "r string, t string")
    got = df.select(X.exact_match(F.col("r"), F.col("t")).alias("e"), X.token_f1(F.col("r"), F.col("t")).alias("f")).collect()
    assert [r["e"] for r in got] == [True, False, False, False, False]
    assert [r["f"] for r in got] == pytest.approx([0.8, 0, 0, 2 / 3, 0])
    r = spark.createDataFrame([(["no", "has truth", "x"],)], "r array<string>")
    assert [r.select(X.recall_at_k(F.col("r"), F.lit("truth"), k)).first()[0] for k in (1, 2)] == [False, True]


def test_categories(spark):
    assert each(spark, X.normalise_category, [" Single-hop", "Temporal reasoning", "Other "]) == ["single-hop", "temporal", "other"]
    assert each(spark, X.normalise_question_type, ["multi_hop", "Knowledge Update", "x"]) == ["multi-hop", "knowledge-update", "x"]
    assert each(spark, lambda c: X.hop_category(c.cast("int")), ["1", "7", "0", "-1", None]) == ["1-hop", "7-hop", "unknown", "unknown", "unknown"]
    assert each(spark, lambda c: X.member_or(c, ("person",), "concept"), ["person", "alien", None]) == ["person", "concept", "concept"]


def test_sections():
    got = sections("intro\n# A\none two\n### C\nthree\n## B\n#no heading\n##### deep\nfour")
    assert [(s["depth"], s["title"], s["path"], s["body"]) for s in got] == [(1, "A", "A", "intro\none two"), (3, "C", "A / C", "three"), (2, "B", "A / B", "#no heading\n##### deep\nfour")]
    assert sections("no heading") == [] and sections("") == []


def test_split_by_size():
    assert split_by_size("short text", 50, 5) == ["short text"]
    got = split_by_size(" ".join(f"w{i:03d}" for i in range(20)), 25, 8)
    assert all(len(p) <= 25 for p in got) and got[0] == "w000 w001 w002 w003 w004" and got[1].startswith("w003 w004 w005")
    assert split_by_size("x" * 30, 10, 2) == ["x" * 30]


def test_chunks(spark):
    files = spark.createDataFrame([("d/guide.md", "# Setup\n" + "word " * 30 + "\n## Next\nfew")], "file string, text string")
    chunks = chunk_files(files, 60, 10)
    rows = chunk_rows(chunks).collect()
    assert {r["source"] for r in rows} == {"file:d/guide.md"} and rows[0]["tags"] == ["guide", "setup"] and len(rows) > 2
    parts = spark.createDataFrame([("A / B", "long body", 25), ("A", "short", 3)], "path string, body string, word_count int")
    assert [r["content"] for r in section_summaries(parts).collect()] == ["[Summary] A / B: long body"]
