"""Transport streams, token files, SentencePiece spans, fingerprints and token counts."""

from __future__ import annotations

import hashlib
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from mnemolith.llm import op2_transport_stream as ts
from mnemolith.llm import op3_token_files as tf
from mnemolith.llm import op6_sentencepiece as sp
from mnemolith.llm import op7_fingerprints as fp
from mnemolith.llm import op8_token_counts as tc
from mnemolith.llm.common import bucket_of, order_bounds

ODD = [None, "", " ", "a", "a  b", " a", "a ", "a\n\nb", "\n", "don't 12 3.5, x.", "é ü, ß. 日本 語", "x y", "a\tb", "▁a b▁c", "🙂" * 9, "ab..", "x " * 9000, "<s> </s>", "w\r\nx", "\x00\x01"]
CLASHES = ["bucket", "place", "fp", "seq", "media", "n_tokens", "start", "copy", "n_bytes", "ids"]


def frame(spark, rows, extra=CLASHES):
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in extra})


def documents(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("size", [1, 160, 161, 175, 176, 177, 343, 344, 345, 346, 18432, 18433, 200_000])
def test_stream_round_trip(size):
    payload = bytes(i * 7 % 251 for i in range(size))
    media = ts.write_stream(payload)
    got = ts.read_stream(media)
    assert len(media) % 188 == 0 and got.payload == payload and not (got.gaps or got.broken_units or got.out_of_step)
    assert (got.program, got.pid, got.stream_type) == (1, 256, 6) and got.random_access[0] and sum(got.sizes) == size
    assert got.timestamps == [ts.TICKS * k for k in range(len(got.sizes))] and got.random_access == [k % ts.GROUP == 0 for k in range(len(got.sizes))]


def test_checksum():
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_damaged_streams():
    media = bytearray(ts.write_stream(bytes(100_000)))
    cut = ts.read_stream(bytes(media[: 188 * 20] + media[188 * 21 :]))
    assert cut.gaps == 1 and cut.broken_units == 1 and len(cut.payload) < 100_000
    shifted = ts.read_stream(b"zz" + bytes(media))
    assert shifted.out_of_step == 2 and len(shifted.payload) == 100_000
    doubled = ts.read_stream(bytes(media[: 188 * 21] + media[188 * 20 :]))
    assert len(doubled.payload) == 100_000 and doubled.gaps == 0
    media[188 * 5 + 1] |= 0x80
    assert ts.read_stream(bytes(media)).flagged == 1
    for junk in (b"", b"G", b"abc" * 400, bytes([0x47]) * 940, bytes(media[:300])):
        ts.read_stream(junk)


def test_media_contract(spark, small):
    rows = documents(spark, small)[:40] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (10_000, None)]
    got = ts.media_digests(ts.as_media(frame(spark, rows))).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=str) == sorted(want, key=str)
    units = ts.media_units(ts.as_media(frame(spark, [(1, "x" * 50_000)]))).first()
    assert len(units["units"]) == 3 and units["units"][0]["random_access"] and len(units["payload"]) % 576 == 0
    assert ts.media_digests(ts.as_media(frame(spark, []))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(gaps):
    values = np.cumsum(np.array(gaps, dtype=np.int64)) if gaps else np.array([], dtype=np.int64)
    code = tf.EliasFano.build(values)
    assert code.values().tolist() == values.tolist()
    assert [code.select(i) for i in range(0, len(values), 13)] == values[::13].tolist()
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    code = tf.EliasFano.build(np.arange(1, 10_001) * 400)
    assert code.n_bytes < 10_000 * 1.5


def test_token_files(spark, small, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = documents(spark, small) + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (10_003, "a again")]
    tf.write_token_files(frame(spark, rows), str(tmp_path / "f"), path, shard_ids=20_000, buckets=7)
    got = [tuple(r) for r in tf.read_token_files(spark, str(tmp_path / "f")).orderBy("start").collect()]
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert spark.read.parquet(str(tmp_path / "f")).count() > 7
    blob = spark.read.parquet(str(tmp_path / "f")).orderBy("bucket", "seq").first()["blob"]
    shard = tf.Shard(bytes(blob))
    assert shard.document(0).tolist() == library.encode("null id").ids + [2] and shard.doc_id(0) is None
    far = [None, None, -(1 << 63), -5, -5, 0, 7, (1 << 63) - 1]
    packed = tf.Shard(tf.pack_shard(far, [bytes([i, 0]) for i in range(8)], 2))
    assert [packed.doc_id(i) for i in range(8)] == far and [packed.document(i).tolist() for i in range(8)] == [[i] for i in range(8)]
    tf.write_token_files(frame(spark, []), str(tmp_path / "e"), path)
    assert tf.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_buckets(spark):
    ids = spark.range(0, 5000).select((F.col("id") * F.col("id") - 1000).alias("i"))
    for n in (1, 5, 300, 700):
        bounds = order_bounds(ids, "i", n)
        got = ids.select("i", bucket_of(F.col("i"), bounds).alias("b")).toPandas()
        assert (got["b"] == np.searchsorted(bounds, got["i"], side="right")).all()


def test_pieces_contract(spark, small):
    model = sp.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = documents(spark, small)[:60] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id")]
    got = {(r["doc_id"]): r for r in sp.piece_digests(frame(spark, rows), model).collect()}
    for i, t in rows:
        ids = library.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        assert got[i]["spans_cover"]
    row = sp.encode_pieces(frame(spark, [(1, "né  x")]), model).first()
    assert "".join("né  x".encode()[a:b].decode(errors="replace") for a, b in zip(row["starts"], row["ends"], strict=True)) == "né  x"
    assert sp.piece_digests(frame(spark, []), model).count() == 0


NORMAL = ["ＡＢ ①  ｶﾞ x", "  a  b ", "é", "ﬁn", "㍻", "​q", "a　b", "한글", "", " ", "plain text", "½ ™ Ⅷ", "x\ty\nz"]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_normaliser_follows_the_compiled_map(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    chars = sp.CharacterMap(spec.precompiled_charsmap)
    for text in NORMAL:
        norm, source = sp.normalise(text.encode(), chars, prefix=spec.add_dummy_prefix, squeeze=spec.remove_extra_whitespaces)
        assert norm.decode() == library.normalize(text)
        assert len(source) == len(norm) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())


def brute_fingerprint(spark, texts):
    """Votes in Python, with Spark's own hash of each term."""
    terms = []
    for n, t in enumerate(texts):
        w = t.strip(" \t\n\v\f\r").lower()
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w)]
        terms += [(n, w[i], w[i + 1] if i + 1 < len(w) else None, w[i + 2] if i + 2 < len(w) else None) for i in range(len(w))]
    hashed = spark.createDataFrame(terms, "n int, a string, b string, c string").select("n", "a", F.xxhash64("a", "b", "c").alias("h")).collect()
    votes = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    for r in hashed:
        weight = len(r["a"].encode())
        votes[r["n"]] += weight * np.array([r["h"] >> b & 1 for b in range(64)])
        total[r["n"]] += weight
    return [sum(1 << b for b in range(64) if 2 * v[b] > t) for v, t in zip(votes, total, strict=True)]


def test_fingerprint_contract(spark, small):
    rows = documents(spark, small)[:80] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    got = {r["doc_id"]: r for r in fp.fingerprint_table(frame(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]
    own = brute_fingerprint(spark, texts)
    changed = [t[: len(t) - len(t) // 4] + texts[(n + 1) % len(texts)][: len(t) // 4] for n, t in enumerate(texts)]
    other = brute_fingerprint(spark, changed)
    like = lambda a, b: 1 - (a ^ b).bit_count() / 64
    for n, (i, _) in enumerate(rows):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[n]), hashlib.sha256(changed[n].encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{own[n]:016x}", f"{other[n]:016x}")
        assert r["near_edited"] == like(own[n], other[n]) and r["near_next"] == like(own[n], own[(n + 1) % len(rows)])
        near = sum((own[n] ^ x).bit_count() <= fp.RADIUS for x in own)
        assert r["n_within_radius"] == (near if i % 100 == 0 else None)


def test_fingerprint_edges(spark):
    assert fp.fingerprint_table(frame(spark, [])).count() == 0
    alone = fp.fingerprint_table(frame(spark, [(5, "abcd efgh")])).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()
    rows = [(None, "null first"), (1, "x y z"), (1, "x y z"), (2, "")]
    got = sorted((str(r["doc_id"]), r["near_next"]) for r in fp.fingerprint_table(frame(spark, rows)).collect())
    assert len(got) == 4 and got[0] == ("1", 1.0) or got[1] == ("1", 1.0)


def test_many_ranges(spark):
    rows = [(i * 3, f"text {i} " + "w" * (i % 9)) for i in range(1500)]
    got = fp.with_next(frame(spark, rows, []), 400).where("copy = 0").select("doc_id", "next_text").toPandas().set_index("doc_id")["next_text"]
    assert len(got) == 1500 and all(got[i] == rows[(n + 1) % 1500][1] for n, (i, _) in enumerate(rows))


def test_radius_search_finds_all(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 40)
    fps = sorted({int(np.int64(b) ^ np.int64(sum(1 << int(x) for x in rng.choice(63, k, replace=False)))) for b in base for k in (0, 1, 2, 3, 4, 5) for _ in range(4)})
    df = spark.createDataFrame([(f, 1) for f in fps], "fp long, n int")
    got = {r["fp"]: r["near"] for r in fp.within_radius(df, df, 3, 2).collect()}
    assert got == {f: sum(((f ^ g) & (1 << 64) - 1).bit_count() <= 3 for g in fps) for f in fps}


def test_no_python_in_fingerprints(spark, small):
    plan = fp.fingerprint_table(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def changes(spark, rows):
    names = "batch long, op string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long"
    return spark.createDataFrame(rows, names)


def test_rollup(spark, tmp_path):
    roll = tc.Rollup(spark, str(tmp_path / "r"))
    one = changes(spark, [(1, "insert", "a", "en", "t1", 10, None, None, None, None), (1, "insert", "a", "en", "t1", 5, None, None, None, None), (1, "insert", None, None, "t1", None, None, None, None, None)])
    two = changes(spark, [(2, "revise", "a", "en", "t2", 12, "a", "en", "t1", 10), (2, "delete", None, None, None, None, "a", "en", "t1", 5)])
    roll.commit(one)
    roll.commit(two)
    want = {("a", "en", "t2", 1, 12), (None, None, "t1", 1, 0)}
    assert {tuple(r) for r in roll.totals().collect()} == want
    roll.commit(two)
    roll.commit(one.unionByName(two))
    assert {tuple(r) for r in roll.totals().collect()} == want
    folded = roll.fold(str(tmp_path / "s"), 2)
    folded.commit(changes(spark, [(3, "insert", "b", "de", "t1", 7, None, None, None, None)]))
    assert {tuple(r) for r in folded.totals().collect()} == want | {("b", "de", "t1", 1, 7)}
    assert tc.deltas(changes(spark, [])).count() == 0


def test_redelivery_after_a_fold(spark, tmp_path):
    one, two, three, late = (changes(spark, [(n, "insert", "a", "en", "t1", 10**n, None, None, None, None)]) for n in (1, 2, 4, 3))
    roll = tc.Rollup(spark, str(tmp_path / "r"))
    for batch in (one, two, three):
        roll.commit(batch)
    folded = roll.fold(str(tmp_path / "s"), 2).fold(str(tmp_path / "t"), 3)
    for again in (two, one, one.unionByName(two).unionByName(three)):
        folded.commit(again)
        assert {tuple(r) for r in folded.totals().collect()} == {("a", "en", "t1", 3, 10110)}
    folded.commit(late)
    assert {tuple(r) for r in tc.Rollup(spark, folded.path).totals().collect()} == {("a", "en", "t1", 4, 11110)}


def test_an_empty_redelivery_takes_its_batch_back(spark, tmp_path):
    one, two = (changes(spark, [(n, "insert", "a", "en", "t1", 10**n, None, None, None, None)]) for n in (1, 2))
    roll = tc.Rollup(spark, str(tmp_path / "r"))
    roll.commit(one.unionByName(two), [1, 2])
    roll.commit(changes(spark, []), [2, 7])
    assert {tuple(r) for r in roll.totals().collect()} == {("a", "en", "t1", 1, 10)}
    folded = roll.fold(str(tmp_path / "s"), 2)
    folded.commit(changes(spark, []), [1, 2])  # final
    assert {tuple(r) for r in folded.totals().collect()} == {("a", "en", "t1", 1, 10)}
    roll.commit(two, [1, 2])
    assert {tuple(r) for r in roll.totals().collect()} == {("a", "en", "t1", 1, 100)}


def test_rollup_of_documents_equals_a_recount(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    got = {tuple(r) for r in tc.op8_token_counts(spark, small).collect()}
    n = docs.assign(w=docs.text.str.encode("utf-8").map(lambda b: len(b.split())))
    n = n[n.lang != "en"].groupby(["source", "lang"]).agg(d=("w", "size"), t=("w", "sum"))
    assert sum(g[3] for g in got) == len(docs)
    assert {g for g in got if g[1] != "en"} == {(s, lang, "words-1", r.d, r.t) for (s, lang), r in n.iterrows()}


def test_token_files_of_a_frame_without_statistics(spark, tmp_path):
    """Ranges come from the bytes of the texts, so small rows of unknown size make few; rows without an id are spread over ranges too."""
    rows = [(None if i % 3 == 0 else i, f"two words{i}") for i in range(2000)]
    began = time.time()
    tf.write_token_files(frame(spark, rows), str(tmp_path / "f"), public_tokenizers.path("byte_bpe_50k.json"))
    assert time.time() - began < 60
    got = tf.read_token_files(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    ranges = spark.read.parquet(str(tmp_path / "f"))
    assert ranges.count() <= 16 and ranges.select("bucket").distinct().count() > 12


def test_tokenizer_counts_cover_every_document(spark, small):
    """A recount of all rows, short and empty ones too, by the tokenizers themselves."""
    docs = pd.read_parquet(f"{small}/documents.parquet")
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for source, lang, text in zip(docs["source"], docs["lang"], docs["text"].fillna(""), strict=True):
        for name, n in (("piece_bpe_32k", len(pieces.encode(text))), ("byte_bpe_50k", len(whole.encode(text, add_special_tokens=False).ids))):
            had = want.get((source, lang, name), (0, 0))
            want[source, lang, name] = (had[0] + 1, had[1] + n)
    got = tc.op8_tokenizer_counts(spark, small).collect()
    assert {tuple(r) for r in got} == {(*key, d, n) for key, (d, n) in want.items()}
    assert sum(r["n_docs"] for r in got) == 2 * len(docs)


def test_only_short_documents_still_count(spark):
    rows = spark.createDataFrame([("tiny", "en", "one two"), ("tiny", None, None), (None, "de", "")], "source string, lang string, text string")
    got = tc.deltas(tc.tokenizer_history(rows)).groupBy(*tc.KEY).agg(F.sum("docs").alias("n"), F.sum("tokens")).where("n <> 0").collect()
    assert {tuple(r)[:4] for r in got} == {(*key, name, 1) for key in (("tiny", "en"), ("tiny", None), (None, "de")) for name in ("piece_bpe_32k", "byte_bpe_50k")}
