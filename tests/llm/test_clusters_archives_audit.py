"""Centroids, archives and the audit of filters against plain loops, on rows made by hand."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from mnemolith.llm import op11_centroids as clusters
from mnemolith.llm import op12_warc_chunks as warc
from mnemolith.llm import op13_filter_audit as audit

# ---- centroids


def plain_lloyd(rows, k, rounds, dimensions, scale=256, seed=2):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else old for n, old in enumerate(centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    near = lambda c: [float(np.float32(x)) for x in rng.normal(c, 0.6, 20)]
    rows = [(i, near(i % 5 - 2)) for i in range(150)]
    rows += [(500 + i, [0.25] * 20) for i in range(60)]  # one vector many times
    rows += [(7, near(1)), (7, near(1)), (None, near(-1)), (None, [0.25] * 20)]
    bad = [(900, None), (901, []), (902, [1.0] * 19), (903, [1.0] * 21), (904, [None] + [1.0] * 19), (905, [float("nan")] + [1.0] * 19), (906, [float("inf")] + [1.0] * 19), (907, [float("-inf")] * 20)]
    return rows + bad


def vector_frame(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(f"own {c}") for c in ("chunk", "shard", "rows", "ids", "block", "cluster", "distance", "v")})
    return df.repartition(parts) if rows else df


@pytest.mark.parametrize("k", [1, 7, 40])
def test_centroids_like_a_plain_loop(spark, vectors, k):
    got = clusters.cluster_vectors(vector_frame(spark, vectors), k, 3, dimensions=20)
    assert got.columns == [c.split()[0] for c in clusters.OUT.split(", ")]
    assert ordered(tuple(r) for r in got.collect()) == ordered(plain_lloyd(vectors, k, 3, 20))


def test_fewer_vectors_than_centroids_and_none(spark, vectors):
    few = vectors[:3] + [(3, vectors[0][1])]
    got = clusters.cluster_vectors(vector_frame(spark, few, 2), 40, 5, dimensions=20)
    assert ordered(tuple(r) for r in got.collect()) == ordered(plain_lloyd(few, 40, 5, 20))
    assert clusters.cluster_vectors(vector_frame(spark, [])).collect() == []
    assert clusters.cluster_vectors(vector_frame(spark, vectors[-8:]), dimensions=20).collect() == []


def test_partial_distances_are_exact_for_large_components():
    rng = np.random.default_rng(1)
    for top in (300, clusters.EXACT - 1, clusters.LIMIT):
        block, centroids = (rng.integers(-top, top + 1, (n, 16)) for n in (9, 4))
        plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids] for x in block]
        assert clusters.partial_distances(block.astype(np.int32), centroids).tolist() == plain


def test_components_beyond_the_limit_are_held_to_it(spark):
    row = clusters.whole_vectors(spark.createDataFrame([(1, [1e30, -1e30, -0.001, 2.0])], "vec_id long, embedding array<double>"), 4).first()
    assert row["v"] == [1 << 27, -(1 << 27), -1, 512]


def test_a_shard_never_sees_other_columns(spark, vectors):
    blocks = clusters.column_blocks(clusters.whole_vectors(vector_frame(spark, vectors), 20), 20).collect()
    assert {(r["shard"], len(r["block"]) // r["rows"] // 4) for r in blocks} == {(0, 16), (1, 4)}
    by_chunk: dict[int, set] = {}
    for r in blocks:
        by_chunk.setdefault(r["chunk"], set()).add(r["shard"])
        assert (r["ids"] is None) == (r["shard"] != 0)
    assert all(v == {0, 1} for v in by_chunk.values())


# ---- archives

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (3, "http://a/3 x\r\ny", "<p>own é\r\n\r\n</p>"),
    (4, None, None), (5, "http://a/5", ""), (6, "http://a/6", "x" * 1000), (7, "http://a/7", "x" * 1000), (8, "http://a/8", "ab" * 700 + "\r\n\r\n"),
    (None, "http://a/n", "<p>same</p>"), (None, "http://a/m", "lone"), (10, "http://a/r", "twice"), (10, "http://a/r", "twice"),
]


def page_frame(spark, rows=PAGES, parts=3):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(f"own {c}") for c in ("rid", "raw", "size", "piece", "at", "chunk_no", "data", "sha1", "target", "chunks", "kept", "n")})
    return df.repartition(parts) if rows else df


def plain_records(rows, least=0):
    def expected(i, html):
        raw = (html or "").encode()
        alike = [k for k, _, h in rows if (h or "").encode() == raw]
        top = max((k for k in alike if k is not None), default=None)
        repeats = len(raw) >= least and len(alike) > 1
        return len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), top if repeats else None

    return [(i, *expected(i, h)) for i, _, h in rows]


@pytest.mark.parametrize(("chunk_bytes", "least"), [(64 << 10, 0), (7, 0), (256, 12)])
def test_archives_read_back(spark, tmp_path, chunk_bytes, least):
    path = str(tmp_path / "archive")
    warc.write_archives(warc.chunk_table(page_frame(spark), chunk_bytes=chunk_bytes), path, min_bytes=least, archive_bytes=900)
    got = warc.read_archives(spark, path).collect()
    assert ordered((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == ordered(r[:3] for r in plain_records(PAGES, least))
    for payload, top in {r[2]: r[3] for r in plain_records(PAGES, least)}.items():
        same = [r for r in got if r["payload_digest"] == payload]
        responses = [r for r in same if r["record_type"] == "response"]
        if top is None:
            assert len(responses) == len(same)
        else:
            assert [r["page_id"] for r in responses] == [top]
            assert all((r["refers_to"], r["refers_to_record"]) == (top, responses[0]["record_id"]) for r in same if r["record_type"] == "revisit")
    assert len({r["record_id"] for r in got}) == len(PAGES)
    assert {r["url"] for r in got if r["page_id"] == 3} == {"http://a/3%20x%0D%0Ay"}
    # Payloads come back in chunks.
    texts: dict[str, list] = {}
    for r in warc.read_payloads(spark, path).collect():
        assert len(r["data"]) <= chunk_bytes
        texts.setdefault(r["record_id"], []).append((r["chunk_no"], bytes(r["data"])))
    made = {k: b"".join(d for _, d in sorted(v)) for k, v in texts.items()}
    held = {r["record_id"]: r for r in got if r["record_type"] == "response"}
    assert set(made) == set(held)
    assert all(base64.b32encode(hashlib.sha1(raw).digest()).decode() == held[k]["payload_digest"] for k, raw in made.items())


def test_an_archive_is_a_warc_file(spark, tmp_path):
    """Another reader: the bytes of an archive by offset, cut by the lengths in the headers."""
    path = str(tmp_path / "archive")
    warc.write_archives(warc.chunk_table(page_frame(spark), chunk_bytes=100), path, archive_bytes=1500)
    files: dict[int, list] = {}
    for r in warc.archive_rows(spark, path).collect():
        files.setdefault(r["archive"], []).append((r["offset"], bytes(r["data"])))
    assert len(files) > 1
    index = {r["record_id"]: r for r in warc.record_index(spark, path).collect()}
    seen = 0
    for archive, rows in files.items():
        rows.sort()
        assert all(a[0] + len(a[1]) == b[0] for a, b in zip(rows, rows[1:], strict=False)) and rows[0][0] == 0
        blob, at = b"".join(d for _, d in rows), 0
        while at < len(blob):
            assert blob.startswith(b"WARC/1.1\r\n", at)
            end = blob.index(b"\r\n\r\n", at) + 4
            fields = dict(line.split(": ", 1) for line in blob[at:end].decode().strip().split("\r\n")[1:])
            done = end + int(fields["Content-Length"]) + 4
            assert blob[done - 4 : done] == b"\r\n\r\n"
            known = index[fields["WARC-Record-ID"]]
            assert (known["archive"], known["offset"], known["record_bytes"]) == (archive, at, done - at)
            if fields["WARC-Type"] == "response":
                payload = blob[end : done - 4].split(b"\r\n\r\n", 1)[1]
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            at, seen = done, seen + 1
    assert seen == len(PAGES) == len(index)


def test_chunks_carry_running_digests(spark):
    raw = b"<p>" + bytes(range(65, 91)) * 50
    rows = sorted(warc.chunk_table(page_frame(spark, [(1, "u", raw.decode())]), chunk_bytes=100).collect(), key=lambda r: r["chunk_no"])
    assert [len(r["data"]) for r in rows] == [100] * 13 + [3] and {r["chunks"] for r in rows} == {14}
    assert all(bytes(r["sha1"]) == hashlib.sha1(raw[: 100 * (i + 1)]).digest() for i, r in enumerate(rows))


def test_pieces_larger_than_one_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(warc, "PIECE_BYTES", 300)
    raw = b"0123456789" * 137
    rows = sorted(warc.chunk_table(page_frame(spark, [(1, "u", raw.decode()), (2, "v", "")]), chunk_bytes=100).collect(), key=lambda r: (r["page_id"], r["chunk_no"]))
    assert b"".join(bytes(r["data"]) for r in rows if r["page_id"] == 1) == raw and [r["chunk_no"] for r in rows] == [*range(14), 0]


def test_a_damaged_chunk_is_an_error(spark, tmp_path):
    path, bad = str(tmp_path / "archive"), str(tmp_path / "bad")
    warc.write_archives(warc.chunk_table(page_frame(spark), chunk_bytes=100), path)
    warc.archive_rows(spark, path).withColumn("data", F.when(F.col("chunk_no") == 3, F.lit(b"y" * 100)).otherwise(F.col("data"))).write.parquet(bad)
    with pytest.raises(PythonException, match="chunk 3 is not what was written"):
        warc.read_archives(spark, bad).collect()


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archives(warc.chunk_table(page_frame(spark, [])), path)
    assert warc.read_archives(spark, path).collect() == [] and warc.read_payloads(spark, path).collect() == []


# ---- audit

GOOD, LONG = "plain words of prose that go on", " ".join(f"w{i}" for i in range(230))
DOCS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, LONG, "a"), (2, LONG, "a"), (4, GOOD, "a"), (5, "", "a"), (6, None, None), (7, "A B # C", "b"), (8, "same " * 300, "b"),
    (9, LONG + " XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX", "b"), (10, LONG + " &", ""), (None, LONG, "a"), (None, "lone $", None), (11, "the one word" * 3, "b"), (12, GOOD, "b"), (12, GOOD, "b"), (13, "\t\n ", "a"), (14, LONG, None),
]
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (5, None, 1), (7, 0, 1), (12, 1, 0), (99, 1, 1), (None, 1, 1)]


def plain_audit(docs, marks):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    failed = []
    for i, t, s in docs:
        t = t or ""
        w = words(t)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * any(i is not None and k is not None and k < i and (u or "") == t for k, u, _ in docs)
        has = lambda c: any(k == i and i is not None and m[c] == 1 for k, *m in marks)  # noqa: E731, B023
        failed.append((s or "", fails, has(0), has(1)))
    out = []
    for part in {f[0] for f in failed}:
        removed_of: dict[str, int] = {}
        rows = []
        for order in permutations("ABCDE"):
            left = [f for f in failed if f[0] == part]
            gone: list = []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left = [d for d in left if f not in d[1]]
                removed_of[f] = removed_of.get(f, 0) + len(here)
                alone = sum(d[0] == part and d[1] == f for d in failed)
                rows.append([part, "".join(order), step, len(left), len(here), redundant, alone, sum(d[2] for d in here), sum(d[3] for d in here)])
                gone += here
        out += [(*r, removed_of[r[1][r[2] - 1]]) for r in rows]
    return out


def audit_frames(spark, docs, marks):
    own = lambda df: df.withColumns({c: F.lit(f"own {c}") for c in ("part", "bits", "digest", "n", "good", "cells", "first", "least")})
    return own(spark.createDataFrame(docs, "doc_id long, text string, source string")), own(spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


def test_audit_like_a_plain_loop(spark):
    got = audit.filter_audit(*audit_frames(spark, DOCS, MARKS))
    assert got.columns == [c.split()[0] for c in audit.COLUMNS.split(", ")]
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_audit(DOCS, MARKS))


def test_audit_without_documents_or_labels(spark):
    assert audit.filter_audit(*audit_frames(spark, [], MARKS)).collect() == []
    assert sorted(tuple(r) for r in audit.filter_audit(*audit_frames(spark, DOCS, [])).collect()) == sorted(plain_audit(DOCS, []))


def test_words_of_a_long_text_are_counted_over_all_slices(monkeypatch):
    text = b"".join(b"w%d%s" % (i % 700, b" \t\n\v\f\r"[i % 6 : i % 6 + 1]) for i in range(5000))
    monkeypatch.setattr(audit, "SLICE", 64)
    assert audit.word_counts(text) == (5000, 700) and audit.word_counts(b"x" * 1000) == (1, 1) and audit.word_counts(b"  ") == (0, 0) and audit.word_counts(b"") == (0, 0)


def test_the_first_step_of_an_order_counts_every_failure():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, (2, 3, 32))
    rows = audit.audit_rows(["x", "y"], counts)
    assert len(rows) == 1200 and rows.groupby(["part", "filter_order"])["removed"].sum().add(rows[rows["step"] == 5].set_index(["part", "filter_order"])["kept"]).eq(np.repeat(counts[:, 0].sum(axis=1), 120)).all()
    first = rows[rows["step"] == 1]
    assert (first["redundant"] == 0).all() and isinstance(rows, pd.DataFrame)
