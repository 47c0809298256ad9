"""Line dedup, near copies and components against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemolith.llm import op1_line_dedup as lines
from mnemolith.llm import op4_near_dedup as near
from mnemolith.llm.components import connected

CLASHES = ["bucket", "node", "lines", "size", "band", "key", "at", "root", "sig", "doc_key", "near", "label", "__id", "__key", "__dropped", "__gone", "__gone_key"]


def frame(spark, rows, extra=()):
    df = spark.createDataFrame([(i, t, "en", f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in extra})


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows):
    """{doc: (same, near, dropped)} by comparing all classes of lines."""
    said = [((i, no), tuple(w)) for i, t in rows for no, line in enumerate((t or "").split("\n")) if (w := lines.words_of(line))]
    first = {}
    for at, w in sorted(said):
        first.setdefault(w, at)
    classes = list(first)
    by_length = defaultdict(list)
    for w in classes:
        by_length[len(w)].append(w)

    def is_near(w):
        if len(w) < lines.LEAST_WORDS:
            return False
        return any(first[v] < first[w] and min(len(v), len(w)) >= lines.LEAST_WORDS and v != w and edits(v, w) == 1 for n in (-1, 0, 1) for v in by_length[len(w) + n])

    flagged = {w: is_near(w) for w in classes}
    out = defaultdict(lambda: [0, 0, []])
    for at, w in said:
        if flagged[w] or at > first[w]:
            out[at[0]][flagged[w]] += 1
            out[at[0]][2].append(at[1])
    return {k: (a, b, ",".join(map(str, sorted(c)))) for k, (a, b, c) in out.items()}


def word_rows(seed=1):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 7, 8, 9, 12, 30]))] for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[at : at + (kind != 0)] = [] if kind == 1 and len(w) > 1 else ["edit%d" % rng.randrange(3)]
            text.append(" ".join(w))
        rows.append((i, "\n".join(text)))
    return rows


def report(df):
    return {r["doc_id"]: (r["n_same"], r["n_near"], r["dropped"]) for r in df.collect() if r["dropped"]}


def test_lines_against_brute_force(spark):
    rows = word_rows()
    want = brute_lines(rows)
    assert any(b for _, b, _ in want.values()) and any(a for a, _, _ in want.values())
    assert report(lines.line_report(frame(spark, rows, CLASHES))) == want


def test_short_lines_are_near_on_demand(spark):
    rows = [(1, "part one"), (2, "part two\nother words"), (3, "single"), (4, "part one of")]
    got = {r["doc_id"]: (r["n_near"], r["dropped"]) for r in lines.line_report(frame(spark, rows), least_words=1).collect()}
    assert got == {1: (0, ""), 2: (1, "0"), 3: (0, ""), 4: (1, "0")}
    assert not any(r["dropped"] for r in lines.line_report(frame(spark, rows)).collect())


def test_a_line_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(lines, "SLICE", 3)
    rows = word_rows(4)
    assert report(lines.line_report(frame(spark, rows))) == brute_lines(rows)


def test_lines_without_documents(spark):
    empty = frame(spark, [])
    assert lines.line_report(empty).count() == 0 and lines.dedup_lines(empty).count() == 0


def test_dedup_lines(spark):
    a, b = "one two three four five six seven eight nine", "other words of a line that stands alone here"
    rows = [(1, f"{a}\n\n{b}"), (2, f"{a}\nkept"), (3, a.replace("five", "FIVE")), (4, None), (5, ""), (6, "\n"), (7, f"{a} ten\nx"), (None, "null id first\nkept"), (8, "kept"), (8, "kept"), (9, "w " * 20000)]
    df = frame(spark, rows, CLASHES)
    got = lines.dedup_lines(df)
    assert got.columns == df.columns
    texts = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=str)
    assert texts == sorted([(1, f"{a}\n\n{b}", len(a) + len(b) + 2), (4, None, None), (5, "", 0), (6, "\n", 1), (7, "x", 1), (None, "null id first\nkept", 18), (9, "w " * 20000, 40000)], key=str)
    assert all(r["bucket"] == "own bucket" for r in got.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=7), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=7))
def test_one_edit(a, b):
    assert lines.within_one_edit(a, b) == (edits(a, b) <= 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=8, max_size=12), st.integers(0, 11), st.integers(0, 2), st.sampled_from([b"a", b"b", b"x"]))
def test_ends_are_shared_by_near_lines(a, at, kind, word):
    b = list(a)
    at = min(at, len(b) - 1)
    b[at : at + (kind != 0)] = [] if kind == 1 else [word]
    if min(len(a), len(b)) >= lines.LEAST_WORDS:
        assert set(lines.end_keys(a)) & set(lines.end_keys(b))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, threshold=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = set()
    for members in holders.values():
        for p, i in enumerate(members):
            for j in members[p + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                        parent[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(least.get(find(n), i), i)
    return sorted((i, len(sets[n]), least[find(n)], i == least[find(n)]) for n, (i, _) in enumerate(rows))


def components(df, **how):
    return sorted(tuple(r) for r in near.near_components(df, **how).select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_copies_against_brute_force(spark, small, threshold):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert components(df, threshold=threshold) == brute_components(rows, threshold)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def test_large_groups_of_near_copies(spark):
    """Groups with far more members than a small bucket: most are too different from the group's centre, some only link to each other."""
    rng = random.Random(3)
    rows = []
    for g in range(3):
        base = [f"g{g}w{rng.randrange(1000)}" for _ in range(150)]
        far = edited(rng, base, 4).split()
        for _ in range(70):
            rows.append(edited(rng, base, rng.choice([0, 1, 1, 2, 2, 3, 3, 4, 5, 8])))
        for _ in range(40):
            rows.append(edited(rng, far, rng.choice([0, 1, 2])))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert components(frame(spark, rows)) == brute_components(rows)


def templated(n, fields, values, seed=1):
    """Pages of 160 words that are alike but for some fields, each with one of some values: many alike pairs, few links."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"t{k}" for k in range(160)]
        for f in range(fields):
            words[8 + 150 // fields * f] = f"f{f}v{rng.randrange(values)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("fields", "values", "most"), [(10, 6, 0.01), (6, 30, 0.1)])
def test_templated_pages(spark, monkeypatch, fields, values, most):
    """Links are found by joining a small share of all pairs of a template's pages."""
    rows, joined, across = templated(700, fields, values), [], near.across

    def counted(*args):
        pairs = across(*args)
        joined.append(pairs.count())
        return pairs

    monkeypatch.setattr(near, "across", counted)
    got = components(frame(spark, rows))
    assert got == brute_components(rows)
    assert sum(joined) <= most * len(rows) ** 2 / 2, joined


def test_differences_reach_their_levels():
    """The bounds that choose a node's levels hold for random sets at the threshold."""
    rng = random.Random(5)
    for threshold in (80, 85):
        f, ranges = (100 - threshold) / (100 + threshold), near.level_ranges(threshold)
        for _ in range(2000):
            core, universe = set(range(rng.randrange(1, 200))), rng.randrange(200, 400)
            a = set(rng.sample(range(universe), rng.randrange(20, 200)))
            b = set(a)
            for x in rng.sample(range(universe), rng.randrange(0, 40)):
                b ^= {x}
            both = len(a & b)
            if not b or 100 * both < threshold * (len(a) + len(b) - both):
                continue
            d, e = a ^ core, b ^ core
            share = (len(d) + len(e)) / (len(a) + len(b))
            least = min(len(d) / len(a), len(e) / len(b))
            for x, n in ((d, len(a)), (e, len(b))):
                low, high = near.reach(len(x), n, least, threshold)
                assert low - 1e-9 <= share <= high + 1e-9
            if d | e and share > f:
                assert len(d & e) / len(d | e) >= (share - f) / (share + f) - 1e-9
            for low, high in ranges:
                if low <= share < high:
                    assert len(d) < high * len(a) or len(e) < high * len(b)


def test_copies_edges(spark):
    five = "a b c d e"
    rows = [(5, five), (3, five.upper()), (9, "short text"), (4, "short  TEXT"), (1, None), (2, ""), (7, " \n"), (8, "a b c d e f"), (11, "w " * 30000), (12, "w " * 29999)]
    got = components(frame(spark, rows, CLASHES))
    assert got == brute_components(rows)
    assert near.near_components(frame(spark, [])).count() == 0
    with_null = near.near_components(frame(spark, [(None, five), (2, five), (None, "other one"), (6, "x y"), (6, "x y")])).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in with_null), key=str) == sorted([(None, 2, False), (2, 2, True), (None, None, True), (6, 6, True), (6, 6, True)], key=str)
    kept = near.keep_one(frame(spark, rows, CLASHES))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _, k in got if k] and kept.columns == frame(spark, rows, CLASHES).columns


def test_keep_one_with_null_and_shared_ids(spark):
    """A near copy without an id goes alone: other texts without one stay, and so do other texts under a shared id."""
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(2, base), (None, base), (None, base + " more"), (None, "a text of its own here"), (None, None), (7, base + " more"), (7, "seven has another text too")]
    got = near.keep_one(frame(spark, rows, CLASHES)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(2, base), (None, "a text of its own here"), (None, None), (7, "seven has another text too")], key=str)


def test_sets_of_texts_without_ids_meet_only_their_own(spark):
    df = frame(spark, [(None, f"text number {i} of many") for i in range(40)])
    nodes = near.nodes_of(df, near.WORDS).select("node", "doc_id", "text_key")
    met = near.sets_of(df, nodes, near.WORDS)
    assert met.count() == 40
    joined = [line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joined) == 1 and "text_key" in joined[0] and "w_key" in joined[0]


def test_pruning_is_sound():
    need = near.least_matches(85, near.MISS)
    assert len(need) == near.HASHES // near.BATCH and list(need) == sorted(need) and need[-1] < 0.85 * near.HASHES
    assert near.beta_tail(1, 1, 0.85) == pytest.approx(0.15) and near.beta_tail(3, 1, 0.5) == pytest.approx(1 - 0.5**3)


def test_components(spark):
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("x", "y"), ("y", "z"), ("z", "x")] + [("hub", f"s{i}") for i in range(50)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {f"n{i:02d}": "n00" for i in range(31)} | {"x": "x", "y": "x", "z": "x", "hub": "hub"} | {f"s{i}": "hub" for i in range(50)}
    assert connected(spark.createDataFrame([], "a string, b string")).count() == 0
