"""Brute force, round trips and defined results of the llm operators."""

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ivlattice.llm import bpe, leaks, nearesttime, rolling, sharedspans

JSON_TWIN = "/opt/tokenizers/byte_bpe_50k.json"
needs_vocabulary = pytest.mark.skipif(not Path(bpe.DEFAULT_VOCABULARY).exists(), reason="no vocabulary here")
ODD_TEXTS = [
    "", " ", "\n\n  \t", "Hello world", "don't we'll I'M", "naïve café ﬁ Ⅷ ² ½", "日本語のテキスト テスト", "👩‍👩‍👧‍👦 emoji 🇩🇪", "<|endoftext|> is text",
    "a" * 5000, "ab" * 3000, " " * 3000, "x = 12345678901234567890\n\tprint( x )", "​﻿ zero width", "é combining", "\x00\x01 control", "İstanbul ǅ ß",
]


@pytest.fixture(scope="module")
def content():
    return bpe.read_vocabulary(bpe.DEFAULT_VOCABULARY)


@needs_vocabulary
def test_ids_equal_the_public_library(content):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(JSON_TWIN)
    t.encode_special_tokens = True
    e = bpe.Encoder(content)
    for text in ODD_TEXTS:
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids, text[:40]


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_decode_gives_the_text_back(text):
    content = bpe.read_vocabulary(bpe.DEFAULT_VOCABULARY)
    e = test_decode_gives_the_text_back.__dict__.setdefault("e", bpe.Encoder(content))
    ids = e.encode(text)
    strings = test_decode_gives_the_text_back.__dict__.setdefault("s", {i: b for b, i in bpe.parse_ranks(content).items()})
    assert b"".join(strings[i] for i in ids).decode() == text


@needs_vocabulary
def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "two words", 0), (3, "two words", 1)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_texts(df).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) == 2
    assert bpe.encode_texts(df.limit(0)).count() == 0


@needs_vocabulary
def test_decoding_a_table(spark, content):
    texts = [*ODD_TEXTS, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = bpe.encode_texts(df)
    assert {r.doc_id: r.text for r in bpe.decode_ids(ids).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.decode(bpe.Encoder(content).encode("naïve café"), content) == "naïve café"
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.text for r in bpe.decode_ids(null).collect()} == {""}


def nearest_brute(left, right, tol):
    out = {}
    for i, e, t in left:
        if e is None or t is None:
            continue
        c = [(abs(t - u), u, j) for j, f, u in right if f == e and u is not None and abs(t - u) <= tol]
        if c:
            out[i] = min(c)[2]
    return out


def test_nearest_in_time(spark):
    rng = random.Random(3)
    names = ["A"] * 6 + ["B", "C", None]
    left = [(i, rng.choice(names), rng.choice([None, *range(0, 400)])) for i in range(300)]
    right = [(i, rng.choice(names), rng.choice([None, *range(0, 400, 3)])) for i in range(200)]
    a = spark.createDataFrame(left, "left_id long, entity string, at long")
    b = spark.createDataFrame(right, "right_id long, entity string, at long")
    got = {r.left_id: r.right_id for r in nearesttime.nearest_in_time(a, b, 10, 50).collect()}
    assert got == nearest_brute(left, right, 10)
    assert nearesttime.nearest_in_time(a.limit(0), b, 10, 50).count() == 0
    assert nearesttime.nearest_in_time(a, b.limit(0), 10, 50).count() == 0


def test_nearest_in_time_over_cut_tables(spark):
    """A bucket longer than an Arrow table goes on with what lies within reach of the cut."""
    rng = random.Random(14)
    left = [(i, "AB"[i % 5 == 0], rng.randint(0, 3000)) for i in range(500)]
    right = [(i, "AB"[i % 3 == 0], rng.randint(0, 3000)) for i in range(300)]
    a = spark.createDataFrame(left, "left_id long, entity string, at long")
    b = spark.createDataFrame(right, "right_id long, entity string, at long")
    want = nearest_brute(left, right, 10)
    for most in (3, 40, 100_000):
        got = nearesttime.nearest_in_time(a, b, 10, 2000, most).collect()
        assert {r.left_id: r.right_id for r in got} == want and len(got) == len(want)


def spans_brute(docs, length):
    where = {}
    for d, t in docs:
        for s in range(len(t or "") - length + 1):
            where.setdefault(t[s : s + length], set()).add(d)
    out = []
    for d, t in docs:
        hit = [s for s in range(len(t or "") - length + 1) if where[t[s : s + length]] - {d}]
        runs = []
        for s in hit:
            if runs and s <= runs[-1][1]:
                runs[-1][1] = s + length
            else:
                runs.append([s, s + length])
        out += [(d, a, b) for a, b in runs]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_shared_spans(spark, seed):
    rng = random.Random(seed)
    word = lambda n, abc="abcé日": "".join(rng.choice(abc) for _ in range(n))
    common = [word(rng.randint(20, 120)) for _ in range(4)] + ["ab" * 40, "x" * 90]
    docs = [(1, None), (2, ""), (3, word(10))]
    for d in range(10, 40):
        parts = [word(rng.randint(0, 60)) if rng.random() < 0.5 else (c := rng.choice(common))[rng.randint(0, 15) : len(c) - rng.randint(0, 15)] for _ in range(4)]
        docs.append((d, "".join(parts)))
    docs += [(50, docs[10][1]), (51, docs[10][1]), (52, "x" * 300)]
    df = spark.createDataFrame([(None, docs[12][1])], "doc_id long, text string").union(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((r.doc_id, r.span_start, r.span_end) for r in sharedspans.shared_spans(df, length=30, k=18).collect())
    assert got == spans_brute(docs, 30)


def test_shared_spans_of_hot_seeds(spark):
    """Seeds and windows with more rows than a task may hold take the joins, with the same result."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    common = [word(70), "xy" * 50, word(40)]
    docs = [(d, word(rng.randint(0, 40)) + rng.choice(common)[rng.randint(0, 9) :] + word(rng.randint(0, 40)) + rng.choice(common)) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = spans_brute(docs, 30)
    for hot in (0, 3, 20):
        assert sorted((r.doc_id, r.span_start, r.span_end) for r in sharedspans.shared_spans(df, length=30, k=18, hot=hot).collect()) == want


def test_spans_of_nothing(spark):
    assert sharedspans.shared_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_keeps_every_anchor_and_order():
    start, end, other = np.array([0, 50, 60, 120]), np.array([40, 55, 110, 150]), np.array([1000, 200, 1062, 1125])
    c = sharedspans.chain(start, end, other)
    assert (c >= 0).all() and c[0] == c[2] == c[3] and c[1] != c[0]


def test_sliding_min_and_hash():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 7, 200):
        assert (rolling.sliding_min(v, w) == [v[i : i + w].min() for i in range(200 - w + 1)]).all()
    with np.errstate(over="ignore"):
        points, _ = rolling.code_points(["abcabcxabc"])
        pre = rolling.prefix(points)
        h = rolling.window_hash(pre, np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]


def words_of(t):
    import regex

    return regex.findall(leaks.WORD, (t or "").lower())


def leaks_brute(docs, items):
    grams = lambda t: {tuple(w[i : i + 12]) for w in [words_of(t)] for i in range(len(w) - 11)}
    gi = {i: grams(t) for i, t in items}
    return sorted((d, i) for d, t in docs for i in gi if grams(t) & gi[i])


def test_leaks(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta épsilon zeta 7 42".split()) + str(rng.randint(0, 300)) for _ in range(n))
    items = [(i, say(rng.randint(5, 40))) for i in range(20)] + [(90, None), (91, "")]
    docs = [(1, None), (2, ""), (3, say(2000))]
    for d in range(10, 60):
        i, t = rng.choice(items[:20])
        w = t.split()
        a, n = rng.randint(0, 5), rng.choice([10, 11, 12, 13, 30])
        docs.append((d, say(rng.randint(0, 50)) + "\n## " + rng.choice([" ", "-", "\n"]).join(w[a : a + n]).upper() + " . " + say(3)))
    docs.append((70, docs[-1][1]))
    spec = "long, text string"
    found = leaks.leaked_items(spark.createDataFrame(docs, f"doc_id {spec}"), spark.createDataFrame(items, f"item_id {spec}"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == leaks_brute(docs, items)


def test_leaks_tolerate_substitutions():
    a = np.arange(1, 31, dtype=np.int64)
    b = a.copy()
    b[[5, 20]] = 0
    assert leaks.verify(a, 8, b, 8, 2) == (14, 30)
    assert leaks.verify(a, 8, b, 8, 1)[1] == 24


def near_brute(doc, item, substitutions):
    """Words of the longest stretch on any diagonal with so many differences at most."""
    best = 0
    for d in range(-len(item), len(doc)):
        a, b = max(0, d), min(len(doc), len(item) + d)
        miss = [a - 1, *[i for i in range(a, b) if doc[i] != item[i - d]], b]
        best = max([best, *(miss[min(i + 1 + substitutions, len(miss) - 1)] - miss[i] - 1 for i in range(len(miss) - 1))])
    return best


def test_recall_of_passages_with_substitutions(spark):
    """Of all passages of 20 words or more with one or two substitutions, by brute force, at least nine in ten are found whole."""
    rng = random.Random(15)
    word = lambda: f"w{rng.randint(0, 2000)}"
    items = [(i, [word() for _ in range(60)]) for i in range(40)]
    docs, want = [], {}
    for d in range(300):
        i, t = rng.choice(items)
        n = rng.randint(20, 45)
        piece = t[(a := rng.randint(0, 60 - n)) : a + n]
        for k in rng.sample(range(n), rng.randint(1, 2)):
            piece[k] = f"z{rng.randint(0, 10**6)}"
        docs.append((d, [word() for _ in range(20)] + piece + [word() for _ in range(20)]))
        want[(d, i)] = near_brute(docs[-1][1], t, 2)
    rows = lambda x: [(i, " ".join(w)) for i, w in x]
    found = leaks.overlaps(spark.createDataFrame(rows(docs), "doc_id long, text string"), spark.createDataFrame(rows(items), "item_id long, text string")).collect()
    right = sum(want.get((r.doc_id, r.item_id)) == r.near_words for r in found)
    assert min(want.values()) >= 20 and right >= 0.9 * len(want) and right >= 0.95 * len(found)


def test_repeated_words_make_few_rows(spark):
    docs = [(1, " ".join(["ha"] * 2000)), (2, " ".join(["ha", "ho"] * 500 + ["x"] + ["ha", "ho"] * 300))]
    items = [(1, " ".join(["ha"] * 60)), (2, " ".join(["ho", "ha"] * 40))]
    seeds = leaks._clusters(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", 36, None).selectExpr("id", "size(hits) n").collect()
    assert sum(r.n for r in seeds) < 60
    got = leaks.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 60, 60), (2, 2, 80, 80)]


def test_filter_lets_all_evaluation_seeds_through(spark):
    seeds = spark.range(40_000).selectExpr("xxhash64(id) seed")
    own = np.array([r.seed for r in seeds.collect()], np.int64).view(np.uint64)
    other = np.array([r.seed for r in spark.range(10**6, 10**6 + 100_000).selectExpr("xxhash64(id) seed").collect()], np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        keep = leaks._filter(seeds)
        assert len(leaks._pass(keep, own)) == 40_000 and len(leaks._pass(keep, other)) < 100


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert leaks.leaked_items(none, items).count() == 0


def test_edit_distance():
    assert [sharedspans.edit_distance(a, b) for a, b in (("", ""), ("abc", ""), ("kitten", "sitting"), ("日本", "日x本"))] == [0, 3, 3, 1]


def edit_brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_against_brute_force():
    rng = random.Random(22)
    for n in (0, 1, 3, 20, 90, 200):
        for abc in ("ab", "abcdefghij日"):
            a = "".join(rng.choice(abc) for _ in range(n))
            for b in ("".join(rng.choice(abc) for _ in range(rng.randint(0, 150))), a[: n // 3] + "zz" + a[n // 2 :], a[::-1], "z" + a + "zzz"):
                assert sharedspans.edit_distance(a, b) == sharedspans.edit_distance(b, a) == edit_brute(a, b)


def test_fuzzy_passages(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    x, y = word(60), word(80)
    docs = [(1, word(20) + x + "QQQQ" + y), (2, x + "RRRRR" + y + word(9)), (3, word(200)), (4, None)]
    got = sharedspans.passages(spark.createDataFrame(docs, "doc_id long, text string"), length=30, k=18).collect()
    assert {(r.doc_id, r.partner, r.span_start, r.span_end, r.n_anchors, r.edits) for r in got} == {(1, 2, 20, 164, 2, 5), (2, 1, 0, 145, 2, 5)}
    assert all(abs(r.similarity - (1 - 5 / 145)) < 1e-12 for r in got)


def test_passages_with_every_partner(spark):
    """B and C are near copies; two lower ids hold one half each, and one of them holds a piece twice."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    x, y, z = word(60), word(80), "pq" * 40
    docs = [(1, x + "1" * 9), (2, y + "2" * 7), (3, "3" * 11 + x + y), (4, x + y + "44444"), (5, x + y + "55555")]
    docs += [(6, docs[3][1]), (7, "R" + z), (8, "S" + z[:50]), (9, "TT" + y + "UU" + y)]
    got = sharedspans.passages(spark.createDataFrame(docs, "doc_id long, text string"), length=30, k=18).collect()
    rows = {(r.doc_id, r.partner, r.span_start, r.span_end, r.partner_start, r.partner_end, r.exact_chars) for r in got}
    assert len(rows) == len(got) and {(b, a, u, v, s, e, n) for a, b, s, e, u, v, n in rows} == rows
    text = dict(docs)
    assert all(text[a][s:e] == text[b][u:v] for a, b, s, e, u, v, n in rows if n == e - s)
    near = {r for r in rows if {r[0], r[1]} <= {3, 4, 5, 6}}
    assert {(3, 4, 11, 151, 0, 140, 140), (3, 5, 11, 151, 0, 140, 140), (6, 4, 0, 145, 0, 145, 145)} <= near
    assert {(a, b) for a, b, *_ in near} == {(3, 4), (4, 3), (3, 5), (5, 3), (4, 5), (5, 4), (4, 6), (6, 4)}
    assert {(a, b, s, e) for a, b, s, e, *_ in rows if a == 1} == {(1, b, 0, 60) for b in (3, 4, 5)}
    assert {(s, e, u, v) for a, b, s, e, u, v, _ in rows if (a, b) == (2, 9)} == {(0, 80, 2, 82), (0, 80, 84, 164)}
    periodic = {(s - 1, e - 1, u - 1, v - 1) for a, b, s, e, u, v, _ in rows if (a, b) == (7, 8)}
    assert {(2 * i, 2 * i + 50, 0, 50) for i in range(16)} <= periodic


def test_steps_of_periodic_seeds():
    of, seed, place = np.array([0, 0, 0, 0, 1, 1]), np.array([5, 5, 5, 6, 6, 6]), np.array([0, 2, 4, 9, 0, 3])
    first, step, count = sharedspans._runs(of, seed, place)
    assert first.tolist() == [0, 3, 4] and step.tolist() == [2, 0, 3] and count.tolist() == [3, 1, 2]
    closed = {(q - p, x) for p, e, q in sharedspans._hits(10, 2, 4, 50, 2, 3, 8) for x in range(p, e)}
    assert closed == {(q - p, x) for p in range(10, 18, 2) for q in range(50, 56, 2) for x in range(p, p + 8)}


def test_passages_from_seeds_alone(spark):
    """A copy with an edit every 24 to 29 characters has no exact window of 30, but shares seeds of 12."""
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    parts = [word(rng.randint(23, 28)) for _ in range(20)]
    docs = [(1, "1" * 9 + "Q".join(parts)), (2, "R".join(parts) + "2" * 9), (3, word(300))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sharedspans.passages(df, length=30, k=12).collect()
    assert sharedspans.shared_spans(df, length=30, k=12).count() == 0
    assert {(r.doc_id, r.partner) for r in got} == {(1, 2), (2, 1)}
    long = max(got, key=lambda r: r.exact_chars)
    assert long.n_anchors > 5 and long.edits >= long.n_anchors - 1 and long.similarity > 0.8


def test_overlaps_of_long_items(spark):
    item = [f"w{i}" for i in range(500)]
    near = item.copy()
    near[150], near[320] = "x", "y"
    docs = [(1, " ".join(["a"] * 7 + item)), (2, " ".join(near)), (3, " ".join(item[40:140] + ["z"] * 200 + item[200:330])), (4, " ".join(item[:11]))]
    got = leaks.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string"))
    assert {(r.doc_id, r.exact_words, r.near_words) for r in got.collect()} == {(1, 500, 500), (2, 179, 500), (3, 130, 132)}


def test_stretches_equal_verification():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(12, 45))
        item = rng.integers(1, 99, n)
        doc = np.where(rng.random(n) < 0.08, 0, item)
        at = [i for i in range(n - 11) if (doc[i : i + 12] == item[i : i + 12]).all()]
        if at:
            each = [leaks.verify(doc, i, item, i, 2) for i in at]
            want = max(x for x, _ in each), max(y for _, y in each)
            assert leaks.stretches(np.zeros(len(at), np.int64), np.full(len(at), n), np.array(at), np.flatnonzero(doc != item), 2) == want
