"""Spelling variants, ranked search and the quality classifier next to brute-force versions."""

from __future__ import annotations

import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

from leadloom.llm import lexical_search, quality, queries, spelling  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Clashing names: those that the operators give their own columns.
EXTRA = "n long, word string, score double, term string, key string, label int, features binary"


def table_of(spark, rows):
    """Rows of (doc_id, text) among columns named like the operators' own."""
    return spark.createDataFrame(
        [(i, t, 1, "w", 0.5, "t", "k", 1, b"f") for i, t in rows],
        f"doc_id long, text string, {EXTRA}",
    )


# --- spelling ------------------------------------------------------------------------------------
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(
        long[:i] + long[i + 1 :] == short for i in range(len(long))
    )


def brute_variants(rows, one_in):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            if i is not None and one_in:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % one_in == 0:
                    place = h % len(run)
                    run = run[:place] + run[place + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * n:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return {
        (w, forms.get(w), root(w), n, len(near[w]), words.get(forms.get(w)))
        for w, n in words.items()
    }


def found_variants(docs, **options):
    out = spelling.spelling_variants(docs, **options)
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def dense_words(seed, size):
    """Words over few letters, so most have neighbours, their counts far apart."""
    draw = random.Random(seed)
    words = ["".join(draw.choices("abé", k=draw.randint(4, 7))) for _ in range(8 * size)]
    text = [w for w in words for _ in range(int(draw.paretovariate(0.6)) % 90 + 1)]
    draw.shuffle(text)
    return [(i % 7, " ".join(text[i::size]).title()) for i in range(size)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_of_dense_words(spark, seed):
    rows = dense_words(seed, 60) + [(None, "ababab " * 9), (3, None), (4, ""), (5, "aaaaa×ÿé " * 4)]
    for one_in in (None, 5):
        found = found_variants(table_of(spark, rows), one_in=one_in)
        assert found == brute_variants(rows, one_in)
        assert sum(r[1] is not None for r in found) > 20 and max(r[4] for r in found) > 5


def test_variants_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet")
            .select("doc_id", "text").collect()]
    out = queries.op11_spelling_variants(spark, SF_DIR).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == brute_variants(rows, 97)


def test_roots_follow_long_chains(spark):
    chain = [("x" * (5 + i), 2 ** (12 - i)) for i in range(12)]
    words = spark.createDataFrame(chain, "word string, n long")
    found = {r.word: r.root for r in spelling.group_variants(words).collect()}
    assert set(found.values()) == {"xxxxx"} and len(found) == 12


def test_ties_of_forms(spark):
    words = spark.createDataFrame(
        [("kitten", 3), ("mitten", 9), ("bitten", 9), ("sitten", 5), ("zzzzz", 3)],
        "word string, n long",
    )
    found = {r.word: (r.n_near, r.form, r.root) for r in spelling.group_variants(words).collect()}
    assert found == {
        "kitten": (3, "bitten", "bitten"), "mitten": (3, None, "mitten"),
        "bitten": (3, None, "bitten"), "sitten": (3, None, "sitten"), "zzzzz": (0, None, "zzzzz"),
    }


def test_variants_of_nothing(spark):
    assert found_variants(table_of(spark, [])) == set()
    assert found_variants(table_of(spark, [(1, None), (2, "ab cd")])) == set()
    with pytest.raises(ValueError, match="letters"):
        spelling.spelling_variants(table_of(spark, []), min_letters=3)


def test_a_very_long_text(spark):
    text = ("lantern lantirn " * 3 + "lantern ") * 20_000
    assert found_variants(table_of(spark, [(1, text)])) == brute_variants([(1, text)], None)


def test_pivots_are_the_cheapest_disjoint_grams():
    draw = random.Random(4)
    for _ in range(300):
        ranks = [draw.randint(0, 9) for _ in range(draw.randint(4, 12))]
        places = spelling.gram_prefix(ranks)
        weights = [draw.randint(1, 9) for _ in places]
        first, second = spelling.pivots(places, weights)
        cost = dict(zip(places, weights, strict=True))
        best = min(cost[a] + cost[b] for a in places for b in places if b - a >= 2)
        assert second - first >= 2 and cost[first] + cost[second] == best


# --- search --------------------------------------------------------------------------------------
def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def brute_search(rows, items, top=20):
    held = [(i, Counter(terms_of(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    frequency = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for item, times in wanted.items():
        scored = []
        for i, c in held:
            m = 75 + 25 * c.total() * n_docs // length
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1)))
                * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, k in times.items() if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def found_rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()),
                  key=repr)


@pytest.mark.parametrize(("shard", "block", "top"), [(4 << 20, 4 << 20, 20), (150, 80, 3), (40, 9, 1)])
def test_search(spark, shard, block, top, monkeypatch):
    monkeypatch.setattr(lexical_search, "FIRST_READ", 2)
    draw = random.Random(shard)
    words = [f"w{int(draw.expovariate(0.15))}" for _ in range(400)] + ["É", "日本", "9"]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(1, 40)))) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(7, "w1 w1"), (7, "w2"), (None, rows[5][1]), (None, None), (500, ""), (501, "-- !"),
             (502, "W1\x00w2\tÉ é " * 3000)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 9)))) for i in range(12)]
    items += [(3, "w1 W1"), (20, None), (21, "nowhere"), (None, "w1"), (22, "")]
    found = lexical_search.search(
        table_of(spark, rows),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, item string"),
        top=top, block_bytes=block, shard_entries=shard,
    )
    assert found_rows(found) == brute_search(rows, items, top)


def test_search_of_documents(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet")
                    .select(key, "text").collect()]
                   for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    found = queries.op12_lexical_search(spark, SF_DIR)
    assert found_rows(found) == brute_search(docs, items)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(table_of(spark, []), items).count() == 0
    assert lexical_search.search(table_of(spark, [(1, "a")]), items.limit(0)).count() == 0
    assert lexical_search.search(table_of(spark, [(1, "b")]), items).count() == 0


def test_search_stops_before_the_end_of_lists():
    """Reading ends strictly below the score of rank k, with all ties of rank k met."""
    draw = np.random.default_rng(5)
    n = 4000
    terms = np.tile([0, 1], n)
    impacts = draw.integers(1, 1000, 2 * n)
    impacts[:40] = 5000
    shard = lexical_search.Shard(np.arange(0, 2 * n + 1, 2), terms, impacts, 2)
    met, scores = shard.search(np.array([0, 1]), np.array([1, 2]), 10)
    every = impacts[0::2] + 2 * impacts[1::2]
    assert len(met) < n / 4 and len(met) == len(set(met)) and (scores == every[met]).all()
    assert set(np.flatnonzero(every >= np.sort(every)[-10])) <= set(met)


# --- quality -------------------------------------------------------------------------------------
def brute_features(text):
    raw = text.encode()
    spread = (int(quality._SPREAD), int(quality._GRAM_SHIFT))
    found = {
        (int.from_bytes(raw[i : i + 3], "big") * spread[0] & 0xFFFFFFFF) >> spread[1]
        for i in range(len(raw) - 2)
    }
    words = raw.lower().split()
    run = longest = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    marks = {quality._MARKS + k - 2 for k in range(2, min(longest, 5) + 1)}
    return found, len(words), marks


def test_features():
    texts = ["", "a", "ab", "a b", "The the THE cat", "x x x x x x y", "é" * 3000, "one two three"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for text, got in zip(texts, quality.text_features(raw, starts), strict=True):
        grams, words, marks = brute_features(text)
        assert {int(f) for f in got if f < quality._HALF} == grams, text
        assert {int(f) for f in got if f >= quality._MARKS} == marks, text
        assert (got >= quality._HALF).sum() <= max(words - 1, 0) + len(marks)


def test_counts_over_many_tasks(spark):
    rows = [(i, ["good text here", "bad bad bad"][i % 2], i % 2) for i in range(50)] + [(99, "", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(7)
    good, bad = quality.feature_counts(frame)
    for value, counts in ((0, bad), (1, good)):
        want = Counter(
            int(f) for _, t, label in rows if label == value
            for f in next(quality.text_features(
                np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])))
        )
        assert dict(want) == {int(f): int(counts[f]) for f in np.flatnonzero(counts)}
    ratios = quality.log_count_ratios(good, bad)
    assert abs(ratios[(good == 0) & (bad == 0)]).max() < 1e-9


def test_dual_descent_reaches_the_optimum():
    """No small move of the weights lowers the objective, and the gap to the dual closes."""
    draw = np.random.default_rng(3)
    ratios = draw.normal(size=quality.FEATURES)
    rows, labels, kept = [], [], []
    for i in range(60):
        there = np.zeros(quality.FEATURES, bool)
        there[draw.choice(40, 9, replace=False) + (0 if i % 3 else 15)] = True
        rows.append(np.packbits(there).tobytes())
        kept.append(np.flatnonzero(there))
        labels.append(int(i % 3 > 0) if i % 11 else 0)
    signs = np.where(np.array(labels) > 0, 1, -1)

    def objective(w):
        margins = [s * (w[f] @ quality._inputs(f, ratios) + w[-1])
                   for f, s in zip(kept, signs, strict=True)]
        return w @ w / 2 + np.maximum(0, 1 - np.array(margins)).sum()

    weights = quality.fit_hinge(rows, np.array(labels), ratios, epochs=500, tolerance=1e-9)
    best = objective(weights)
    for _ in range(200):
        step = np.zeros(len(weights))
        step[draw.choice(60, 5)] = draw.normal(size=5) * 0.05
        step[-1] = draw.normal() * 0.05
        assert objective(weights + step) >= best - 1e-6


def test_quality_of_held_out_documents(spark):
    """Trained on three folds of the labels, the fourth is told apart."""
    sf_dir = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op13_quality_classifier(spark, sf_dir).collect()}
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(out[r.doc_id].held_out for r in held)
    right = [out[r.doc_id].predicted == r.quality for r in held]
    assert np.mean(right) >= 0.95 and all(0 <= r.score <= 1 for r in out.values())
    bad = [out[r.doc_id].score for r in held if r.quality == 0]
    good = [out[r.doc_id].score for r in held if r.quality == 1]
    assert np.mean([[g > b for g in good] for b in bad]) > 0.95


def test_quality_of_hostile_rows(spark):
    good = [(i, f"plain words number {i} in a row of their own") for i in range(40)]
    bad = [(100 + i, f"junk{i}!!! $$$ ### buy buy buy") for i in range(40)]
    rows = good + bad + [(None, "plain words"), (900, None), (901, ""), (7, "junk!!! $$$"),
                         (902, "plain words " * 60_000)]
    labels = spark.createDataFrame(
        [(i, 1, 9) for i, _ in good] + [(i, 0, 9) for i, _ in bad]
        + [(None, 1, 9), (5, None, 9), (6, 7, 9), (8, 0, 9), (8, 1, 9), (9999, 1, 9)],
        "doc_id long, quality int, text int",
    )
    docs = table_of(spark, rows)
    model = quality.fit(docs, labels, F.lit(True))
    found = quality.score(docs, model)
    assert set(found.columns) == set(docs.columns) and found.count() == len(rows)
    scores = {(r.doc_id, r.text): r.score for r in found.collect()}
    assert min(scores[r] for r in good) > max(scores[r] for r in bad)
    assert scores[(900, None)] == scores[(901, "")] and scores[(902, rows[-1][1])] > 0.5
    again = quality.fit(docs.repartition(5), labels.repartition(3), F.lit(True))
    assert np.allclose(again.weights, model.weights) and again.slope == pytest.approx(model.slope)


def test_quality_without_two_classes(spark):
    docs = table_of(spark, [(i, f"text {i}") for i in range(20)])
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    for part, share in ((labels, 21 / 22), (labels.limit(0), 0.5)):
        found = quality.score(docs, quality.fit(docs, part, F.lit(True))).collect()
        assert [r.score for r in found] == pytest.approx([share] * 20)
    empty = quality.fit(docs.limit(0), labels, F.lit(True))
    assert quality.score(docs.limit(0), empty).count() == 0
