from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from lexigrain.llm import minhash_dedup as m
from lexigrain.llm.textkit import shingle_sets

from .helpers import edited, rows, sentence

SCHEMA = "doc_id long, text string"


def brute(docs: list[tuple], percent: int) -> dict:
    """By strings, without hashes: the set size and component of every id."""

    def shingles(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [(i, shingles(t)) for i, t in docs]
    group = {i: i for i, _ in docs}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def brute_rows(docs: list[tuple], percent: int) -> Counter:
    """The operator's rows, also for ids that come again with other texts."""
    root = {i: r for i, (_, r) in brute(docs, percent).items()}
    size = {(i, t): brute([(0, t)], percent)[0][0] for i, t in docs}
    return Counter((i, size[i, t], root[i], root[i] == i) for i, t in docs)


def family(rng: random.Random) -> list[tuple]:
    docs, n = [], 0
    for _ in range(12):
        base = sentence(rng, rng.choice([6, 30, 80, 200]))
        for _ in range(rng.randrange(1, 9)):
            docs.append((n := n + 1, edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 6]))))
    return docs + [(n + k, sentence(rng, 60)) for k in range(1, 20)]


@pytest.mark.parametrize("percent", [85, 80])
def test_components_are_those_of_brute_force(spark, percent):
    rng = random.Random(percent)
    docs = family(rng) + [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one\ttwo"), (905, "ÉTÉ one"), (906, "été one"), (907, "a b c d e f"), (908, "word " * 3000)]
    rng.shuffle(docs)
    expected = brute(docs, percent)
    out = m.near_duplicates(spark.createDataFrame(docs, SCHEMA), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in out) and len(out) == len(docs)


def test_ids_that_come_again_with_other_texts_lose_no_link(spark):
    rng = random.Random(21)
    docs = []
    for k in range(12):
        one, two = sentence(rng, 60), sentence(rng, 60)
        # The shared id comes with a text of either family, and once more with a text that is near nothing.
        docs += [(10 * k, one), (10 * k, two), (10 * k, sentence(rng, 40)), (10 * k + 1, edited(rng, one, 1)), (10 * k + 2, edited(rng, two, 1)), (10 * k + 3, sentence(rng, 60))]
    docs += [(1, docs[0][1]), (0, docs[0][1]), (0, None), (0, "")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, SCHEMA)
    out = Counter(rows(m.near_duplicates(df.repartition(5), 85), "doc_id", "n_shingles", "component_id", "kept"))
    assert out == brute_rows(docs, 85)
    kept = [(r.doc_id, r.text) for r in m.keep_first_of_groups(df, 85).collect()]
    # Unrelated texts of one id stay, one row each; near ones go, whatever their id.
    sets = {(i, t): frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in docs if t}
    assert Counter(x for x in kept if not x[1]) == Counter([(0, None), (0, "")])
    texts = [x for x in kept if x[1]]
    assert len(texts) == len(set(texts))
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in texts for b in texts if a != b) and all(any(near(d, t) for t in texts) for d in sets)


def test_a_large_group_below_the_threshold_ships_few_texts(spark):
    """Variants of one text that are too far apart: sketches tell them apart, so no text travels for them."""
    rng = random.Random(8)
    base = sentence(rng, 120)
    docs = [(i, edited(rng, base, 9)) for i in range(600)]
    search = m._Search(spark.createDataFrame(docs, SCHEMA), 85, "doc_id", "text")
    buckets = search.shared_buckets()
    assert buckets.groupBy("bucket").count().agg({"count": "max"}).first()[0] > 50
    pairs = search.centre_pairs(buckets)
    named = search.open_pairs(buckets, spark.createDataFrame([], "node long, root long"), True, "all")
    assert pairs.count() < 60 and named.where("b is not null").select("a", "b").distinct().count() < 600 * 599 / 2 / 50


def test_sketches_never_hide_a_link():
    rng = np.random.default_rng(9)
    for size in (5, 40, 300, 3000):
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            cut = rng.integers(0, max(1, int(size * 0.081)) + 1)
            a, b = np.unique(pool[:size]), np.unique(pool[cut : size + cut])
            if not m.similar(a, b, 85):
                continue
            x, y = (np.concatenate([m.odd_sketch(m.minhash(s)), m.set_sketch(s)]) for s in (a, b))
            odd = np.bitwise_count(x ^ y)
            sure, likely = m._difference_limit(np.float64(len(a) + len(b)), 85, np)
            assert odd[:8].sum() <= m.greatest_distance(85) and odd[8:].sum() <= min(sure, likely)


def test_a_large_group_of_variants_keeps_every_link(spark, monkeypatch):
    """Many documents near one text but not all near each other; blocks as small as can be."""
    monkeypatch.setattr(m, "BLOCK", 16)
    monkeypatch.setattr(m, "HUB", 5)
    rng = random.Random(5)
    base = sentence(rng, 70)
    docs = [(i, edited(rng, base, rng.randrange(0, 4))) for i in range(150)] + [(1000 + i, base) for i in range(60)]
    out = m.near_duplicates(spark.createDataFrame(docs, SCHEMA), 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(docs, 85)


def test_repeated_ids_null_ids_and_clashing_columns(spark):
    docs = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", "z"), (None, "a b c d e f", "n"), (3, "q", "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, bucket string").withColumnRenamed("bucket", "component")
    df = df.selectExpr("*", *(f"1 AS {c}" for c in "id hash row own_id own_hash node digest first text_hash __id kept root".split()))
    out = Counter(rows(m.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept"))
    assert out == Counter([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (3, 1, 3, True)])
    kept = m.keep_first_of_groups(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]


def test_empty_table(spark):
    assert m.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for shift in (0, 50, 150):
        a, b = np.sort(pool[:1000]), np.sort(pool[shift : 1000 + shift])
        x, y = m.odd_sketch(m.minhash(a)), m.odd_sketch(m.minhash(b))
        estimate = float(m.estimated_similarity(np.array([np.bitwise_count(x ^ y).sum()]))[0])
        assert abs(estimate - (1000 - shift) / (1000 + shift)) < 0.15
    assert m.estimated_similarity(np.array([m.greatest_distance(85)]))[0] >= m.least_estimate(85) - 0.02


def test_shingle_sets_match_words():
    sets = list(shingle_sets(["A b c d e f", "a b  c\td e f", "a b", None, "a b c d e"]))
    assert [len(s) for s in sets] == [2, 2, 1, 0, 1]
    assert np.array_equal(sets[0], sets[1]) and sets[4][0] in sets[0]
