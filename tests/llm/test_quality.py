from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexigrain.llm import quality as q
from lexigrain.llm import textkit

from .helpers import sentence

SCHEMA = "doc_id long, text string"


def labelled(rng: random.Random, n: int):
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice([0, 1, 2, 2])
        text = sentence(rng, rng.randrange(30, 120))
        if kind == 0:
            text = text.upper().replace(" ", "!! ")
        elif kind == 1:
            words = text.split()
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["grumbler", "dolt", "twerp"])
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return docs, labels


def test_held_out_accuracy_and_ordered_tails(spark):
    rng = random.Random(4)
    docs, labels = labelled(rng, 1500)
    df = spark.createDataFrame(docs, SCHEMA)
    rated = spark.createDataFrame([x for x in labels if x[0] < 1000], "doc_id long, quality int, toxic int")
    model = q.train(df, rated, q.rating())
    assert model.grades == [0, 1, 2] and model.cuts[0] < model.cuts[1]
    out = {r.doc_id: r for r in q.score(df, model, least_grade=2).collect()}
    held = [x for x in labels if x[0] >= 1000]
    right = np.mean([out[i].kept == (good and not toxic) for i, good, toxic in held])
    assert right > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in out.values())
    low = {r.doc_id: r.tail_probability for r in q.score(df, model, least_grade=1).collect()}
    assert all(low[i] >= out[i].tail_probability for i in low)
    kept = q.accepted(df, model, least_grade=2)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}


def spelled_hash(raw: bytes) -> int:
    """A word's hash, one byte at a time in whole numbers."""
    mask = (1 << 64) - 1
    total = sum(int(textkit._BYTE_VALUE[b]) * pow(textkit._BASE, i, 1 << 64) for i, b in enumerate(raw)) + len(raw) * textkit._BASE
    return int(textkit.mix64(np.array([total & mask], dtype=np.uint64))[0])


def plain_features(text: str | None) -> set[int]:
    """The feature numbers of a text, by regular expressions and without arrays."""
    raw = (text or "").encode()
    out, words = set(), [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", raw)]
    for w in words:
        out.add(spelled_hash(w))
        out |= {spelled_hash(w[:n]) ^ n if len(w) > n else spelled_hash(w) for n in q.STEMS}
    style = Counter()
    tokens = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    for t in tokens:
        kinds = 0
        for b in t:
            kinds |= int(q._KIND[b])
        style[kinds << 2 | (q._KIND[t[0]] == q._MARK) << 1 | (q._KIND[t[-1]] == q._MARK)] += 1
    style[64], style[65] = sum(a == b for a, b in zip(words, words[1:])), len(words) - len(set(words))
    for k, n in style.items():
        if (share := n * 8 // max(len(tokens), 1)) > 0:
            out.add(int(textkit.mix64(np.array([k * 64 + min(share, 63) + (0x5A17 << 32)], dtype=np.uint64))[0]))
    return {x >> (64 - q.BITS) for x in out}


def test_features_are_those_of_a_plain_reading():
    rng = random.Random(3)
    texts = [None, "", " \n", "A", "It's 12,5 -- (really) ÉTÉ été!! a1 a1 A1", "x" * 70, "\x0b(a)\x0c b", *(sentence(rng, rng.randrange(1, 90)) for _ in range(20)), "THE END!! " * 9]
    for t, got in zip(texts, q.features(texts), strict=True):
        assert set(got.tolist()) == plain_features(t), t
    shape = lambda t: {k for k in range(64) if any(int(textkit.mix64(np.array([k * 64 + s + (0x5A17 << 32)], dtype=np.uint64))[0]) >> (64 - q.BITS) in next(q.features([t])).tolist() for s in range(1, 9))}
    assert shape("word word") != shape("word, word,") and q._LETTER << 2 in shape("word word")


def log_likelihood(model_weights, cuts, rows, y, share):
    sig = lambda x: 1 / (1 + np.exp(-x))
    edge = np.concatenate([[-1e9], cuts, [1e9]])
    return sum(share[k] * np.log(sig(np.clip(edge[k + 1] - s, -50, 50)) - sig(np.clip(edge[k] - s, -50, 50))) for k, s in ((k, sum(model_weights[i] for i in r)) for r, k in zip(rows, y, strict=True)))


def test_fit_follows_the_gradient_of_the_likelihood(monkeypatch):
    """One step of the fit, undone, is the numeric gradient of the cumulative-link likelihood."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, rng.integers(1, 7))) for _ in range(40)]
    grades = [int(x) for x in rng.integers(0, 3, 40)]
    for name, value in {"EPOCHS": 1, "BATCH": 64, "PENALTY": 0.0}.items():
        monkeypatch.setattr(q, name, value)
    m = q.fit(rows, grades)
    share = (40 / (3 * np.bincount(grades))) ** q.BALANCE
    cuts, zero, h = np.log(np.array([1 / 3, 2 / 3]) / np.array([2 / 3, 1 / 3])), np.zeros(12), 1e-6
    at = lambda w, c: -log_likelihood(w, c, rows, grades, share) / 40
    for i in range(12):
        up = zero.copy()
        up[i] = h
        g = (at(up, cuts) - at(-up, cuts)) / (2 * h)
        assert m.weights[i] == pytest.approx(-g * q.RATE / (1 + abs(g)), rel=1e-3, abs=1e-6)
    for j in range(2):
        up = np.zeros(2)
        up[j] = h
        g = (at(zero, cuts + up) - at(zero, cuts - up)) / (2 * h)
        assert m.cuts[j] == pytest.approx(cuts[j] - q.CUT_RATE * g / (1e-2 + g * g) ** 0.5, rel=1e-4)


def test_the_fit_approaches_the_greatest_likelihood(monkeypatch):
    """On few features, many epochs come near the optimum that plain gradient steps find."""
    rng = np.random.default_rng(5)
    truth, rows, grades = rng.normal(size=5), [], []
    for _ in range(400):
        r = np.flatnonzero(rng.random(5) < 0.5)
        s = truth[r].sum() + rng.logistic()
        rows.append(r)
        grades.append(int(s > -0.5) + int(s > 1))
    for name, value in {"EPOCHS": 60, "PENALTY": 0.0, "BALANCE": 0.0, "RATE": 0.3}.items():
        monkeypatch.setattr(q, name, value)
    m = q.fit(rows, grades)
    one = np.ones(3)
    w, c, h = np.zeros(5), np.array([-0.5, 0.5]), 1e-5
    x = np.concatenate([w, c])
    f = lambda v: log_likelihood(v[:5], v[5:], rows, grades, one) / 400
    for _ in range(60):
        x = x + 4 * np.array([(f(x + h * e) - f(x - h * e)) / (2 * h) for e in np.eye(7)])
    got = np.concatenate([m.weights[:5].astype(float), m.cuts])
    assert f(got) > f(x) - 0.01


def test_scores_are_those_of_the_model(spark):
    """The query's columns, row by row in plain arithmetic."""
    docs, labels = labelled(random.Random(11), 300)
    docs += [(900, None), (901, ""), (902, "new words only")]
    df = spark.createDataFrame(docs, SCHEMA)
    model = q.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), q.rating())
    out = {r.doc_id: r for r in q.score(df, model, least_grade=2).collect()}
    for i, text in docs[::7] + docs[-3:]:
        s = sum(float(model.weights[k]) for k in plain_features(text))
        tails = [1 / (1 + math.exp(c - s)) for c in model.cuts]
        assert out[i].tail_probability == pytest.approx(tails[1], abs=1e-6) and out[i].expected_grade == pytest.approx(sum(tails), abs=1e-6)
        assert out[i].kept == (out[i].tail_probability >= 0.6)


def test_extra_columns_of_any_name(spark):
    docs, labels = labelled(random.Random(4), 120)
    df, rated = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = "id grade place ids rated_id own_id own_text top quality kept expected_grade tail_probability".split()
    more = df.selectExpr("*", *(f"'x' AS {c}" for c in names))
    one, two = q.train(df, rated, q.rating()), q.train(more, rated.selectExpr("*", "1 AS grade", "2 AS rated_id"), q.rating())
    assert np.array_equal(one.weights, two.weights)
    same = lambda d: sorted(map(tuple, q.score(d, one, 2).collect()))
    kept = q.accepted(more, one, 2)
    assert same(df) == same(more) and kept.columns == more.columns and kept.count() == sum(r[3] for r in same(df))


def test_the_sample_is_bounded_in_features(spark, monkeypatch):
    docs, labels = labelled(random.Random(4), 120)
    monkeypatch.setattr(q, "SAMPLE_FEATURES", 2000)
    seen = []
    fit = q.fit
    monkeypatch.setattr(q, "fit", lambda rows, grades: seen.extend(rows) or fit(rows, grades))
    q.train(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), q.rating())
    assert 0 < sum(map(len, seen)) <= 2000 and len(seen) < 120


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "x" * 300_000), (4, "again"), (None, "no id")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = q.train(docs, none, q.rating())
    assert model.grades == [0] and all(r.kept for r in q.score(docs, model, 0).collect())
    clash = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (2, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert q.train(docs, clash, q.rating()).grades == [0]
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.train(docs, one, q.rating())
    assert model.grades == [2]
    out = q.score(docs, model, 2).collect()
    assert len(out) == 6 and all(r.kept and r.expected_grade == 2 for r in out)
    assert q.score(docs.where("false"), model, 2).collect() == []


def test_equal_samples_give_equal_models(spark):
    docs, labels = labelled(random.Random(6), 200)
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = q.train(spark.createDataFrame(docs, SCHEMA), rated, q.rating(), sample=100)
    two = q.train(spark.createDataFrame(docs[::-1], SCHEMA).repartition(7), rated.repartition(3), q.rating(), sample=100)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.cuts, two.cuts)
