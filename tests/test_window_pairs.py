"""Pairs within a distance are found in the documents' rows, without an exchange or a sort of tokens."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lexigrain.operators import cooc
from lexigrain.plans.corpus import Corpus


def corpus_of(spark, rows) -> Corpus:
    return Corpus(spark.createDataFrame(rows, "doc_id long, text string"), ())


def counted(rows, terms, distance, stop, near):
    """Plain pairs of the tokens that share an id."""
    out = Counter()
    by_id: dict = {}
    for i, text in rows:
        by_id.setdefault(i, []).extend((p, w) for p, w in enumerate((text or "").split()) if w in terms)
    for found in by_id.values():
        for p, a in found:
            for q, b in found:
                if 1 <= q - p <= (near if a in stop or b in stop else distance):
                    out[a, b] += 1
                    out[b, a] += 1
    return dict(out)


@pytest.mark.parametrize("listed", [10_000, 2])
@pytest.mark.parametrize("part", [256, 3])
def test_pairs_are_those_of_plain_counting(spark, monkeypatch, listed, part):
    monkeypatch.setattr(cooc, "LISTED", listed)
    monkeypatch.setattr(cooc, "PART", part)
    rng = random.Random(4)
    rows = [(i // 2 if i < 6 else i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 5, 60, 700])))) for i in range(20)] + [(90, None), (91, "")]
    terms = spark.createDataFrame([(t,) for t in ["a", "b", "c", "a", "absent"]], "term string")
    got = cooc.window_pairs(corpus_of(spark, rows), terms, 4, ["a"], 2)
    assert {(r.row, r.col): r.n for r in got.collect()} == counted(rows, "abc", 4, "a", 2)


def test_tokens_are_neither_exchanged_nor_sorted(spark):
    rows = [(1, "a b a c"), (2, "b c")]
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    plan = cooc.window_pairs(corpus_of(spark, rows), terms, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Join" not in plan
