"""Distance profiles are counted in the rows in which documents meet their snippets."""

from __future__ import annotations

import random

import pytest

from lexigrain.operators import analysis, cooc
from lexigrain.plans import spans as sp
from lexigrain.plans.corpus import Corpus

TICKS = [2, 5, 10]


def rows_of(repeated):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopqrstx") for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(25)] + [(90, None), (91, ""), (92, "x"), (93, "x x a x")]
    return rows + [(3, "x a b c x a"), (4, "b x"), (93, "a x a a")] if repeated else rows


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("gap", [0, 6])
@pytest.mark.parametrize("chain", [False, True])
def test_shells_are_those_of_the_tokens(spark, repeated, gap, chain):
    corpus = Corpus(spark.createDataFrame(rows_of(repeated), "doc_id long, text string"), ())
    if chain:
        corpus = corpus.analysed(analysis.canonic(["a", "b"], entries=["x c"], split=False))
    snips = sp.snippets(sp.find(corpus, "x"), gap)
    got = {(r.term, r.tick): (r.freq, r.docs) for r in cooc.shells(corpus, snips, TICKS).collect()}
    near: dict = {}
    for r in corpus.contexts(snips, 10, 10).collect():
        away = r.start - r.pos if r.pos < r.start else max(r.pos - r.end + 1, 0)
        key = (r.doc_id, r.pos, r.term)
        near[key] = min(near.get(key, 99), away)
    freq: dict = {}
    ticks: dict = {}
    for (doc, _, term), away in near.items():
        tick = next(t for t in TICKS if away <= t)
        freq[term, tick] = freq.get((term, tick), 0) + 1
        ticks[term, doc] = min(ticks.get((term, doc), 99), tick)
    docs: dict = {}
    for (term, _), tick in ticks.items():
        docs[term, tick] = docs.get((term, tick), 0) + 1
    assert got == {k: (n, docs.get(k, 0)) for k, n in freq.items()} and (chain or len(got) > 20)


def test_tokens_of_contexts_are_neither_windowed_nor_gathered(spark):
    corpus = Corpus(spark.createDataFrame(rows_of(False), "doc_id long, text string"), ())
    snips = spark.createDataFrame([(1, 0, 2, 3)], "doc_id long, snip int, start int, end int")
    counts = cooc._shells_in_row(corpus.met(snips), TICKS)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in counts and "HashAggregate" not in counts.replace("ObjectHashAggregate", "")
    # Those who use the profile twice read what was written once.
    plan = cooc.shells(corpus, snips, TICKS)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Generate" not in plan
