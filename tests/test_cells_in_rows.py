"""Cells of selected terms are worked out in the documents' rows: no exchange by document, no gathering, no join."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lexigrain.operators import vectors
from lexigrain.plans.corpus import Corpus


def corpus_of(spark, rows) -> Corpus:
    return Corpus(spark.createDataFrame(rows, "doc_id long, text string"), ())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(seed, repeated):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("aabbcdefgé") for _ in range(rng.choice([0, 1, 7, 90])))) for i in range(30)] + [(40, None), (41, "z z z")]
    return rows + [(3, "a b a c d"), (3, "a c"), (4, "b b e")] if repeated else rows


def test_pairs_need_one_exchange_by_rows(spark):
    corpus = corpus_of(spark, [(1, "a b a c"), (2, "b c")])
    cells = vectors.document_cells(corpus, vectors.selected_terms(corpus, 1, 3), vectors.g2_weight(corpus))
    plan = plan_of(cells)
    assert not any(x in plan for x in ("Exchange", "Join", "Aggregate", "Sort "))
    pairs = plan_of(vectors._products(cells, dot=lambda a, b: a["w"] * b["w"]))
    assert pairs.count("Exchange") == 1 and "Join" not in pairs and "ObjectHashAggregate" not in pairs


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("dense", [4000, 2])
def test_cells_are_those_of_the_postings(spark, monkeypatch, repeated, dense):
    monkeypatch.setattr(vectors, "DENSE", dense)
    corpus = corpus_of(spark, texts(1, repeated))
    terms = vectors.selected_terms(corpus, 2, 5)
    for weight in (vectors.bm25_weight(corpus), vectors.g2_weight(corpus, True)):
        wanted = sorted((r.row, r.col, round(r.w, 9)) for r in vectors.weighted_cells(corpus, terms, weight).collect())
        held = vectors.document_cells(corpus, terms, weight).collect()
        assert len({r.col for r in held}) == len(held)
        assert sorted((c.row, r.col, round(c.w, 9)) for r in held for c in r.held) == wanted


@pytest.mark.parametrize("weight", ["g2", "bm25"])
def test_cosines_and_contrast_equal_plain_sums(spark, weight):
    corpus = corpus_of(spark, texts(2, False))
    terms = vectors.selected_terms(corpus, 2, 6)
    of = vectors.g2_weight(corpus) if weight == "g2" else vectors.bm25_weight(corpus)
    cells = vectors.weighted_cells(corpus, terms, of).collect()
    names, cols = sorted({r.row for r in cells}), sorted({r.col for r in cells})
    w = np.zeros((len(names), len(cols)))
    for r in cells:
        w[names.index(r.row), cols.index(r.col)] = r.w
    held = vectors.document_cells(corpus, terms, of)
    n = np.sqrt((w**2).sum(1))
    wanted = {(a, b): w[i] @ w[j] / (n[i] * n[j]) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and ((w[i] != 0) & (w[j] != 0)).any()}
    assert {(r.a, r.b): r.cosine for r in vectors.cosine_rows(held).collect()} == pytest.approx(wanted, abs=2e-6)
    if weight == "bm25":
        g, v = w / np.sqrt((w**2).sum(0)), w / w.sum(1, keepdims=True)
        x = (v @ g.T - g.mean(1)) @ g + v
        size = np.sqrt((x**2).sum(1))
        cos = {b: x[0] @ x[j] / (size[0] * size[j]) for j, b in enumerate(names) if j}
        assert {r.b: r.cosine for r in vectors.contrast_neighbours(held, names[0]).collect()} == pytest.approx(cos, abs=2e-6)
