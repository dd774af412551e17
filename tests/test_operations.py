from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lexigrain.functions.tags import TagSet, in_group
from lexigrain.operators import analysis, tagging
from lexigrain.plans import operations as op
from lexigrain.plans.corpus import Corpus
from lexigrain.plans.operations import Request

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus.open(spark, SF)


def test_requests_are_clamped():
    r = Request(ctx=999, docs=0, slop=-3, snippets=500, terms=10**6, start=9, end=3, sort="odd").checked()
    assert (r.ctx, r.docs, r.slop, r.snippets, r.terms, r.start, r.end, r.sort) == (200, 1, 0, 100, 5000, 3, 9, "g2")
    assert Request().condition() is None


def test_terms_has_four_ways(spark, corpus):
    whole = op.terms(corpus, Request(terms=5)).collect()
    assert len(whole) == 5 and whole[0].freq == whole[0].field_freq
    raw = op.terms(corpus, Request(terms=3, sort="raw")).orderBy("rank").collect()
    assert raw[0].score == max(r.score for r in raw) == raw[0].freq
    focus = op.terms(corpus, Request(types=("fr",), terms=20)).orderBy("rank").collect()
    from lexigrain.operators.frequency import keyness

    same = keyness(corpus, F.col("lang") == "fr", "g2", 20).orderBy("rank").collect()
    assert [(r.term, r.score) for r in focus] == [(r.term, r.score) for r in same]
    near = op.terms(corpus, Request(q="the of", slop=5, terms=10)).collect()
    assert len(near) == 10 and not {"the", "of"} & {r.term for r in near}
    years = op.terms(corpus, Request(start=5, end=9, terms=10)).collect()
    assert len(years) == 10 and all(r.freq > 0 for r in years)
    forced = op.terms(corpus, Request(types=("fr",), terms=3, include=("absentee", "le"), exclude=("de",))).collect()
    assert "le" in {r.term for r in forced} and "de" not in {r.term for r in forced}


def test_other_operations(spark, corpus):
    assert all(r.term[0].isupper() for r in op.freqlist(corpus, Request(terms=9)).collect())
    marked = op.suggest(corpus, "ré", Request(terms=5)).collect()
    assert marked and all("<mark>" in r.marked for r in marked)
    chrono = op.chrono(corpus, Request(q="the")).collect()
    assert sum(r.docs_hit for r in chrono) == corpus.tokens.where("term = 'the'").select("doc_id").distinct().count()
    assert op.chrono(corpus, Request()).columns == ["year", "docs", "tokens", "width"]
    with pytest.raises(ValueError):
        op.cooc_profile(corpus, Request())
    assert op.cooc_profile(corpus, Request(q="the", terms=4), (5, 20)).count() == 8
    assert op.results(corpus, Request(docs=7)).count() == 7
    ranked = op.results(corpus, Request(q="the", docs=5)).collect()
    assert len(ranked) == 5
    assert op.results(corpus, Request(q="the", docs=5), "date", after=20).agg(F.min("doc_id")).first()[0] > 20
    assert op.results(corpus, Request(q="the", docs=5), "snippets").count() == 5
    doc = ranked[0].doc_id
    snips = op.snippets(corpus, doc, Request(q="the", snippets=2)).collect()
    assert 1 <= len(snips) <= 2 and all(s.first_match >= s.start for s in snips)
    assert "<mark>the</mark>" in op.document(corpus, doc, Request(q="the")).first().html.lower()
    for same in (Request(q="the of", docs=5, stopwords=("of",)), Request(q="the-il", docs=5, clitics=True, stopwords=("il",))):
        assert sorted(map(tuple, op.results(corpus, same).collect())) == sorted(map(tuple, ranked))
    assert op.document(corpus, doc, Request()).first().html
    info = op.describe(corpus)
    assert info["n_docs"] <= info["all_docs"] and info["year_min"] == 0


def test_vector_map(spark, corpus):
    words = [r.term for r in op.terms(corpus, Request(terms=6)).collect()]
    model = spark.createDataFrame([(w, [float(i), 1.0, float(i % 2)]) for i, w in enumerate(words[:5])], "word string, vector array<float>")
    assert op.vector_map(corpus, Request(terms=6), model).count() == 5


def test_tables(spark, corpus):
    cells = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "row string, col string, n int")
    rows, cols, total = op.contingency_totals(cells)
    assert (dict(map(tuple, rows.collect())), dict(map(tuple, cols.collect())), total) == ({"a": 3, "b": 3}, {"x": 4, "y": 2}, 6)
    with pytest.raises(ValueError):
        op.contingency_totals(cells.unionByName(cells.withColumn("n", F.lit(-1))))
    star = op.star_schema(corpus, spark.createDataFrame([("thes", "the")], "form string, lemma string"))
    assert star["tok"].count() == corpus.totals["n_tokens"] == star["lem"].agg(F.sum("n")).first()[0]
    assert set(op.keyness_table(corpus, F.col("lang") == "fr").columns) >= {"g2", "chi2", "logdice", "count"}


def test_tagging(spark):
    t = spark.createDataFrame([(1, i, 1, w) for i, w in enumerate("The cat sat . It ran !".split())], "doc_id long, seq int, pos_inc int, term string")
    lex = spark.createDataFrame([("the", "DET"), ("cat", "NOUN"), ("cat", "VERB")], "form string, tag string")
    assert [r.tag for r in tagging.by_lexicon(t, lex).orderBy("seq").collect()] == ["DET", "NOUN", "X", "X", "X", "X", "X"]
    seen = tagging.by_tagger(t, lambda words: [(f"N+{len(words)}", 0.5)] * len(words)).orderBy("seq").collect()
    assert [r.tag for r in seen] == ["N_4", "N_4", "N_4", "PUNCT", "N_3", "N_3", "PUNCT"] and seen[3].probability == 1.0
    long = spark.range(700).selectExpr("1L AS doc_id", "CAST(id AS INT) AS seq", "1 AS pos_inc", "'w' AS term")
    assert {r.tag for r in tagging.by_tagger(long, lambda w: [(str(len(w)), 1.0)] * len(w)).collect()} == {"300", "100"}
    assert analysis.surface(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


def test_tag_sets(spark):
    s = TagSet().with_group("NOUN").with_tag(0x11).without_tag(0x21)
    assert s.cardinality() == 16 and s.cardinality(include=TagSet().with_group("NOUN")) == 15 and s.without_group("NOUN").tags == {0x11}
    df = spark.createDataFrame([(0x20,), (0x21,), (0x11,), (0xA3,)], "t int")
    assert [r[0] for r in df.select(s.test(F.col("t"))).collect()] == [True, False, True, False]
    assert [r[0] for r in df.select(in_group(F.col("t"), "NUM")).collect()] == [False, False, False, True]
