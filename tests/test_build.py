"""Builds keep words in their documents' rows: what is exchanged, sorted and gathered is bounded by these."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.operators import analysis
from lexigrain.plans import store
from lexigrain.plans.corpus import Corpus

KEEP = ["lang", "source", "year"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def corpus_of(spark, rows) -> Corpus:
    docs = spark.createDataFrame([(i, t, "fr", "src1", 1) for i, t in rows], "doc_id long, text string, lang string, source string, year int")
    return Corpus(docs)


def test_postings_of_a_rail_are_neither_exchanged_nor_gathered(spark):
    plan = plan_of(store.held(corpus_of(spark, [(1, "a b a"), (2, "b")]).rail, KEEP))
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_postings_equal_the_grouped_tokens(spark):
    # Ids that come twice, alike in what is kept or not, texts without words and NULL.
    corpus = corpus_of(spark, [(1, "b a b"), (2, ""), (3, None), (4, "é a-b a"), (5, "x y"), (5, "y x"), (5, "y"), (6, "the " * 40 + "end the")])
    got = {(r.term, r.doc_id, r.dl): (r.tf, list(r.positions)) for r in store.held(corpus.rail, KEEP).collect()}
    rows = corpus.rail.select("doc_id", "dl", F.posexplode("words").alias("pos", "term")).collect()
    wanted: dict = {}
    for r in rows:
        wanted.setdefault((r.term, r.doc_id, r.dl), []).append(r.pos)
    assert got == {k: (len(v), sorted(v)) for k, v in wanted.items()}


def test_postings_with_holes(spark):
    rail = spark.createDataFrame([(1, "fr", "src1", 1, 2, [None, "b", None, "a"])], "doc_id long, lang string, source string, year int, dl long, words array<string>")
    assert sorted((r.term, r.positions) for r in store.held(rail, KEEP).collect()) == [("a", [3]), ("b", [1])]


def _analysed(spark, texts, stop, entries):
    """The corpus of the chain by documents' rows, and that of its token tables."""
    docs = corpus_of(spark, list(enumerate(texts))).documents
    chain = analysis.canonic(stop, entries=entries, split=False)
    return Corpus(docs, chain=chain), Corpus(docs, chain=lambda d: chain(d))


def test_canonic_rail_is_made_in_the_documents_rows(spark):
    by_row, by_table = _analysed(spark, ["of the and", "x"], ["the"], ["of the"])
    assert "Exchange" not in plan_of(by_row.rail) and "Sort" not in plan_of(by_row.rail)
    assert "Exchange" in plan_of(by_table.rail)


def test_canonic_rail_equals_that_of_the_token_tables(spark):
    texts = [
        "of the and of the. The <b>word</b> A a b M. Mr. x1 foo2 the the end the", "", "the of", "in the of the and of", "a b c d", None, "de la und der. l'été l' d. The The . , zz-y -a 'b' the x the Q",
        "of the of the and the of the and de", "&amp; the &lt; and 12,3 in the 5 the A b. the", "the " * 50 + "x1 word the the ... of",
    ]
    overlapping = ["of the", "the and", "the and of", "and of the", "x1 word", "the the"]
    for stop, entries in ((["the", "of", "and", "a"], ["of the", "of the and", "in the"]), ([], ["of the"]), (["the"], []), ([], []), (["of"], overlapping)):
        got, wanted = ({r.doc_id: (r.dl, r.words) for r in c.rail.collect()} for c in _analysed(spark, texts, stop, entries))
        assert got == wanted


def test_a_part_of_the_rail_is_sorted_within_a_small_task():
    # 570 MB were held for a part of 8 MiB; a task of a heap of 0.5 GB a core has some 280 MB.
    assert store.PART_BYTES * 570 // 8 <= 280 << 20
