from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.functions import scorers as sc
from lexigrain.operators import analysis as an
from lexigrain.operators import concord, cooc, parts, rank, vectors
from lexigrain.operators import frequency as fr
from lexigrain.plans import spans as sp
from lexigrain.plans import operations, store
from lexigrain.plans.corpus import Corpus, folded, folded_text
from lexigrain.plans.queries import QUERIES
from lexigrain.sources import lexicon, word2vec, xml
from lexigrain.streaming import append

TOY = [
    (1, "red fox and red hen and the fox", "en", "src1"),
    (2, "the hen the hen the hen saw a fox far away from the red barn and the fox", "en", "src2"),
    (3, "le renard roux", "fr", "src2"),
    (4, "", "fr", "src4"),
    (5, None, "fr", "other"),
]


@pytest.fixture(scope="module")
def toy(spark):
    docs = spark.createDataFrame(TOY, "doc_id long, text string, lang string, source string")
    from lexigrain.plans.corpus import year_of

    return Corpus(docs.withColumn("year", year_of(F.col("source"))))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_totals_count_empty_documents_apart(toy):
    assert toy.totals == {"n_tokens": 8 + 18 + 3, "n_docs": 3, "all_docs": 5, "max_width": 18}
    assert {r.doc_id: r.doc_tokens for r in toy.doc_stats.collect()} == {1: 8, 2: 18, 3: 3, 4: 0, 5: 0}


def test_offsets_point_at_the_words(toy):
    texts = {i: t for i, t, *_ in TOY}
    for r in toy.with_offsets().collect():
        assert texts[r.doc_id][r.start_off : r.end_off] == r.term


@pytest.mark.parametrize(("args", "sign"), [((10, 100, 10, 1000), 1), ((1, 100, 100, 1000), -1), ((10, 100, 100, 1000), 1), ((0, 10, 5, 10), -1)])
def test_g2_and_chi2_signs(spark, args, sign):
    for f in (sc.g2, sc.chi2):
        x = value(spark, f(*args))
        assert math.copysign(1, x or sign) == sign


def test_keyness_guards(spark):
    assert value(spark, sc.g2(1, 0, 1, 10)) == 0 and value(spark, sc.g2(11, 10, 1, 10)) is None
    assert value(spark, sc.log_dice(0, 10, 1, 10)) == float("-inf") and value(spark, sc.log_dice(1, 0, 1, 10)) is None
    assert value(spark, sc.log_ratio(1, 10, 0, 10)) == 0 and value(spark, sc.simple_maths(1, 0, 1, 10)) == 0
    assert value(spark, sc.log_ratio(4, 10, 1, 10)) == pytest.approx(2 * math.log(4))
    assert value(spark, sc.assoc_npmi(0, 1, 1, 9)) == -1 and value(spark, sc.assoc_ppmi(0, 1, 1, 9)) == 0 and value(spark, sc.assoc_g2(5, 2, 9, 9)) is None


@pytest.mark.parametrize("x", [0.5, 1.0, 2.0, 7.3, 120.0, 1e6])
def test_log_gamma(spark, x):
    assert value(spark, sc.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-8, rel=1e-12)


def test_fisher_and_hypergeometric(spark):
    f = value(spark, sc.fisher(F.lit(3), F.lit(1), F.lit(1), F.lit(3)))
    assert (round(f.two_sided, 6), round(f.left_side, 6), round(f.right_side, 6)) == (0.485714, 0.985714, 0.242857)
    assert value(spark, sc.hypergeometric(F.lit(1), F.lit(2), F.lit(2), F.lit(4))) == pytest.approx(2 / 3)


def exact_fisher(a, b, c, d):
    row, col, total = a + b, a + c, a + b + c + d
    ways = {k: math.comb(row, k) * math.comb(total - row, col - k) for k in range(max(0, row + col - total), min(row, col) + 1)}
    whole = math.comb(total, col)
    share = lambda keep: sum(w for k, w in ways.items() if keep(k, w)) / whole
    return share(lambda k, w: w * 10**7 <= ways[a] * (10**7 + 1)), share(lambda k, w: k <= a), share(lambda k, w: k >= a)


def test_fisher_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    tables = [(0, 0, 3, 4), (3, 0, 2, 0), (0, 4, 3, 0), (2, 0, 0, 3), (5, 5, 5, 5), (40, 2, 300, 900), (1, 700, 800, 900), (900, 300, 100, 2000), (600, 20, 15, 700), (500, 500, 500, 500), (501, 500, 500, 500), (0, 900, 40, 3000)]
    tables += [tuple(int(x) for x in rng.integers(0, 12, 4)) for _ in range(60)] + [tuple(int(x) for x in rng.integers(0, 900, 4)) for _ in range(30)]
    tables = [t for t in tables if sum(t)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, a long, b long, c long, d long")
    for r in rows.select("i", sc.fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("f")).collect():
        assert (r.f.two_sided, r.f.left_side, r.f.right_side) == pytest.approx(exact_fisher(*tables[r.i]), rel=1e-7, abs=1e-11), tables[r.i]


def test_fisher_query_tests_every_term_of_the_focus(spark, tmp_path):
    texts = [(i, "le renard roux et la poule " * 20 + f"unique{chr(97 + i)}", "fr", "src1") for i in range(4)] + [(9 + i, "the fox and le hen " * 30, "en", "src2") for i in range(3)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    inside, field = Counter(), Counter()
    for _, text, lang, _ in texts:
        field.update(text.split())
        if lang == "fr":
            inside.update(text.split())
    f, n = sum(inside.values()), sum(field.values())
    want = {t: exact_fisher(a, field[t] - a, f - a, n - f - field[t] + a) for t, a in inside.items()}
    got = {r.term: (r.two_sided, r.left_side, r.right_side) for r in QUERIES["fisher_exact"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(got[t] == pytest.approx(want[t], abs=1e-6) for t in want)


def test_residual_of_a_zero_cell(spark):
    assert value(spark, sc.residual_deviance(0, 2)) == pytest.approx(-2) and value(spark, sc.residual_pearson(0, 4)) == -2
    assert value(spark, sc.residual_freeman_tukey(0, 2)) == pytest.approx(1 - 3)


def test_parsing_and_canonical_form():
    clauses = sp.parse('red (fox "old hen" fox hen*')
    assert clauses == [sp.Term("red"), sp.AnyOf((sp.Term("fox"), sp.Term("old hen"), sp.Pattern("hen*")))]
    assert sp.parse(sp.canonical(clauses)) == clauses
    assert sp.parse("a_b ()") == [sp.Term("a b")] and sp.parse("") == []
    assert sp.pivot_terms("red (fox hen) f*") == ["red", "fox", "hen"]


def spans(df):
    return sorted((r.doc_id, r.start, r.end) for r in df.collect())


def test_spans(toy):
    assert spans(sp.find(toy, "fox")) == [(1, 1, 2), (1, 7, 8), (2, 8, 9), (2, 17, 18)]
    assert spans(sp.phrase(toy, ["Red", "hen"])) == [(1, 3, 5)] and spans(sp.phrase(toy, ["the", "hen", "the"])) == [(2, 0, 3), (2, 2, 5)]
    assert spans(sp.find(toy, "re*")) == [(1, 0, 1), (1, 3, 4), (2, 13, 14), (3, 1, 2)]
    assert spans(sp.find(toy, "f?x (barn)")) == [(2, 8, 15), (2, 14, 18)]
    assert spans(sp.find(toy, "red fox", 1)) == [(1, 0, 2), (1, 1, 4)]
    assert spans(sp.find(toy, "hen hen", 1)) == [(2, 1, 4), (2, 3, 6)]
    assert spans(sp.find(toy, "absent")) == [] and spans(sp.find(toy, "")) == [] and spans(sp.find(toy, "*")) == []


def test_words_that_the_corpus_lacks_drop_out(spark, toy):
    fox = spans(sp.find(toy, "fox"))
    assert spans(sp.find(toy, "absent fox")) == fox == spans(sp.find(toy, '(absent) fox "red hen"')) == spans(sp.find(toy, "THE fox", stopwords=["the"]))
    # What a part of the corpus lacks, the whole may have.
    assert spans(sp.find(toy.select(F.col("lang") == "fr"), "fox renard")) == []
    roots = spark.createDataFrame([("foxes", "fox"), ("foxes", "renard"), ("foxes", "absent"), ("red", "red"), ("red", "fox"), ("hen", "gone")], "form string, root string")
    found = sp.resolve(toy, sp.parse("foxes (red hen)"), roots=roots)
    assert found == [sp.AnyOf((sp.Term("fox"), sp.Term("renard"))), sp.AnyOf((sp.Term("red"), sp.Term("hen")))]
    assert sp.resolve(toy, sp.parse("l'hen", an.split_clitics)) == [sp.Term("hen")]


def test_quoted_terms_are_single_tokens(spark):
    docs = spark.createDataFrame([(1, "The end of the line, of the end"), (2, "of the"), (3, None), (4, "...")], "doc_id long, text string")
    c = Corpus(docs, keep=()).analysed(an.canonic(["the", "end"], entries=["of the"]))
    assert spans(sp.find(c, '"of_the"')) == [(1, 2, 3), (1, 5, 6), (2, 0, 1)]
    assert {r.doc_id: (r.doc_tokens, r.doc_width) for r in c.doc_stats.collect()} == {1: (3, 6), 2: (1, 1), 3: (0, 0), 4: (0, 0)}
    assert {r.term: (r.tf, r.df) for r in c.vocabulary.collect()} == {"of the": (3, 2), "line": (1, 1)}
    around = cooc.context_counts(c, sp.snippets(sp.find(c, "line"), 0), 1, 2).collect()
    assert {r.term: r.freq for r in around} == {"of the": 2, "line": 1}


def test_near_holds_long_members(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    c = Corpus(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), keep=())
    long = sp.phrase(c, words[10:70])
    assert spans(long) == [(1, 10, 70)]
    for word, slop, want in (("wa" + "a", 9, [(1, 0, 70)]), (words[0], 8, []), (words[75], 5, [(1, 10, 76)]), (words[75], 4, []), (words[30], 0, [(1, 10, 70)])):
        assert spans(sp.near([long, sp.find(c, word)], slop)) == want == spans(sp.near([sp.find(c, word), long], slop))


def brute_near(positions, slop):
    """Least end for every least start, over all choices of one position per clause."""
    out = {}

    def walk(chosen, rest):
        if not rest:
            lo, hi = min(chosen), max(chosen) + 1
            if hi - lo - len(chosen) <= slop:
                out[lo] = min(out.get(lo, 10**9), hi)
            return
        for p in rest[0]:
            if p not in chosen:
                walk([*chosen, p], rest[1:])

    walk([], positions)
    return out


def test_near_is_exact_for_any_order(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(list("abcxyz"), size=40))) for i in range(12)]
    c = Corpus(spark.createDataFrame(docs, "doc_id long, text string"), keep=())
    for slop in (0, 3, 9):
        want = [(i, s, e) for i, t in docs for s, e in brute_near([[p for p, w in enumerate(t.split()) if w == x] for x in "abc"], slop).items()]
        assert spans(sp.find(c, "a b c", slop)) == sorted(want)


@pytest.mark.parametrize(("gap", "want"), [(4, [(0, 2), (7, 8)]), (5, [(0, 2), (7, 8)]), (6, [(0, 8)])])
def test_snippets_merge_up_to_the_gap(toy, gap, want):
    s = sp.snippets(sp.find(toy, "red fox", 0).where("doc_id = 1").unionByName(sp.find(toy, "fox").where("doc_id = 1 and start = 7")), gap - 1)
    assert sorted((r.start, r.end) for r in s.collect()) == want


def test_contexts_count_twice_and_shells_once(toy):
    s = sp.snippets(sp.find(toy, "fox"), 0).where("doc_id = 2 or doc_id = 1")
    wide = {r.term: (r.freq, r.docs, r.contexts) for r in cooc.context_counts(toy, s, 7, 7).collect()}
    assert wide["red"] == (6, 2, 4)
    shell = {(r.term, r.tick): r.freq for r in cooc.shells(toy, s, [1, 7]).collect()}
    assert shell[("red", 1)] == 1 and shell[("red", 7)] == 2
    grown = {(r.term, r.tick): r.freq for r in cooc.cumulated(cooc.shells(toy, s, [1, 7]), [1, 7]).collect()}
    assert grown[("red", 7)] == 3 and grown[("barn", 1)] == 0


def test_window_pairs_are_symmetric(toy):
    pairs = {(r.row, r.col): r.n for r in cooc.window_pairs(toy, toy.vocabulary, 2, ["the"], 1).collect()}
    assert pairs[("the", "hen")] == pairs[("hen", "the")] == 5 and ("hen", "hen") in pairs and pairs[("hen", "hen")] == 4
    assert ("the", "the") not in pairs


def test_ranking_ties_includes_and_nulls(spark):
    df = spark.createDataFrame([("b", 1.0, 1), ("a", 1.0, 1), ("c", None, 1), ("d", float("nan"), 1), ("e", 2.0, 1), ("f", 0.0, 1), ("z", -5.0, 0)], "term string, score double, freq int")
    assert [r.term for r in rank.top(df, "score", 3).orderBy("rank").collect()] == ["e", "a", "b"]
    assert [r.term for r in rank.top(df, "score", 9, lowest=True, no_zero=True).orderBy("rank").collect()] == ["z", "a", "b", "e"]
    got = rank.top_with_includes(df.where("term <> 'd'"), "score", 3, ["z", "c", "x"], ["e"]).orderBy("rank").collect()
    assert [r.term for r in got] == ["a", "z", "c"]


def test_periods():
    flat = [(y, 10, 5000) for y in range(20)]
    p = parts.periods(flat, 8, 10, edge_tokens=5000, least_docs=10)
    assert [(x.start, x.end, x.focus) for x in p][:2] == [(0, 1, False), (2, 3, False)] and sum(x.tokens for x in p) == 100_000
    assert sum(x.focus for x in p) == 1 and next(x for x in p if x.focus).start == 8
    weak = [(y, 1 if y in (3, 19) else 20, 100 if y in (3, 19) else 4000) for y in range(20)]
    p = parts.periods(weak, 10, 10, target=40, edge_tokens=1000, least_docs=10)
    assert all(x.docs >= 10 for x in p) and p[-1].end == 19 and any(x.start <= 3 <= x.end and x.tokens > 100 for x in p)
    assert parts.periods(flat, 10, 8) == parts.periods(flat, 8, 10)
    for bad in ([], [(1, 5, 0)], [(1, 20, 9000)]):
        with pytest.raises(ValueError):
            parts.periods(bad, 1, 1)
    with pytest.raises(ValueError):
        parts.periods(flat, 40, 50)


def test_part_scores_of_one_row(spark):
    row = spark.createDataFrame([([2, 30, 4, 0], 5), ([0, 2, 0, 0], 2)], "tf array<long>, focus_docs long")
    score = lambda kind, **k: [r[0] for r in row.select(parts.part_score(kind, [1000, 2000, 3000, 900], 1, 10, **k)).collect()]
    low = min(value(spark, sc.g2(30, 2000, 2, 1000)), value(spark, sc.g2(30, 2000, 4, 3000)))
    assert score("ll")[0] == pytest.approx(low * 0.5**0.3) and score("ll")[1] is None
    assert score("rate_ratio")[0] == pytest.approx(math.log2(30.3 / 2000.3 / (2.3 / 1000.3)))
    n, k, big, total = 36, 30, 2000, 6900
    tail = sum(math.comb(big, x) * math.comb(total - big, n - x) for x in range(k, n + 1)) / math.comb(total, n)
    assert score("specificity")[0] == pytest.approx(-math.log10(tail), rel=1e-6)
    assert score("ll", least_part=5000) == [None, None]


def test_specificity_sums_a_long_tail(spark):
    """A focus of half the tokens: the observed count is the mean, and both tails are the same."""
    half, n = 4_000_000, 2_000_000
    row = spark.createDataFrame([([n // 2, n // 2], 5)], "tf array<long>, focus_docs long")
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    own = math.exp(2 * choose(half, n // 2) - choose(2 * half, n))
    got = row.select(parts.part_score("specificity", [half, half], 1, 10)).first()[0]
    assert got == pytest.approx(-math.log10(0.5 + own / 2), abs=1e-6)


def tokens(spark, words):
    return spark.createDataFrame([(1, i, 1, w) for i, w in enumerate(words)], "doc_id long, seq int, pos_inc int, term string")


def terms(df, *more):
    return [tuple(r[c] for c in ("term", *more)) if more else r.term for r in df.orderBy("seq").collect()]


def test_stop_words_leave_gaps_and_skips_do_not(spark):
    t = tokens(spark, ["The", "cat", "of", "the", "house", "<b>", "sat", ".", "x", "ran"])
    assert terms(an.stop(t, ["the", "of"]), "pos_inc") == [("cat", 2), ("house", 3), ("<b>", 1), ("sat", 1), (".", 1), ("x", 1), ("ran", 1)]
    got = [(r.pos, r.term) for r in an.cleaned(an.stop(t, ["the", "of"])).orderBy("pos").collect()]
    assert got == [(1, "cat"), (4, "house"), (5, "sat"), (7, "ran")]


def test_rewriting_filters(spark):
    t = tokens(spark, ["Mice", "saw", "J", ".", "Smith", ".", "THE", "NATO", "JEAN-PAUL", "Children"])
    lex = spark.createDataFrame([("mice", "mouse"), ("saw", "see"), ("children", "child")], "form string, lemma string")
    assert terms(an.lemmas(t, lex), "lemma")[0] == ("mice", "mouse") and terms(an.lemmas(t, lex, ["Children"]), "lemma")[-1] == ("Children", None)
    assert "J. Smith" in terms(an.initials_joined(t)) and len(terms(an.initials_joined(t))) == 8
    up = [r[0] for r in t.orderBy("seq").select(an.uppercase_normalised(F.col("term"), ["NATO"])).collect()]
    assert up[6:9] == ["", "NATO", "Jean-Paul"]
    assert terms(an.sentence_start_lowered(t, ["mice", "the"]))[0] == "mice"
    m = spark.createDataFrame([("mice", "rats"), ("saw", "see")], "surface string, correction string")
    assert terms(an.replaced(t, m))[:2] == ["rats", "see"]


def test_lemmas_by_tag_and_order(spark):
    rows = [(1, i, 1, w, t) for i, (w, t) in enumerate([("saw", "NOUN"), ("saw", "VERB"), ("Saw", "X"), ("USA", "X"), ("usa", "X"), ("mice", None)])]
    t = spark.createDataFrame(rows, "doc_id long, seq int, pos_inc int, term string, tag string")
    lex = spark.createDataFrame([("saw", "VERB", "see", 2), ("saw", "NOUN", "saw-n", 1), ("usa", None, "user", 3), ("mice", None, "z-first", 1), ("mice", None, "a-second", 2)], "form string, tag string, lemma string, ord int")
    assert terms(an.lemmas(t, lex), "tag", "lemma") == [("saw", "NOUN", "saw-n"), ("saw", "VERB", "see"), ("saw", "X", "saw-n"), ("USA", "X", None), ("usa", "X", "user"), ("mice", None, "z-first")]


def test_cleaning_looks_at_tags_and_lemmas(spark):
    rows = [(1, i, 1, *x) for i, x in enumerate([("a", "ADP", None), ("b", "NOUN", None), ("чат", "NOUN", None), ("чат", "NOUN", "chat"), ("of the", "ADP", None), ("x-", "NOUN", "y"), ("l'", "DET", None), (".", "PUNCT", None), ("fin", "NOUN", None)])]
    t = spark.createDataFrame(rows, "doc_id long, seq int, pos_inc int, term string, tag string, lemma string")
    assert [(r.pos, r.term) for r in an.cleaned(t).orderBy("pos").collect()] == [(0, "a"), (3, "of the"), (6, "fin")]


def test_expressions_by_lemma_and_overlaps(spark):
    rows = [(1, i, 1, w, m) for i, (w, m) in enumerate([("takes", "take"), ("place", None), ("of", None), ("the", None), ("art", None), ("of", None)])]
    t = spark.createDataFrame(rows, "doc_id long, seq int, pos_inc int, term string, lemma string")
    assert terms(an.expressions(t, ["take place", "place of the", "of the art", "the art"])) == ["take place", "of the art", "of"]
    assert terms(an.expressions(t, [])) == ["takes", "place", "of", "the", "art", "of"] and an.expressions(t.where("false"), ["a b"]).collect() == []


def test_zones_by_attribute(spark):
    t = tokens(spark, ['<div class="a" x:note="1">', "in", "<div>", "deep", "</div>", "<br/>", "still", "</div>", "out", "<p Note>", "no", "</p>", "<p note='2'>", "two", "</p>", "end"])
    zone = lambda *e: terms(an.zone(t, e, True))
    assert zone("@class") == ["in", "deep", "still"] == zone('@class="a"') and zone('@class="b"') == [] and zone("@note") == ["in", "deep", "still", "two"]
    assert zone("@note='2'", "@absent") == ["two"] and terms(an.zone(t, ["@note", "p"], False)) == ["out", "end"]
    with pytest.raises(ValueError):
        an.zone(t, ["@a=b"], True)


def test_names_and_outside_rankings(spark, toy):
    t = tokens(spark, ["Anna", "Lee", "met", "Bo", "and", "Anna", "Lee", "."])
    assert [(r["name"], r.n) for r in lexicon.name_runs(t, 5).collect()] == [("Anna Lee", 2)]
    given = spark.createDataFrame([("fox", 1.0), ("hen", 5.0), ("none", 9.0)], "term string, score double")
    counts = toy.vocabulary.select("term", F.col("tf").alias("freq"))
    assert [r.term for r in rank.ranked_outside(counts, given).orderBy("rank").collect()] == ["hen", "fox"]
    assert [r.rank for r in rank.ranked_outside(counts, given, "freq").orderBy("term").collect()] == [1, 2]
    assert [r.doc_id for r in rank.sorted_by_label(toy.documents, "source", 9).collect()] == [5, 1, 2, 3, 4]


def test_longest_expression_wins(spark):
    t = tokens(spark, ["in", "the", "In", "the", "end", "of", "the", "end"])
    assert terms(an.expressions(t, ["in the", "in the end", "the end"])) == ["in the", "in the end", "of", "the end"]


@pytest.mark.parametrize(
    ("word", "pieces"),
    [("J'aime", ["J'", "aime"]), ("donne-le-moi", ["donne", "le", "moi"]), ("parle-t-il", ["parle", "il"]), ("celui-là", ["celui", "là"]), ("c'est-à-dire", ["c'est-à-dire"]), ("qu'il", ["qu'", "il"]), ("dit-il", ["dit", "il"]), ("chat", ["chat"])],
)
def test_clitics(word, pieces):
    assert an.split_clitics(word) == pieces


def test_clitics_over_a_table(spark):
    assert terms(an.clitics(tokens(spark, ["l'enfant", "dort"]))) in (["l'", "enfant", "dort"], ["enfant", "l'", "dort"])


def test_dots_stay_with_abbreviations(spark):
    text = "M. J.-J. Smith, p. ex. c.-à-d. vers 1.5 km. Fin… &amp; l’eau <b>x</b> Dr. Who?! " + "w" * 300
    got = [r.term for r in an.markup(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("seq").collect()]
    assert got[:8] == ["M.", "J.-J.", "Smith", ",", "p.", "ex", ".", "c."] and "1.5" in got and "km" in got and "…" in got and "&" in got
    assert "l'eau" in got and "<b>" in got and "Dr." in got and "?!" in got and max(map(len, got)) == 256


def test_kinds_and_roles(spark, toy):
    from lexigrain.plans import schema

    fields = schema.inferred(toy.documents.schema)
    assert {n: f.kind for n, f in fields.items()} == {"doc_id": "number", "text": "text", "lang": "category", "source": "category", "year": "number"}
    assert schema.role(fields, "content") == "text" and schema.role(fields, "year") == "year" and schema.role(fields, "year", "doc_id") == "doc_id"
    with pytest.raises(ValueError):
        schema.role(fields, "year", "lang")
    assert schema.role({}, "content") is None


def test_markup(spark):
    t = tokens(spark, ["<nav>", "a", "<p>", "b", "</p>", "</nav>", "c", "<p>", "d", "</p>", "</section>", "e"])
    assert terms(an.zone(t, ["nav"], True)) == ["a", "b"] and terms(an.zone(t, ["nav"], False)) == ["c", "d", "e"]
    assert terms(an.boundaries(t)) == ["a", "b", "¶", "c", "d", "§", "e"]
    assert value(spark, an.detagged(F.lit('x">a <b>bold</b>\n text <i'))) == "a bold text"
    assert an.detag_keeping('x">a <b>bold <i>it</b> text</em> <i', ["b", "i"]) == "a <b>bold <i>it</i></b> text"
    assert an.detag_keeping("<b>open", ["b"]) == "<b>open</b>"


def test_small_functions(spark):
    assert [value(spark, an.roman_value(F.lit(x))) for x in ("XIV", "mcmxc", "IIII", "", "q")] == [14, 1990, -1, -1, -1]
    assert value(spark, folded(F.lit("œil été"))) == "oeil ete" == folded_text("œil été")
    assert value(spark, sc.gamma(F.lit(4.5))) == pytest.approx(math.gamma(4.5)) and value(spark, sc.incomplete_gamma(F.lit(1.0), F.lit(2.0))) == pytest.approx(1 - math.exp(-2))
    assert value(spark, sc.incomplete_gamma(F.lit(0.5), F.lit(1.5))) == pytest.approx(math.erf(1.5**0.5)) and value(spark, sc.incomplete_gamma(F.lit(2.0), F.lit(0.0))) == 0
    assert [value(spark, an.dotted_abbreviation(F.lit(x))) for x in ("M.", "p.ex.", "J.-J.", "word.")] == [True, True, True, False]
    assert [value(spark, an.ocr_garbage(F.lit(x))) for x in ("word", "baaad", "x", "a1b")] == [False, True, True, False]


def test_suggestions(toy):
    assert [r.term for r in fr.suggest(toy, "ré").orderBy("rank").collect()] == ["red", "renard"]
    assert [r.term for r in fr.suggest(toy, "ard").collect()] == ["renard"]


def test_ligatures_in_suggestions(spark):
    c = Corpus(spark.createDataFrame([(1, "cœur œuvre coeur manœuvre été")], "doc_id long, text string"), keep=())
    assert [r.term for r in fr.suggest(c, "ŒU").orderBy("rank").collect()] == ["coeur", "cœur", "manœuvre", "œuvre"]
    marks = lambda t, w: value(spark, operations.marked(F.lit(t), w))
    assert marks("cœur", "oeu") == "c<mark>œu</mark>r" and marks("cœur", "e") == "c<mark>œ</mark>ur" and marks("étété", "te") == "é<mark>té</mark><mark>té</mark>" and marks("abc", "x") == "abc" and marks("abc", "") == "abc"


def test_series(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 2, 3, 4, 7, 9)], "v long")
    r = fr.series_statistics(df, "v").first()
    assert (r.mean, r.median, r.mode, r.least, r.greatest, r.size, r.total) == (4.0, 3.0, 2, 1, 9, 7, 28)


def test_concordance(toy):
    row = concord.keyword_in_context(toy, sp.find(toy, "barn"), 8).first()
    assert (row.left, row.pivot, row.right) == ("the red ", "barn", " and the")
    html = {r.doc_id: r.html for r in concord.highlighted(toy, sp.find(toy, "fox")).collect()}
    assert html[1] == "red <mark>fox</mark> and red hen and the <mark>fox</mark>" and set(html) == {1, 2}


def test_concordances_show_the_text_as_it_is(spark):
    c = Corpus(spark.createDataFrame([(1, "An ÉTÉ in <b>Rome</b>: été, ROME!"), (2, "İ Rome")], "doc_id long, text string"), keep=())
    rows = {(r.doc_id, r.start): (r.left, r.pivot, r.right) for r in concord.keyword_in_context(c, sp.find(c, "rome"), 6).collect()}
    assert rows[(1, 4)] == ("in <b>", "Rome", "</b>: ") and rows[(1, 7)] == (" été, ", "ROME", "!")
    plain = {(r.doc_id, r.start): (r.left, r.right) for r in concord.keyword_in_context(c, sp.find(c, "rome"), 6, detag=True).collect()}
    assert plain[(1, 4)] == ("in", ":")
    found = sp.find(c, "été")
    html = concord.highlighted(c, found, snippets=sp.snippets(found, 2)).first().html
    assert html == 'An <span id="s0"><mark>ÉTÉ</mark></span> in <b>Rome</b>: <span id="s1"><mark>été</mark></span>, ROME!'


def test_histogram_has_a_row_for_every_year(toy):
    assert [(r.year, r.docs, r.tokens) for r in fr.histogram(toy).orderBy("year").collect()] == [(1, 1, 8), (2, 2, 21), (3, 0, 0), (4, 1, 0)]


def test_residual_cosines_equal_dense_ones(spark):
    rng = np.random.default_rng(2)
    dense = rng.poisson(1.0, (6, 9)).astype(float) * rng.random((6, 9))
    dense[:, 0] += 0.5
    cells = spark.createDataFrame([(f"t{i}", j, float(dense[i, j])) for i in range(6) for j in range(9) if dense[i, j] > 0], "row string, col long, w double")
    for kind, name in (("pearson", "pearson"), ("dev", "deviance")):
        m = vectors.residual_matrix(dense, name)
        got = {r.b: r.cosine for r in vectors.residual_cosine(cells, "t0", kind).collect()}
        for i in range(1, 6):
            assert got[f"t{i}"] == pytest.approx(m[0] @ m[i] / np.linalg.norm(m[0]) / np.linalg.norm(m[i]), abs=1e-5)


def sparse_cells(spark, counts, value):
    return spark.createDataFrame([(f"t{i}", int(j), float(counts[i, j])) for i, j in zip(*np.nonzero(counts), strict=True)], ["row", "col", value])


@pytest.fixture
def few_columns(monkeypatch):
    """More columns than may come to the driver."""
    monkeypatch.setattr(vectors, "DENSE", 8)


def test_gram_equals_dense_matrix_of_any_number_of_columns(spark, few_columns):
    counts = np.random.default_rng(3).poisson(0.8, (7, 40)).astype(float)
    counts[:, 0] += 1
    x = vectors.residual_matrix(counts[:, counts.sum(0) > 0])
    names, mass, gram = vectors.deviance_gram(sparse_cells(spark, counts, "n"))
    assert names == [f"t{i}" for i in range(7)] and np.allclose(gram, x @ x.T) and np.allclose(mass, counts.sum(1))
    rows, sigma, share = vectors.decompose_gram(gram, 3)
    assert all(np.allclose(a, b) for a, b in zip((rows, sigma, share), vectors.decompose(x, 3), strict=True))
    for a, b in zip(vectors.word_plane_gram(gram, mass), vectors.word_plane(x, mass), strict=True):
        assert np.allclose(np.abs(a), np.abs(b))


def test_contrast_neighbours_of_any_number_of_columns(spark, few_columns):
    w = np.random.default_rng(5).poisson(0.9, (7, 40)) * np.random.default_rng(6).random((7, 40))
    w = w[:, np.linalg.norm(w, axis=0) > 0]
    g = w / np.linalg.norm(w, axis=0)
    gram, means = g.T @ g, w / w.sum(1, keepdims=True)
    v = means @ gram - gram.mean(axis=1) + means
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {r.b: r.cosine for r in vectors.contrast_neighbours(sparse_cells(spark, w, "w"), "t0").collect()}
    assert got == pytest.approx({f"t{i}": v[0] @ v[i] for i in range(1, 7)}, abs=2e-6)


def test_decompositions_and_maps():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 5))
    rows, sigma, share = vectors.decompose(x, 5, power=1.0)
    assert np.allclose(rows @ rows.T, x @ x.T) and np.allclose(sigma, np.linalg.svd(x, compute_uv=False)) and share.sum() == pytest.approx(1)
    flat = rng.normal(size=(9, 2))
    flat /= np.linalg.norm(flat, axis=1, keepdims=True)
    coords, quality, axes = vectors.map_layout(flat @ flat.T)
    want = np.linalg.norm(flat[:, None] - flat[None], axis=2)
    assert vectors.stress(coords, want) < 1e-6 and quality.min() > 0.999 and axes.sum() == pytest.approx(1)
    turned = flat @ np.array([[0, 1], [-1, 0]]) * 3 + 7
    assert np.allclose(vectors.procrustes(turned, flat), flat)
    plane, contributions, shares = vectors.word_plane(x, np.ones(12))
    assert np.allclose(contributions.sum(axis=0), 1) and shares[0] >= shares[1]
    left = vectors.all_but_the_top(x, 2)
    assert np.linalg.matrix_rank(left, tol=1e-8) == 3 and np.allclose(left.mean(axis=0), 0)
    counts = rng.poisson(5, (6, 5)).astype(float)
    assert vectors.noise_floor(counts, draws=3).shape == (5,)


def test_set_and_profile_distances(spark):
    cells = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("b", 1, 2), ("b", 2, 2), ("b", 3, 4), ("c", 9, 1)], "row string, col long, n long")
    assert {(r.a, r.b): r.distance for r in vectors.set_distance(cells, "gene_sharing").collect()} == {("a", "b"): 0.0}
    got = {(r.a, r.b): r.distance for r in vectors.profile_distance(cells, "hellinger").collect()}
    assert got[("a", "c")] == got[("b", "c")] == pytest.approx(2**0.5, abs=1e-6) and 0 < got[("a", "b")] < 1


def test_nearest_refuses_unbounded_queries(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert [r.id for r in vectors.nearest(df, df.where("vec_id = 0"), 2).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        vectors.nearest(df, df, 2, most=3)


BOOK = b"""<set xmlns="http://x/ns"><book xml:id="b1"><field name="title" type="store" value="T"/><field name="author" type="facet" value="A"/><field name="author" type="facet" value="B"/>
<field name="year" type="int" value="1900"/><chapter><field name="text" type="text">One <b>two</b></field></chapter><chapter xml:id="own"><field name="year" type="int" value="x"/></chapter></book>
<article xml:id="a1"><field name="text" type="text">Alone</field></article></set>"""


def test_xml_ingest(spark, tmp_path):
    (tmp_path / "in.xml").write_bytes(BOOK)
    docs = xml.read_documents(spark, f"file://{tmp_path}/in.xml")
    table = xml.corpus_table(docs, {"title": "store", "author": "facet", "year": "int", "text": "text"}, {"plain": "text"})
    rows = {r.id: r for r in table.collect()}
    assert list(rows) == ["b1", "b1-01", "own", "a1"] and [rows[i].ord for i in rows] == [0, 1, 2, 0]
    assert rows["b1"].author == ["A", "B"] and rows["b1"].year == 1900 and rows["own"].year is None and rows["b1-01"].text == rows["b1-01"].plain
    assert rows["a1"].type == "article" and rows["b1-01"].book_id == "b1" and "two" in rows["b1-01"].text
    for bad in (b"<!DOCTYPE x><set/>", b"<set><odd/></set>", b'<article><field name="a" type="zip" value="1"/></article>'):
        with pytest.raises(ValueError):
            xml.parse_documents(bad, "f")


def test_ingest_config(tmp_path):
    for name in ("a.xml", "b.xml", ".hidden.xml", "_skip.xml"):
        (tmp_path / name).write_text("<set/>")
    (tmp_path / "conf").write_text(f'<properties><entry key="tei">{tmp_path}/*.xml</entry><entry key="exclude">{tmp_path}/b*</entry></properties>')
    assert xml.IngestConfig.load(str(tmp_path / "conf")).files() == [str(tmp_path / "a.xml")]
    (tmp_path / "conf").write_text("<properties/>")
    with pytest.raises(ValueError):
        xml.IngestConfig.load(str(tmp_path / "conf"))


def test_tables_and_dictionaries(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'\xef\xbb\xbfa,b\r\n"x, ""q""","two\nlines"\r\n,\r\n')
    rows = lexicon.read_table(spark, f"file://{tmp_path}/t.csv").collect()
    assert rows[0].a == 'x, "q"' and rows[0].b.replace("\r", "") == "two\nlines"
    (tmp_path / "w.txt").write_text("__TITLE\nle\n\nla\n")
    assert [r.term for r in lexicon.read_words(spark, f"file://{tmp_path}/w.txt").collect()] == ["le", "la"]
    (tmp_path / "d.dic").write_text("2\nchat/S\tpo:noun\nbleu\tpo:adj ne:x\n")
    assert [(r.term, r.tags) for r in lexicon.read_hunspell(spark, f"file://{tmp_path}/d.dic").collect()] == [("chat", "po:noun"), ("bleu", "po:adj ne:x")]
    (tmp_path / "lem.csv").write_text("F,P,L\nsaw,NOUN,saw\nsaw,,see\n,X,none\n")
    assert [(r.form, r.tag, r.lemma) for r in lexicon.read_lemmas(spark, f"file://{tmp_path}/lem.csv").orderBy("ord").collect()] == [("saw", "NOUN", "saw"), ("saw", None, "see")]
    (tmp_path / "e.dic").write_text("parce que\tpo:SCONJ\nchat\tpo:noun\n")
    assert [(r.term, r.tags, r.words) for r in lexicon.read_expressions(spark, f"file://{tmp_path}/e.dic").collect()] == [("parce que", "po:SCONJ", 2)]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, o int")
    assert Counter(map(tuple, lexicon.unique_by(df, "k", "o").collect())) == Counter([("a", 1), ("b", 3)])
    assert Counter(map(tuple, lexicon.unique_by(df, "k", "o", "replace").collect())) == Counter([("a", 2), ("b", 3)])
    with pytest.raises(ValueError):
        lexicon.unique_by(df, "k", "o", "error")


def test_word2vec_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("one word", [1.0, 2.5]), ("two", [0.0, -1.0])], "name string, coords array<double>")
    assert word2vec.write_binary(df, str(tmp_path / "m.bin")) == 2
    assert [(r.word, r.vector) for r in word2vec.read_binary(spark, str(tmp_path / "m.bin")).collect()] == [("one_word", [1.0, 2.5]), ("two", [0.0, -1.0])]


def test_stream_appends_tokens_once(spark, tmp_path):
    schema = "doc_id long, text string"
    where = [str(tmp_path / x) for x in ("in", "out", "log")]
    for rows in ([(1, "one two")], [(2, "three")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(where[0])
        append.append_tokens(spark, *where, schema).awaitTermination()
    append.append_tokens(spark, *where, schema).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(where[1]).collect())) == [(1, 0, "one"), (1, 1, "two"), (2, 0, "three")]


def test_stored_corpus_equals_the_texts(spark, toy, tmp_path):
    path = f"file://{tmp_path}/c"
    assert store.build(toy, path) == 1
    c = store.open_stored(spark, path, toy.documents)
    same = lambda f, *columns: Counter(map(tuple, f(c).select(*columns).collect())) == Counter(map(tuple, f(toy).select(*columns).collect()))
    french = F.col("lang") == "fr"
    for part in (lambda x: x, lambda x: x.select(french).select(F.col("doc_id") == 3)):
        assert part(c).totals == part(toy).totals
        assert same(lambda x: part(x).tokens, "doc_id", "lang", "pos", "term") and same(lambda x: part(x).postings, "term", "doc_id", "year", "dl", "tf")  # noqa: B023
        assert same(lambda x: part(x).vocabulary, "term", "tf", "df") and same(lambda x: part(x).doc_stats, "doc_id", "source", "doc_tokens", "doc_width")  # noqa: B023
        assert same(lambda x: part(x).folded_vocabulary(), "term", "plain") and same(lambda x: part(x).occurrences(["fox", "le"]), "doc_id", "pos", "term")  # noqa: B023
        assert same(lambda x: x.contexts(sp.snippets(sp.find(part(x), "fox le"), 3), 2, 2), "doc_id", "snip", "pos", "term")  # noqa: B023
        assert same(lambda x: fr.focus_counts(part(x), french), "term", "freq", "docs", "field_freq", "field_docs")  # noqa: B023
    assert c.indexed(["fox", "no"]) == {"fox"} == toy.indexed(["fox", "no"]) and same(lambda x: concord.highlighted(x, sp.find(x, "fox")), "doc_id", "html")
    plan = c.vocabulary._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "posting" not in plan


def test_versions_of_a_store(spark, toy, tmp_path):
    path = f"file://{tmp_path}/c"
    with pytest.raises(ValueError):
        store.open_stored(spark, path, toy.documents)
    store.build(toy, path)
    old = store.open_stored(spark, path, toy.documents)
    assert store.build(toy.select(F.col("lang") == "fr"), path) == 2
    assert store.open_stored(spark, path, toy.documents).totals["all_docs"] == 3 and old.totals["all_docs"] == 5
    (tmp_path / "c/building-dead").mkdir()
    assert store.retire(spark, path) == 0 and store.versions(spark, path) == [1, 2]
    assert store.retire(spark, path, grace_hours=-1) == 2 and store.versions(spark, path) == [2]
    with pytest.raises(ValueError):
        store.open_stored(spark, path, toy.documents, version=1)


def test_queries_share_one_store(spark, tmp_path):
    docs = spark.createDataFrame(TOY, "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    built = len(store._known)
    first = QUERIES["vocab"](spark, str(tmp_path)).count()
    assert QUERIES["field_totals"](spark, str(tmp_path)).first().n_tokens == 29 and len(store._known) == built + 1
    docs.unionByName(docs.where("doc_id = 3").withColumn("text", F.lit("new words"))).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["vocab"](spark, str(tmp_path)).count() == first + 2 and len(store._known) == built + 2


def test_sinks(spark, toy, tmp_path):
    from lexigrain.sources import sinks

    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "id long, s string").coalesce(1)
    for form, want in {"csv": 'id,s\n1,"a ""q"", b"\n2,\n', "jsonl": '{"id":1,"s":"a \\"q\\", b"}\n{"id":2}\n', "txt": '1\ta "q", b\n2\n'}.items():
        sinks.write_rows(df, str(tmp_path / form), form)
        assert "".join(p.read_text() for p in (tmp_path / form).glob("part-*")).replace('""\n', "\n") == want
    with pytest.raises(ValueError):
        sinks.write_rows(df, str(tmp_path / "x"), "docx")
    assert [r[0] for r in df.select(sinks.csv_cell(F.col("s"))).collect()] == ['"a ""q"", b"', None]
    wide = {r.term: r for r in sinks.dense_matrix(toy).collect()}
    assert wide["hen"]["2"] == 3 and wide["hen"]["3"] == 0 and (wide["fox"].tf, wide["fox"].df) == (4, 2)
    sinks.dump_terms(toy, str(tmp_path / "terms"))
    lines = [x for p in sorted((tmp_path / "terms").glob("part-*")) for x in p.read_text().split()]
    assert lines == sorted(lines) and "renard" in lines
