"""Co-occurrence around snippets: context counts, distance profiles and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions import scorers
from lexigrain.plans import store
from lexigrain.plans.corpus import Corpus

from .rank import DIGITS

#: Terms that are looked up in the documents' rows.
LISTED = 10_000
#: Listed words of a document whose pairs are made at once.
PART = 256


def context_counts(corpus: Corpus, snips: DataFrame, left: int, right: int) -> DataFrame:
    """term, freq, docs, contexts of the snippets' contexts; tokens in two contexts count twice."""
    rows = corpus.contexts(snips, left, right)
    per_context = rows.groupBy("term", "doc_id", "snip").agg(F.count("*").alias("n"))
    per_doc = per_context.groupBy("term", "doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("freq"), F.count("*").alias("docs"), F.sum("c").alias("contexts"))


def without_pivots(counts: DataFrame, pivots: list[str]) -> DataFrame:
    return counts.where(~F.col("term").isin(pivots))


def cooccurrents(corpus: Corpus, snips: DataFrame, pivots: list[str], left: int, right: int, scorer: str = "g2") -> DataFrame:
    """Context counts without the pivots, scored against the rest of the corpus."""
    counts = context_counts(corpus, snips, left, right)
    others = without_pivots(counts, pivots)
    # One row, in the same plan: what both sides exchange is worked out once.
    total = F.broadcast(others.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total")))
    n = corpus.totals["n_tokens"]
    rows = others.join(corpus.vocabulary.select("term", F.col("tf").alias("field_freq"), F.col("df").alias("field_docs")), "term").join(total, F.lit(True))
    score = scorers.KEYNESS[scorer](F.col("freq"), F.col("total"), F.col("field_freq") - F.col("freq"), F.lit(n) - F.col("total"))
    return rows.withColumn("score", F.round(score, DIGITS)).drop("total")


def shells(corpus: Corpus, snips: DataFrame, ticks: list[int]) -> DataFrame:
    """term, tick, freq, docs: every position counts once, at the nearest of the nested windows around any snippet.

    Counted in the row in which a document meets its snippets; documents that share an id are brought together.
    """
    again = corpus.repeated
    if again.isEmpty():
        counts = _shells_in_row(corpus.met(snips), ticks)
    else:
        counts = _shells_in_row(corpus.met(snips.join(again, "doc_id", "left_anti")), ticks)
        counts = counts.unionByName(_shells_by_document(corpus, snips.join(again, "doc_id", "left_semi"), ticks))
    # Written once: plans with functions of array elements are never recognised as alike, so each use would count again.
    return store.kept(counts.groupBy("term", "tick").agg(F.sum("n").alias("freq"), F.count_if("first").alias("docs")), "shells")


def _gap(pos: Column, start: Column, end: Column) -> Column:
    """How far a position is from a snippet."""
    return F.when(pos < start, start - pos).otherwise(F.greatest(pos - end + 1, F.lit(0)))


def _tick(gap: Column, ticks: list[int]) -> Column:
    return F.coalesce(*(F.when(gap <= t, F.lit(t)) for t in sorted(ticks)))


def _shells_in_row(rows: DataFrame, ticks: list[int]) -> DataFrame:
    """term, tick, n, first (the term's nearest tick) for each document of doc_id, w, s; nothing is exchanged or sorted but the row's own arrays."""
    widest = max(ticks)
    first = lambda s: F.greatest(s["start"] - widest, F.lit(0))
    place = lambda s: lambda t, i: F.struct((first(s) + i).alias("pos"), _gap(first(s) + i, s["start"], s["end"]).alias("gap"), t.alias("term"))
    around = F.transform("s", lambda s: F.transform(F.slice("w", first(s) + 1, s["end"] + widest - first(s)), place(s)))
    # Behind generators, so that each step is worked out once, whatever uses it.
    rows = rows.select(F.explode(F.array(F.sort_array(F.filter(F.flatten(around), lambda x: x["term"].isNotNull())))).alias("p"))
    nearest = F.filter("p", lambda x, i: (i == 0) | (x["pos"] != F.get("p", i - 1)["pos"]))
    marked = F.transform(nearest, lambda x: F.struct(x["term"].alias("term"), _tick(x["gap"], ticks).alias("tick")))
    rows = rows.select(F.explode(F.array(F.sort_array(marked))).alias("t")).where(F.size("t") > 0)
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    rows = rows.select("t", F.explode(F.array(begins)).alias("b"))
    leads = lambda i: (i == 0) | (F.get("t", i)["term"] != F.get("t", i - 1)["term"])
    run = lambda i, k: F.struct(F.get("t", i).alias("t"), (F.coalesce(F.get("b", k + 1), F.size("t")) - i).cast("long").alias("n"), leads(i).alias("first"))
    return rows.select(F.explode(F.transform("b", run)).alias("x")).select("x.t.term", "x.t.tick", "x.n", "x.first")


def _shells_by_document(corpus: Corpus, snips: DataFrame, ticks: list[int]) -> DataFrame:
    """The rows of ``_shells_in_row`` from the contexts' tokens."""
    widest = max(ticks)
    gap = _gap(F.col("pos"), F.col("start"), F.col("end"))
    nearest = corpus.contexts(snips, widest, widest).groupBy("doc_id", "pos", "term").agg(F.min(gap).alias("gap"))
    per_doc = nearest.groupBy("term", "doc_id", _tick(F.col("gap"), ticks).alias("tick")).agg(F.count("*").alias("n"))
    first = F.min("tick").over(Window.partitionBy("term", "doc_id"))
    return per_doc.select("term", "tick", "n", (F.col("tick") == first).alias("first"))


def cumulated(shell: DataFrame, ticks: list[int]) -> DataFrame:
    """Running sums over the ticks, with a row for every term and tick."""
    grid = shell.select("term").distinct().select("term", F.explode(F.array(*(F.lit(t) for t in sorted(ticks)))).alias("tick"))
    rows = grid.join(shell, ["term", "tick"], "left").na.fill(0, ["freq", "docs"])
    order = Window.partitionBy("term").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("term", "tick", F.sum("freq").over(order).alias("freq"), F.sum("docs").over(order).alias("docs"))


def profile_top(corpus: Corpus, shell: DataFrame, ticks: list[int], pivots: list[str], k: int, scorer: str = "g2") -> DataFrame:
    """The k keyest terms of each tick: tick, rank, term, freq, score."""
    rows = cumulated(without_pivots(shell, pivots), ticks)
    totals = rows.groupBy("tick").agg(F.sum("freq").alias("total"))
    n = corpus.totals["n_tokens"]
    rows = rows.join(F.broadcast(totals), "tick").join(corpus.vocabulary.select("term", F.col("tf").alias("cf")), "term").where("freq > 0")
    score = scorers.KEYNESS[scorer](F.col("freq"), F.col("total"), F.col("cf") - F.col("freq"), F.lit(n) - F.col("total"))
    order = Window.partitionBy("tick").orderBy(F.desc("score"), "term")
    scored = rows.withColumn("score", F.round(score, DIGITS)).where("score is not null")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("tick", "rank", "term", "freq", "score")


def profile_entries(top: DataFrame) -> DataFrame:
    """Each winning term once: the tick and rank at which it enters, ordered by its last score."""
    return top.groupBy("term").agg(
        F.min("tick").alias("entry_tick"), F.min_by("rank", "tick").alias("entry_rank"), F.max_by("score", "tick").alias("last_score"), F.max("tick").alias("last_tick")
    )


def matrix(corpus: Corpus, snips: DataFrame, terms: list[str], left: int, right: int, directed: bool) -> DataFrame:
    """row, col, n: pairs of the listed terms in one context, the later one as column (either way unless directed); the diagonal holds occurrences."""
    rows = corpus.contexts(snips, left, right).where(F.col("term").isin(terms))
    a = rows.select("doc_id", "snip", F.col("pos").alias("p"), F.col("term").alias("row"))
    b = rows.select("doc_id", "snip", F.col("pos").alias("q"), F.col("term").alias("col"))
    pairs = a.join(b, ["doc_id", "snip"]).where((F.col("p") < F.col("q")) & (F.col("row") != F.col("col"))).select("row", "col")
    if not directed:
        pairs = pairs.unionAll(pairs.select(F.col("col").alias("row"), F.col("row").alias("col")))
    own = rows.select(F.col("term").alias("row"), F.col("term").alias("col"))
    return pairs.unionAll(own).groupBy("row", "col").agg(F.count("*").alias("n"))


def _pairs_by_document(tokens: DataFrame, terms: DataFrame, distance: int) -> DataFrame:
    """row, col, gap; a token looks ahead in its document by a window of the sorted positions, so nothing is joined on position."""
    rows = tokens.join(terms, "term", "left_semi")
    ahead = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(1, distance)
    seen = rows.withColumn("ahead", F.collect_list(F.struct("pos", "term")).over(ahead))
    pairs = seen.select(F.col("term").alias("row"), "pos", F.explode("ahead").alias("b"))
    return pairs.select("row", F.col("b.term").alias("col"), (F.col("b.pos") - F.col("pos")).alias("gap"))


def _pairs_in_row(rail: DataFrame, listed: list[str], distance: int) -> DataFrame:
    """row, col, gap; found in the rail's rows, which neither travel nor are sorted.

    A listed word has at most ``distance`` others behind it within reach.  Long documents are taken in parts of
    ``PART`` listed words and what follows these within reach, so a task never holds all pairs of a document.
    """
    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("pos"))), lambda x: x["term"].isin(listed))
    # Behind generators, so that each step is worked out once, whatever uses it.
    rows = rail.select(F.explode(F.array(placed)).alias("t")).where(F.size("t") > 1)
    parts = F.transform(F.sequence(F.lit(1), F.size("t"), F.lit(PART)), lambda c: F.slice("t", c, PART + distance))
    rows = rows.select(F.explode(F.array(parts)).alias("t")).select(F.explode("t").alias("t"))
    pair = lambda a: lambda b: F.struct(a["term"].alias("row"), b["term"].alias("col"), (b["pos"] - a["pos"]).alias("gap"))
    reach = lambda a, i: F.filter(F.slice("t", i + 2, distance), lambda b: b["pos"] - a["pos"] <= distance)
    pairs = F.flatten(F.transform(F.slice("t", 1, PART), lambda a, i: F.transform(reach(a, i), pair(a))))
    return rows.select(F.explode(F.array(pairs)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def window_pairs(corpus: Corpus, terms: DataFrame, distance: int, stopwords: list[str] = (), stop_distance: int = 2) -> DataFrame:
    """Whole-corpus symmetric counts within ``distance``: row, col, n; pairs with a stop word only within ``stop_distance``.

    Up to ``LISTED`` terms are found in the documents' own rows; with more, or where rows share an id, tokens are brought together.
    """
    wanted = terms.select("term").distinct()
    listed = [r["term"] for r in wanted.limit(LISTED + 1).collect()]
    tokens = corpus.tokens.select("doc_id", "pos", "term")
    if len(listed) > LISTED:
        pairs = _pairs_by_document(tokens, wanted, distance)
    else:
        rail = corpus.rail.select("doc_id", "words")
        again = rail.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        if again.isEmpty():
            pairs = _pairs_in_row(rail, listed, distance)
        else:
            pairs = _pairs_in_row(rail.join(again, "doc_id", "left_anti"), listed, distance)
            pairs = pairs.unionByName(_pairs_by_document(tokens.join(again, "doc_id", "left_semi"), wanted, distance))
    if stopwords:
        stop = F.col("row").isin(list(stopwords)) | F.col("col").isin(list(stopwords))
        pairs = pairs.where(~stop | (F.col("gap") <= stop_distance))
    # Written once: plans with functions of array elements are never recognised as alike, so each use would count again.
    half = store.kept(pairs.groupBy("row", "col").agg(F.count("*").alias("n")), "pairs")
    both = half.unionAll(half.select(F.col("col").alias("row"), F.col("row").alias("col"), "n"))
    return both.groupBy("row", "col").agg(F.sum("n").alias("n"))


def associations(pairs: DataFrame, scorer: str) -> DataFrame:
    """row, col, score from a symmetric pair table and its margins."""
    margin = pairs.groupBy("row").agg(F.sum("n").alias("margin"))
    total = F.broadcast(margin.agg(F.coalesce(F.sum("margin"), F.lit(0)).alias("total")))
    rows = pairs.join(total, F.lit(True)).join(margin.withColumnRenamed("margin", "r"), "row").join(margin.select(F.col("row").alias("col"), F.col("margin").alias("c")), "col")
    score = scorers.ASSOCIATION[scorer](F.col("n"), F.col("r"), F.col("c"), F.col("total"))
    return rows.select("row", "col", "n", F.round(score, DIGITS).alias("score"))
