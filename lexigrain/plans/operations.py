"""The query surface: one function per operation, with checked parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions import scorers
from lexigrain.operators import analysis, concord, cooc, parts, vectors
from lexigrain.operators import frequency as freq
from lexigrain.operators.rank import DIGITS, top

from . import spans as sp
from .corpus import Corpus, folded

TICKS = (5, 10, 20, 50, 100, 200, 500)
SORTS = ("count", "raw", "g2", "logratio", "logdice", "chi2", "simple")


@dataclass(frozen=True)
class Request:
    """Parameters of an operation; numbers out of range are moved to its edge."""

    q: str = ""
    start: int | None = None
    end: int | None = None
    types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    sort: str = "g2"
    ctx: int = 10
    docs: int = 100
    idf_exponent: float = 1.0
    slop: int = 20
    snippets: int = 3
    terms: int = 50
    flags: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    #: Words of the query that drop out, and whether French clitics are cut off its words.
    stopwords: tuple[str, ...] = ()
    clitics: bool = False

    def checked(self) -> Request:
        clamp = lambda x, lo, hi: max(lo, min(hi, x))
        a, b = self.start, self.end
        if a is not None and b is not None and a > b:
            a, b = b, a
        return replace(
            self, start=a, end=b, sort=self.sort if self.sort in SORTS else "g2", ctx=clamp(self.ctx, 0, 200), docs=clamp(self.docs, 1, 10_000), slop=clamp(self.slop, 0, 200),
            snippets=clamp(self.snippets, -1, 100), terms=clamp(self.terms, 1, 5000),
        )

    def condition(self) -> Column | None:
        """The documents that the filters let pass; None without filters."""
        both = []
        if self.start is not None or self.end is not None:
            both.append(F.col("year").between(-(1 << 31) if self.start is None else self.start, (1 << 31) - 1 if self.end is None else self.end))
        if self.types:
            both.append(F.col("lang").isin(list(self.types)))
        if self.tags:
            both.append(F.col("source").isin(list(self.tags)))
        return reduce(lambda x, y: x & y, both) if both else None


def _kept(corpus: Corpus, r: Request) -> Corpus:
    c = r.condition()
    return corpus if c is None else corpus.select(c)


def _found(corpus: Corpus, r: Request) -> DataFrame:
    """The spans of the request's query."""
    return sp.find(corpus, r.q, r.slop, r.stopwords, split=analysis.split_clitics if r.clitics else None)


def _scorer(r: Request) -> str:
    return "count" if r.sort == "raw" else r.sort


def terms(corpus: Corpus, request: Request, flags: DataFrame | None = None) -> DataFrame:
    """Term list of the request: rank, term, freq, docs, field_freq, field_docs, score (and contexts near a query).

    Without filter and query: the whole corpus by BM25 or count.  A year range alone: contrast with the other
    periods.  Other filters: keyness of the documents against the rest.  A query: the terms near it.
    """
    r = request.checked()
    condition = r.condition()
    if r.q.strip():
        snips = sp.snippets(_found(_kept(corpus, r), r), r.slop)
        rows = cooc.cooccurrents(corpus, snips, sp.pivot_terms(r.q), r.slop, r.slop, _scorer(r))
    elif condition is None:
        counts = corpus.vocabulary.select("term", F.col("tf").alias("freq"), F.col("df").alias("docs"), F.col("tf").alias("field_freq"), F.col("df").alias("field_docs"))
        if r.sort in ("count", "raw"):
            rows = counts.withColumn("score", F.col("freq").cast("double"))
        else:
            rows = counts.join(freq.idf_weights(corpus, None, "bm25", r.idf_exponent), "term")
    elif not r.types and not r.tags:
        return _period_terms(corpus, r)
    else:
        rows = freq.keyness(corpus, condition, _scorer(r), 1 << 30).drop("rank")
    if flags is not None and r.flags:
        from lexigrain.sources.lexicon import flagged

        rows = flagged(rows, flags, list(r.flags))
    if r.include or r.exclude:
        from lexigrain.operators.rank import top_with_includes

        return top_with_includes(rows, "score", r.terms, list(r.include), list(r.exclude))
    return top(rows, "score", r.terms)


def _period_terms(corpus: Corpus, r: Request) -> DataFrame:
    found = parts.partition(corpus, r.start if r.start is not None else -(1 << 31), r.end if r.end is not None else (1 << 31) - 1, edge_tokens=2500, least_docs=3)
    focus = next(i for i, p in enumerate(found) if p.focus)
    part = parts.part_of(found, F.col("year"))
    totals, docs = parts.part_totals(corpus, part, len(found), focus)
    rows = parts.part_arrays(corpus, part, len(found), focus)
    scored = rows.withColumn("score", F.round(parts.part_score("ll_tail", totals, focus, docs), DIGITS)).withColumn("freq", F.get("tf", F.lit(focus)))
    return top(scored.where("freq > 0"), "score", r.terms).select("rank", "term", "freq", F.col("focus_docs").alias("docs"), "score")


def freqlist(corpus: Corpus, request: Request) -> DataFrame:
    """The commonest words with a capital initial."""
    r = request.checked()
    found = corpus.documents.select(F.explode(F.regexp_extract_all("text", F.lit(analysis.WORD), F.lit(0))).alias("term"))
    counts = found.where(F.col("term").rlike(f"^[{analysis.UPPER}]")).groupBy("term").agg(F.count("*").alias("freq"))
    return top(counts, "freq", r.terms)


def suggest(corpus: Corpus, typed: str, request: Request) -> DataFrame:
    """Suggestions with every match of what was typed marked, counted in the filtered documents."""
    r = request.checked()
    rows = freq.suggest(_kept(corpus, r), typed, r.terms)
    return rows.withColumn("marked", marked(F.col("term"), freq.typed_text(typed)))


def marked(term: Column, wanted: str) -> Column:
    """A term with the letters that fold to ``wanted`` in tags, wherever they stand; a ligature is marked as a whole."""
    if not wanted:
        return term
    n = len(wanted)
    letters = F.split(term, "")
    # Where each letter's folded form begins and ends; terms are short, so summing anew for each is cheap.
    lengths = F.transform(letters, lambda c: F.length(folded(c)))
    until = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x)
    plain = folded(term)
    # Matches from left to right without overlap: (end of the last one, its starts).
    empty = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("starts"))
    step = lambda s, i: F.when((i >= s["next"]) & (F.substr(plain, i + 1, F.lit(n)) == wanted), F.struct((i + n).cast("int").alias("next"), F.array_append(s["starts"], i.cast("int")).alias("starts"))).otherwise(s)
    starts = F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(plain) - 1, F.lit(0))), empty, step)["starts"]
    opens = lambda i: F.exists(starts, lambda s: (s >= until(i)) & (s < until(i + 1)))
    closes = lambda i: F.exists(starts, lambda s: (s + n > until(i)) & (s + n <= until(i + 1)))
    tagged = F.transform(letters, lambda c, i: F.concat(F.when(opens(i), F.lit("<mark>")).otherwise(F.lit("")), c, F.when(closes(i), F.lit("</mark>")).otherwise(F.lit(""))))
    return F.array_join(tagged, "")


def chrono(corpus: Corpus, request: Request) -> DataFrame:
    """Documents and tokens of every year; with a query, its snippets and the documents that hold them."""
    r = request.checked()
    base = freq.histogram(corpus)
    if not r.q.strip():
        return base
    chosen = corpus.select(F.col("lang").isin(list(r.types))) if r.types else corpus
    n = sp.snippets(_found(chosen, r), r.slop).groupBy("doc_id").agg(F.count("*").alias("n"))
    hit = n.join(corpus.doc_stats.select("doc_id", "year"), "doc_id").groupBy("year").agg(F.sum("n").alias("snippets"), F.count("*").alias("docs_hit"))
    return base.join(hit, "year", "left").na.fill(0, ["snippets", "docs_hit"])


def cooc_profile(corpus: Corpus, request: Request, ticks: tuple[int, ...] = TICKS) -> DataFrame:
    """Key terms by distance to the query, which is required."""
    r = request.checked()
    if not r.q.strip():
        raise ValueError("a query is required")
    snips = sp.snippets(_found(_kept(corpus, r), r), r.slop)
    return cooc.profile_top(corpus, cooc.shells(corpus, snips, list(ticks)), list(ticks), sp.pivot_terms(r.q), r.terms, _scorer(r))


def results(corpus: Corpus, request: Request, order: str = "docs", after: int = -1) -> DataFrame:
    """Documents of the request; with a query by relevance (docs), in document order after a cursor (date), or by best snippets."""
    r = request.checked()
    chosen = _kept(corpus, r)
    if not r.q.strip():
        return chosen.documents.select("doc_id", *corpus.keep).where(F.col("doc_id") > after).orderBy("doc_id").limit(r.docs)
    found = _found(chosen, r)
    if order == "date":
        return concord.page_by_document(found, after, r.docs)
    if order == "snippets":
        snips = sp.snippets(found, r.slop)
        weights = terms(corpus, replace(r, terms=200)).where("score > 0").select("term", F.col("score").alias("weight"))
        return concord.best_snippets(concord.theme_scores(corpus, snips, weights, r.ctx), r.docs)
    return concord.ranked_documents(chosen, found, r.docs)


def snippets(corpus: Corpus, doc_id: int, request: Request) -> DataFrame:
    """The snippets of one document with their matches."""
    r = request.checked()
    one = corpus.select(F.col("doc_id") == doc_id)
    found = _found(one, r)
    merged = sp.snippets(found, r.slop)
    return concord.snippets_per_document(merged.join(concord.snippet_matches(merged, found), ["doc_id", "snip"]), r.snippets)


def document(corpus: Corpus, doc_id: int, request: Request) -> DataFrame:
    """One document with the query's words marked."""
    one = corpus.select(F.col("doc_id") == doc_id)
    if not request.q.strip():
        return one.documents.select("doc_id", F.col("text").alias("html"))
    return concord.highlighted(one, _found(one, request.checked()))


def vector_map(corpus: Corpus, request: Request, model: DataFrame) -> DataFrame:
    """name, coords in the plane of the request's terms by a model (word, vector)."""
    import numpy as np

    r = request.checked()
    named = terms(corpus, r).select("term").join(model, F.col("term") == F.col("word")).select("term", "vector")
    rows = sorted((x["term"], x["vector"]) for x in named.collect())  # at most r.terms rows
    v = np.array([x for _, x in rows], dtype=float)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    return vectors.coordinates_frame(corpus.documents.sparkSession, [t for t, _ in rows], vectors.map_layout(unit @ unit.T)[0])


def describe(corpus: Corpus) -> dict:
    """What the corpus holds."""
    t = corpus.totals
    years = corpus.doc_stats.agg(F.min("year"), F.max("year")).first()
    return {**t, "year_min": years[0], "year_max": years[1], "fields": corpus.documents.columns}


def contingency_totals(cells: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Row totals, column totals and grand total of (row, col, n); negative counts are an error."""
    if not cells.where("n < 0").isEmpty():
        raise ValueError("negative counts")
    return cells.groupBy("row").agg(F.sum("n").alias("n")), cells.groupBy("col").agg(F.sum("n").alias("n")), cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def star_schema(corpus: Corpus, lexicon: DataFrame) -> dict[str, DataFrame]:
    """Tables doc, orth, lem and tok; ids of words are hashes of their strings, so nothing has to be numbered in one place."""
    tokens = corpus.tokens.select("doc_id", "pos", F.col("term").alias("orth"))
    lemma = lexicon.groupBy("form").agg(F.min("lemma").alias("lemma"))
    tok = tokens.join(lemma, F.col("orth") == F.col("form"), "left").select("doc_id", "pos", "orth", F.coalesce("lemma", "orth").alias("lem"))
    number = lambda c: F.xxhash64(c)
    return {
        "doc": corpus.doc_stats,
        "orth": tok.groupBy("orth", "lem").agg(F.count("*").alias("n")).select(number("orth").alias("id"), "orth", number("lem").alias("lem_id"), "n"),
        "lem": tok.groupBy("lem").agg(F.count("*").alias("n")).select(number("lem").alias("id"), "lem", "n"),
        "tok": tok.select("doc_id", "pos", number("orth").alias("orth_id"), number("lem").alias("lem_id")),
    }


def keyness_table(corpus: Corpus, focus: Column) -> DataFrame:
    """All keyness scores of every term of the focus side by side."""
    inside = corpus.doc_stats.where(focus).agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0]
    n = corpus.totals["n_tokens"]
    rows = freq.focus_counts(corpus, focus).where("freq > 0")
    return rows.select("*", *(F.round(f(F.col("freq"), inside, F.col("field_freq") - F.col("freq"), n - inside), DIGITS).alias(k) for k, f in scorers.KEYNESS.items()))
