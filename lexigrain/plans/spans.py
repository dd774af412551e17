"""Span queries: parsing, resolution, planning as joins over positions, and merged snippets.

A query is a list of clauses: words (``_`` for a blank), "quoted terms", prefixes
(``foo*``), wildcards (``f?o*``) and groups in parentheses, which stand for any of
their members.  A quoted term is one term of several words, as an analysis that
joins expressions leaves it, and no phrase; ``phrase`` finds words in a row.
Words that the corpus doesn't have, and stop words, drop out of a query before
it is planned.  Several clauses match near each other in any order, with at most
``slop`` foreign positions in between.  Spans are rows (doc_id, start, end).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import Corpus

MAX_EXPANSIONS = 256
_LEX = re.compile(r'"([^"]*)"?|([()])|([^\s()"]+)')


@dataclass(frozen=True)
class Term:
    text: str

    def __str__(self):
        return f'"{self.text}"' if " " in self.text else self.text


@dataclass(frozen=True)
class Pattern:
    """A term pattern with * and ?; both cases of its first letter are tried."""

    text: str

    def __str__(self):
        return self.text


@dataclass(frozen=True)
class AnyOf:
    members: tuple

    def __str__(self):
        return "(" + " ".join(map(str, self.members)) + ")"


def parse(query: str, split: Callable[[str], list[str]] | None = None) -> list:
    """The clauses of a query; nested groups are flattened and an open one closes at the end.

    ``split`` cuts a word as the texts' words were cut, such as ``analysis.split_clitics``.
    """
    clauses, group, depth = [], [], 0
    normal = query.replace("’", "'").replace("“", '"').replace("”", '"').replace("‐", "-").replace("–", "-")
    pieces = split or (lambda w: [w])

    def close() -> None:
        distinct = tuple(dict.fromkeys(group))
        clauses.append(AnyOf(distinct) if len(distinct) > 1 else distinct[0])
        group.clear()

    for quoted, paren, word in _LEX.findall(normal):
        if paren == "(":
            depth += 1
        elif paren == ")":
            if depth == 1 and group:
                close()
            depth = max(0, depth - 1)
        elif word:
            for piece in [word] if re.search(r"[*?]", word) else pieces(word):
                text = piece.replace("_", " ").strip()
                if text:
                    (group if depth else clauses).append(Pattern(text) if re.search(r"[*?]", text) else Term(text))
        else:
            text = " ".join(p for w in quoted.replace("_", " ").split() for p in pieces(w))
            if text:
                (group if depth else clauses).append(Term(text))
    if group:
        close()
    return clauses


def resolve(corpus: Corpus, clauses: list, stopwords: Sequence[str] = (), roots: DataFrame | None = None) -> list:
    """The clauses as the corpus can answer them.

    Stop words, terms that the whole corpus doesn't have and bare ``*`` drop out, and groups or clauses without
    members with them.  With ``roots`` (form, root), a term that is a root of its own stays, any other stands for its
    roots that the corpus has, or for itself if it has none of them.
    """
    every = [m for c in clauses for m in (c.members if isinstance(c, AnyOf) else [c])]
    terms = {m.text.lower() for m in every if isinstance(m, Term)} - {w.lower() for w in stopwords}
    of: dict[str, list[str]] = {}
    if roots is not None:
        # The rows of the query's own words.
        for r in roots.where(F.col("form").isin(sorted(terms))).select("form", "root").distinct().orderBy("form", "root").collect():
            of.setdefault(r["form"], []).append(r["root"])
    known = corpus.indexed(terms | {x for found in of.values() for x in found})

    def members(item) -> list:
        if isinstance(item, Pattern):
            return [item] if item.text.strip("*") else []
        text = item.text.lower()
        if text not in terms:
            return []
        found = of.get(text, []) if " " not in text else []
        if text in found and text in known:
            return [Term(text)]
        return [Term(r) for r in found if r in known] or ([Term(text)] if text in known else [])

    out = []
    for c in clauses:
        kept = tuple(dict.fromkeys(x for m in (c.members if isinstance(c, AnyOf) else [c]) for x in members(m)))
        if kept:
            out.append(AnyOf(kept) if len(kept) > 1 else kept[0])
    return out


def canonical(clauses: list) -> str:
    """A query string that parses to the same clauses."""
    return " ".join(map(str, clauses))


def _regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def matching_terms(corpus: Corpus, pattern: str, limit: int = MAX_EXPANSIONS) -> DataFrame:
    """Terms of the vocabulary that fit, the most frequent ones first."""
    flipped = pattern[:1].swapcase() + pattern[1:]
    hit = F.col("term").rlike(_regex(pattern)) | F.col("term").rlike(_regex(flipped))
    return corpus.vocabulary.where(hit).orderBy(F.desc("tf"), "term").limit(limit).select("term")


def phrase(corpus: Corpus, words: Sequence[str]) -> DataFrame:
    """Spans of words that stand in a row; each word after the first is met by an equi-join on its place."""
    words = [w.lower() for w in words]
    found = corpus.occurrences(sorted(set(words))).select("doc_id", "pos", "term")
    rows = found.where(F.col("term") == words[0]).select("doc_id", F.col("pos").alias("start"))
    for i, w in enumerate(words[1:], 1):
        rows = rows.join(found.where(F.col("term") == w).select("doc_id", (F.col("pos") - i).alias("start")), ["doc_id", "start"], "left_semi")
    return rows.select("doc_id", "start", (F.col("start") + len(words)).alias("end"))


def clause_spans(corpus: Corpus, clause) -> DataFrame:
    """doc_id, start, end of the tokens that a clause means; each is one position."""
    members = clause.members if isinstance(clause, AnyOf) else (clause,)
    one = lambda rows: rows.select("doc_id", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    plain = [m.text.lower() for m in members if isinstance(m, Term)]
    parts = [one(corpus.occurrences(plain))] if plain else []
    for m in members:
        if isinstance(m, Pattern):
            # At most MAX_EXPANSIONS terms, by name: the tokens of these alone are read.
            terms = [r["term"] for r in matching_terms(corpus.index, m.text.lower()).collect()]
            parts.append(one(corpus.occurrences(terms)) if terms else _none(corpus))
    whole = reduce(DataFrame.unionByName, parts)
    return whole.distinct() if len(parts) > 1 else whole


def _none(corpus: Corpus) -> DataFrame:
    return corpus.tokens.where("false").select("doc_id", F.col("pos").alias("start"), F.col("pos").alias("end"))


def near(spans: list[DataFrame], slop: int, longest: Sequence[int] | None = None) -> DataFrame:
    """Unordered proximity: for each document and start, the shortest window with one span of every clause.

    A window matches if it is at most ``slop`` longer than its spans together; they may overlap, but no two clauses
    take a span at one start.  ``longest`` has the length of each clause's longest span; it is looked up where it isn't
    given.  Every step is an equi-join on document
    and bucket of positions, so its work follows the hits and not the documents' lengths squared.
    """
    if longest is None:
        longest = [s.agg(F.coalesce(F.max(F.col("end") - F.col("start")), F.lit(1))).first()[0] for s in spans]
    # No window that matches is wider, so no part of it is.
    width = slop + sum(longest)
    bucket = lambda c: F.floor(c / F.lit(max(width, 1))).cast("int")
    now = spans[0].select("doc_id", F.col("start").alias("lo"), F.col("end").alias("hi"), (F.col("end") - F.col("start")).alias("used"), F.array("start").alias("taken"))
    for other in spans[1:]:
        side = other.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e")).withColumn("b", bucket(F.col("s")))
        probes = now.withColumn("b", F.explode(F.sequence(bucket(F.greatest(F.col("hi") - width, F.lit(0))), bucket(F.col("lo") + width))))
        lo, hi = F.least("lo", "s"), F.greatest("hi", "e")
        met = probes.join(side, ["doc_id", "b"]).where((hi - lo <= width) & ~F.array_contains("taken", F.col("s")))
        now = met.select("doc_id", lo.alias("lo"), hi.alias("hi"), (F.col("used") + F.col("e") - F.col("s")).alias("used"), F.array_append("taken", F.col("s")).alias("taken"))
    hits = now.where(F.col("hi") - F.col("lo") - F.col("used") <= slop)
    return hits.groupBy("doc_id", F.col("lo").alias("start")).agg(F.min("hi").alias("end"))


def find(corpus: Corpus, query: str, slop: int = 20, stopwords: Sequence[str] = (), roots: DataFrame | None = None, split: Callable[[str], list[str]] | None = None) -> DataFrame:
    """The spans of a query."""
    clauses = resolve(corpus, parse(query, split), stopwords, roots)
    if not clauses:
        return _none(corpus)
    parts = [clause_spans(corpus, c) for c in clauses]
    return parts[0] if len(parts) == 1 else near(parts, slop, [1] * len(parts))


def snippets(spans: DataFrame, gap: int) -> DataFrame:
    """Spans merged while they start within ``gap`` of the end so far: doc_id, snip, start, end, hits."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0)
    marked = spans.withColumn("opens", opens).withColumn("snip", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy("doc_id", F.col("snip").cast("int").alias("snip")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("hits"))


def pivot_terms(query: str) -> list[str]:
    """The plain terms that a query names."""
    out = []
    for c in parse(query):
        out += [m.text.lower() for m in (c.members if isinstance(c, AnyOf) else [c]) if isinstance(m, Term)]
    return list(dict.fromkeys(out))
