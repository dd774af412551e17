"""The corpus as DataFrames: documents, rail, tokens, postings and vocabulary.

The rail holds the words of each document in order, as an array in which NULL is
a hole; a token's position is its place there.  By default a token is a run of
letters of the lower-cased text and there are no holes; an analysis chain
(``analysed``) may leave some.  A document has as many tokens as its rail has
words and is as wide as the rail is long.

A ``Corpus`` derives every table from the texts, lazily.  A ``StoredCorpus``
reads tables that were written once (``store.py``): questions about terms then
read the rows of these terms, and no text is cut again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LETTERS = "[a-zà-öø-ÿœ]+"
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"
_SPELLED = {"œ": "oe", "æ": "ae", "ß": "ss"}


def year_of(source: Column) -> Column:
    """The ordinal that stands for a year: the digits of ``source``, NULL without."""
    return F.regexp_extract(source, "^.{3}([0-9]+)$", 1).try_cast("int")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def folded(term: Column) -> Column:
    """A term without accents, ligatures spelled out."""
    for ligature, letters in _SPELLED.items():
        term = F.replace(term, F.lit(ligature), F.lit(letters))
    return F.translate(term, _ACCENTED, _PLAIN)


def folded_text(text: str) -> str:
    """What ``folded`` makes of a lower-cased string."""
    for ligature, letters in _SPELLED.items():
        text = text.replace(ligature, letters)
    return text.translate(str.maketrans(_ACCENTED, _PLAIN))


@dataclass
class Corpus:
    """``documents`` has doc_id and text; lang is the category and year the ordinal, where they are there.

    ``chain``, if given, makes positioned tokens (doc_id, pos, term) of the documents; one with an attribute ``words``
    makes the rail's words of each document in its row.
    """

    documents: DataFrame
    keep: tuple[str, ...] = field(default=("lang", "source", "year"))
    chain: Callable[[DataFrame], DataFrame] | None = None
    #: The corpus of which this one is a part.
    whole: Corpus | None = None

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str) -> Corpus:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return cls(docs.withColumn("year", year_of(F.col("source"))))

    def analysed(self, chain: Callable[[DataFrame], DataFrame]) -> Corpus:
        """The same documents with the tokens of an analysis chain, such as ``analysis.canonic``."""
        return Corpus(self.documents, self.keep, chain)

    @property
    def index(self) -> Corpus:
        """The corpus that says which terms there are: the whole one."""
        return self.whole or self

    def select(self, condition: Column) -> Corpus:
        """The part of the corpus for which the condition on document columns holds."""
        return Corpus(self.documents.where(condition), self.keep, self.chain, self.index)

    @cached_property
    def rail(self) -> DataFrame:
        """doc_id, the kept document columns, dl (words), words (NULL for a hole); a row for every document."""
        docs = self.documents.select("doc_id", *self.keep, "text")
        if self.chain is None:
            # Behind a generator, so that the text is cut once, whatever uses the words.
            words = F.coalesce(words_of(F.col("text")), F.array().cast("array<string>"))
            rows = docs.select("doc_id", *self.keep, F.explode(F.array(words)).alias("words"))
            return rows.select("doc_id", *self.keep, F.size("words").cast("long").alias("dl"), "words")
        if hasattr(self.chain, "words"):
            rows = self.chain.words(docs)
            return rows.select("doc_id", *self.keep, F.size(F.array_compact("words")).cast("long").alias("dl"), "words")
        each = self.chain(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("t"))
        hole = F.lit(None).cast("string")
        gap = lambda x, i: x["pos"] - F.coalesce(F.get("t", i - 1)["pos"], F.lit(-1)) - 1
        words = F.flatten(F.transform("t", lambda x, i: F.concat(F.array_repeat(hole, gap(x, i).cast("int")), F.array(x["term"]))))
        each = each.select("doc_id", F.size("t").cast("long").alias("dl"), words.alias("words"))
        rows = docs.select("doc_id", *self.keep).join(each, "doc_id", "left")
        return rows.select("doc_id", *self.keep, F.coalesce("dl", F.lit(0)).alias("dl"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))

    @cached_property
    def tokens(self) -> DataFrame:
        """doc_id, the kept document columns, pos, term."""
        rows = self.rail.select("doc_id", *self.keep, F.posexplode("words").alias("pos", "term"))
        return rows.where("term is not null") if self.chain else rows

    @cached_property
    def postings(self) -> DataFrame:
        """term, doc_id, kept columns, dl (the document's tokens), tf.

        Texts are dealt by document before they are cut: the counts then need no further exchange, and a
        document travels as one compressed row instead of one row for each of its terms.
        """
        if self.chain is None:
            dealt = Corpus(self.documents.select("doc_id", *self.keep, "text").repartition("doc_id"), self.keep).rail
        else:
            dealt = self.rail
        words = dealt.select("doc_id", *self.keep, "dl", F.explode("words").alias("term")).where("term is not null")
        return words.groupBy("term", "doc_id", *self.keep, "dl").agg(F.count("*").alias("tf"))

    def counted(self, **sums: Column) -> DataFrame:
        """term and, for each name, the sum of a column over the corpus; columns may use tf and df, documents' columns included.

        A text yields its words and then its distinct words; a row is an occurrence (tf 1) or a document (df 1) by
        its place.  Both frequencies are plain sums, added up in every task before the one exchange by term.
        """
        cut = self.rail.select(*self.keep, F.array_compact("words").alias("w")) if self.chain else self.rail.select(*self.keep, F.col("words").alias("w"))
        rows = cut.select(*self.keep, F.size("w").alias("n"), F.posexplode(F.concat("w", F.array_distinct("w"))).alias("i", "term"))
        seen = F.col("i") < F.col("n")
        rows = rows.select(*self.keep, "term", F.when(seen, 1).otherwise(0).alias("tf"), F.when(seen, 0).otherwise(1).alias("df"))
        return rows.groupBy("term").agg(*(F.sum(c).alias(n) for n, c in sums.items()))

    @cached_property
    def doc_stats(self) -> DataFrame:
        """Tokens and width (last position + 1) of every document, 0 for empty ones."""
        return self.rail.select("doc_id", *self.keep, F.col("dl").alias("doc_tokens"), F.size("words").cast("long").alias("doc_width"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        """term, tf, df."""
        return self.counted(tf=F.col("tf"), df=F.col("df"))

    def folded_vocabulary(self) -> DataFrame:
        """The vocabulary with ``plain``, the terms' folded forms."""
        return self.vocabulary.withColumn("plain", folded(F.col("term")))

    @cached_property
    def totals(self) -> dict[str, int]:
        """Corpus scalars: n_tokens, n_docs (with tokens), all_docs, max_width."""
        return total_row(self.doc_stats).first().asDict()

    def indexed(self, terms: Iterable[str]) -> set[str]:
        """Which of a few terms the whole corpus has."""
        terms = sorted(set(terms))
        return {r["term"] for r in self.index.occurrences(terms).select("term").distinct().collect()} if terms else set()

    def occurrences(self, terms: list[str]) -> DataFrame:
        """The tokens that are one of a few terms; texts without any of them aren't cut at all."""
        if self.chain is not None:
            return self.tokens.where(F.col("term").isin(terms))
        lowered = F.lower("text")
        might = F.lit(False)
        for t in terms:
            might = might | lowered.contains(t)
        return Corpus(self.documents.where(might), self.keep).tokens.where(F.col("term").isin(terms))

    def contexts(self, snippets: DataFrame, left: int, right: int) -> DataFrame:
        """The tokens around snippets: doc_id, snip, start, end, pos, term.

        Each document that has snippets meets them once, as one row of the rail, and the contexts are slices of it.
        So what travels is documents with hits, never tokens.
        """
        rows = self.met(snippets).select("doc_id", "w", F.explode("s").alias("s"))
        first = F.greatest(F.col("s.start") - left, F.lit(0))
        rows = rows.select("doc_id", "s", first.alias("first"), F.posexplode(F.slice("w", first + 1, F.col("s.end") + right - first)).alias("i", "term"))
        rows = rows.select("doc_id", "s.snip", "s.start", "s.end", (F.col("first") + F.col("i")).cast("int").alias("pos"), "term")
        return rows.where("term is not null")

    def met(self, snippets: DataFrame) -> DataFrame:
        """doc_id, w, s: the words and the snippets (snip, start, end) of each document that has some."""
        each = snippets.groupBy("doc_id").agg(F.collect_list(F.struct("snip", "start", "end")).alias("s"))
        return self._cut(self._words().join(each.hint("shuffle_hash"), "doc_id"), "s")

    @cached_property
    def repeated(self) -> DataFrame:
        """doc_id of the ids that several documents share."""
        return self.documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")

    def _words(self) -> DataFrame:
        """doc_id and what ``_cut`` makes the words of."""
        return self.documents.select("doc_id", "text") if self.chain is None else self.rail.select("doc_id", F.col("words").alias("w"))

    def _cut(self, rows: DataFrame, *others: str) -> DataFrame:
        if self.chain is not None:
            return rows
        return rows.select("doc_id", *others, F.explode(F.array(words_of(F.col("text")))).alias("w"))

    def having(self, rows: DataFrame) -> Corpus:
        """The documents that ``rows`` names by doc_id, as texts."""
        wanted = rows.select("doc_id").distinct()
        return Corpus(self.documents.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), self.keep, self.chain, self.index)

    def with_offsets(self) -> DataFrame:
        """Tokens of the texts with start_off and end_off in code points; running sums over the gaps between words."""
        gaps = F.transform(F.split(F.lower("text"), LETTERS, -1), lambda g: F.length(g))
        both = self.documents.select("doc_id", F.posexplode(F.arrays_zip(gaps.alias("gap"), words_of(F.col("text")).alias("term"))).alias("pos", "t"))
        end = F.sum(F.col("t.gap") + F.coalesce(F.length("t.term"), F.lit(0))).over(Window.partitionBy("doc_id").orderBy("pos"))
        rows = both.select("doc_id", "pos", F.col("t.term").alias("term"), end.alias("end_off")).where("term is not null")
        return rows.select("doc_id", "pos", "term", (F.col("end_off") - F.length("term")).alias("start_off"), "end_off")


def total_row(doc_stats: DataFrame) -> DataFrame:
    """One row: n_tokens, n_docs, all_docs, max_width."""
    return doc_stats.agg(
        F.coalesce(F.sum("doc_tokens"), F.lit(0)).alias("n_tokens"),
        F.count_if(F.col("doc_tokens") > 0).alias("n_docs"),
        F.count("*").alias("all_docs"),
        F.coalesce(F.max("doc_width"), F.lit(0)).alias("max_width"),
    )


@dataclass
class StoredCorpus(Corpus):
    """A corpus whose tables are read from a store; ``documents`` has the texts.

    A part of it filters the stored tables by their kept columns and counts its own frequencies.
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)
    partial: bool = False

    def select(self, condition: Column) -> Corpus:
        chosen = {n: t.where(condition) for n, t in self.tables.items() if n in ("rail", "postings", "doc_stats")}
        return StoredCorpus(self.documents.where(condition), self.keep, self.chain, self.index, chosen, True)

    @cached_property
    def rail(self) -> DataFrame:
        return self.tables["rail"]

    @cached_property
    def tokens(self) -> DataFrame:
        return self.rail.select("doc_id", *self.keep, F.posexplode("words").alias("pos", "term")).where("term is not null")

    @cached_property
    def postings(self) -> DataFrame:
        return self.tables["postings"].drop("positions")

    @cached_property
    def doc_stats(self) -> DataFrame:
        return self.tables["doc_stats"]

    @cached_property
    def repeated(self) -> DataFrame:
        return self.doc_stats.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")

    @cached_property
    def vocabulary(self) -> DataFrame:
        if self.partial:
            return self.counted(tf=F.col("tf"), df=F.col("df"))
        return self.tables["vocabulary"].select("term", "tf", "df")

    def folded_vocabulary(self) -> DataFrame:
        if self.partial:
            return self.vocabulary.join(self.index.folded_vocabulary().select("term", "plain"), "term")
        return self.tables["vocabulary"].select("term", "tf", "df", "plain")

    @cached_property
    def totals(self) -> dict[str, int]:
        return (total_row(self.doc_stats) if self.partial else self.tables["totals"]).first().asDict()

    def counted(self, **sums: Column) -> DataFrame:
        # Each file of postings is sorted by term; a task hands on one row for each of its terms.
        return self.postings.withColumn("df", F.lit(1)).groupBy("term").agg(*(F.sum(c).alias(n) for n, c in sums.items()))

    def indexed(self, terms: Iterable[str]) -> set[str]:
        terms = sorted(set(terms))
        return {r["term"] for r in self.index.vocabulary.where(F.col("term").isin(terms)).select("term").collect()} if terms else set()

    def occurrences(self, terms: list[str]) -> DataFrame:
        """Read from the postings of these terms alone."""
        rows = self.tables["postings"].where(F.col("term").isin(terms))
        return rows.select("doc_id", *self.keep, F.explode("positions").alias("pos"), "term")

    def _words(self) -> DataFrame:
        return self.rail.select("doc_id", F.col("words").alias("w"))

    def _cut(self, rows: DataFrame, *others: str) -> DataFrame:
        return rows
