"""Part-of-speech tagging: by a lexicon join, or by any tagger given as a function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .analysis import SENTENCE_END, _first

#: Tokens that a tagger sees at once at most.
SENTENCE = 300


def sentences(tokens: DataFrame) -> DataFrame:
    """Adds sent: sentences end after their closing punctuation, and after ``SENTENCE`` tokens at the latest."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    closed = F.coalesce(F.sum(F.when(F.col("term").rlike(SENTENCE_END), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = tokens.withColumn("s", closed)
    inside = F.row_number().over(Window.partitionBy("doc_id", "s").orderBy("seq")) - 1
    return marked.withColumn("sent", F.struct("s", F.floor(inside / F.lit(SENTENCE)).cast("int").alias("part"))).drop("s")


def by_lexicon(tokens: DataFrame, lexicon: DataFrame, default: str = "X") -> DataFrame:
    """tag from (form, tag), the first tag of a form in ``ord`` (the least without it); a word that isn't listed is tried in lower case."""
    one = _first(lexicon, ["form"], "tag")
    exact = one.select(F.col("form").alias("f1"), F.col("tag").alias("t1"))
    low = one.select(F.col("form").alias("f2"), F.col("tag").alias("t2"))
    rows = tokens.join(exact, F.col("term") == F.col("f1"), "left").join(low, F.lower("term") == F.col("f2"), "left")
    return rows.select("doc_id", "seq", "pos_inc", "term", F.coalesce("t1", "t2", F.lit(default)).alias("tag"))


def by_tagger(tokens: DataFrame, tagger: Callable[[list[str]], list[tuple[str, float]]]) -> DataFrame:
    """tag and probability from a function over the words of a sentence; punctuation is tagged PUNCT, + becomes _.

    Sentences are rows, so a document of any length is spread over tasks.
    """
    rows = sentences(tokens).groupBy("doc_id", "sent").agg(F.sort_array(F.collect_list(F.struct("seq", "pos_inc", "term"))).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, items in zip(pdf["doc_id"], pdf["t"], strict=True):
                words = [x["term"] for x in items]
                for x, (tag, p) in zip(items, tagger(words), strict=True):
                    punct = not any(c.isalnum() for c in x["term"])
                    out.append((doc_id, x["seq"], x["pos_inc"], x["term"], "PUNCT" if punct else tag.replace("+", "_"), 1.0 if punct else float(p)))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "pos_inc", "term", "tag", "probability"])

    return rows.select("doc_id", "t").mapInPandas(run, "doc_id long, seq int, pos_inc int, term string, tag string, probability double")
