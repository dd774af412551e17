"""Results and tables to files, written by Spark's writers into any store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.plans.corpus import Corpus

#: Columns of a dense matrix at most.
WIDEST = 2000


def write_rows(df: DataFrame, path: str, form: str) -> None:
    """Rows as csv (with header, quotes doubled), json or jsonl (a line each), txt (tab-separated) or parquet."""
    writer = df.write.mode("errorifexists")
    if form == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif form in ("json", "jsonl"):
        df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value")).write.mode("errorifexists").text(path)
    elif form == "txt":
        df.select(F.concat_ws("\t", *(F.col(f"`{c}`").cast("string") for c in df.columns)).alias("value")).write.mode("errorifexists").text(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"no such format: {form!r}")


def csv_cell(value: Column) -> Column:
    """A cell for CSV: in quotes, these doubled, where it holds a quote, comma or line break."""
    text = value.cast("string")
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def dense_matrix(corpus: Corpus) -> DataFrame:
    """term, tf, df and one column per document, for corpora of at most ``WIDEST`` documents; the sparse form is ``Corpus.postings``."""
    ids = [r[0] for r in corpus.documents.select("doc_id").distinct().orderBy("doc_id").limit(WIDEST + 1).collect()]
    if len(ids) > WIDEST:
        raise ValueError(f"more than {WIDEST} documents; use the sparse form")
    wide = corpus.postings.groupBy("term").pivot("doc_id", ids).agg(F.sum("tf")).na.fill(0)
    return corpus.vocabulary.join(wide, "term")


def dump_terms(corpus: Corpus, path: str) -> None:
    """The vocabulary in term order, one term a line."""
    corpus.vocabulary.orderBy("term").select("term").write.mode("errorifexists").text(path)
