"""Frequencies in focus and corpus, keyness, term weights, histograms, labels and suggestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions import scorers
from lexigrain.plans.corpus import Corpus, folded_text

from .rank import DIGITS, top

def focus_counts(corpus: Corpus, focus: Column) -> DataFrame:
    """term, freq and docs in the focus, field_freq and field_docs in the corpus, in one pass and one exchange."""
    inside = lambda c: F.when(F.coalesce(focus, F.lit(False)), F.col(c)).otherwise(0)
    return corpus.counted(freq=inside("tf"), docs=inside("df"), field_freq=F.col("tf"), field_docs=F.col("df"))


def focus_total(corpus: Corpus, focus: Column) -> int:
    return corpus.doc_stats.where(focus).agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0]


def keyness(corpus: Corpus, focus: Column, scorer: str = "g2", k: int = 50) -> DataFrame:
    """Top terms of the documents for which ``focus`` holds, against the rest: rank, term, docs, freq, field_docs, field_freq, score."""
    inside, whole = focus_total(corpus, focus), corpus.totals["n_tokens"]
    counts = focus_counts(corpus, focus).where("freq > 0")
    score = scorers.KEYNESS[scorer](F.col("freq"), inside, F.col("field_freq") - F.col("freq"), whole - inside)
    scored = counts.withColumn("score", F.round(score, DIGITS))
    return top(scored, "score", k).select("rank", "term", "docs", "freq", "field_docs", "field_freq", "score")


def idf_weights(corpus: Corpus, focus: Column | None = None, mode: str = "irdf", exponent: float = 0.9) -> DataFrame:
    """term, score: corpus weights of terms, contrasted with a focus where one is given.

    Modes: bm25 (no focus), rsj, irdf, factor, weighted, minus, dkl, g2, jaccard, raw.
    """
    t = corpus.totals
    n, nd = t["n_tokens"], t["n_docs"]
    inside = F.lit(True) if focus is None else F.coalesce(focus, F.lit(False))
    rows = corpus.postings.withColumn("inside", inside)
    part = lambda x: F.sum(F.when(F.col("inside"), x).otherwise(0.0))
    rest = lambda x: F.sum(F.when(F.col("inside"), 0.0).otherwise(x))
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    local = scorers.bm25_local(tf, dl, n / max(nd, 1))
    stats = corpus.doc_stats.where(inside & (F.col("doc_tokens") > 0)).agg(F.coalesce(F.sum("doc_tokens"), F.lit(0)), F.count("*")).first() if focus is not None else (n, nd)
    ft, fd = stats
    df, fdf = F.col("df"), F.col("fdf")
    base = [F.sum("tf").alias("cf"), F.count("*").alias("df"), F.count_if("inside").alias("fdf"), F.sum(F.when(F.col("inside"), F.col("tf")).otherwise(0)).alias("ff")]
    if mode in ("g2", "jaccard"):
        rows = rows.join(corpus.vocabulary.select("term", F.col("tf").alias("all_tf")), "term")
        piece = scorers.g2_part(tf, dl, F.col("all_tf") / F.lit(float(n))) if mode == "g2" else scorers.jaccard_part(tf, dl, F.col("all_tf"))
        grouped = rows.groupBy("term").agg(part(piece).alias("acc"), rest(piece).alias("other"))
        score = F.col("acc") - F.col("other")
    elif mode == "dkl":
        pieces = {"ll": tf * F.log(tf), "ld": tf * F.log(dl), "s": tf}
        grouped = rows.groupBy("term").agg(*(part(x).alias(f"f_{c}") for c, x in pieces.items()), *(rest(x).alias(f"r_{c}") for c, x in pieces.items()))
        score = scorers.dkl(F.col("r_s"), F.col("r_ll"), F.col("r_ld"), n - ft) - scorers.dkl(F.col("f_s"), F.col("f_ll"), F.col("f_ld"), ft)
    else:
        grouped = rows.groupBy("term").agg(*base, part(local).alias("acc"), rest(local).alias("other"))
        idf, acc, other = scorers.bm25_idf(nd, df, exponent), F.col("acc"), F.col("other")
        if mode == "raw":
            score = F.col("ff").cast("double")
        elif mode == "bm25":
            score = idf * acc
        elif mode == "irdf":
            score = scorers.bm25_idf(nd - fd, df - fdf, exponent) * acc
        elif mode == "rsj":
            good = ((df - fdf) <= nd - fd) & (fdf <= fd)
            x = F.log((fdf + 0.5) * ((nd - fd) - (df - fdf) + 0.5) / ((df - fdf + 0.5) * (fd - fdf + 0.5)))
            score = F.when(good, F.signum(x) * F.pow(F.abs(x), F.lit(exponent)) * acc).otherwise(0.0)
        elif mode == "factor":
            rel = scorers.ratio(F.col("ff") / F.lit(float(max(ft, 1))), F.col("cf") / F.lit(float(n)))
            score = F.when(F.col("ff") > 0, idf * acc * F.log(F.when(F.col("ff") > 0, rel)) * F.log(F.when(F.col("ff") > 0, F.col("ff").cast("double")))).otherwise(0.0)
        elif mode == "weighted":
            score = idf * (acc - 2.0 * other)
        elif mode == "minus":
            score = idf * (acc - other)
        else:
            raise ValueError(f"unknown mode {mode}")
    return grouped.select("term", F.round(score, DIGITS).alias("score"))


def document_weights(corpus: Corpus, scorer: str, terms: list[str] | None = None) -> DataFrame:
    """term, doc_id, tf, score: binary, bm25 or keyness of terms in documents."""
    t = corpus.totals
    rows = corpus.postings.where(F.col("term").isin(terms)) if terms else corpus.postings
    vocabulary = corpus.vocabulary.where(F.col("term").isin(terms)) if terms else corpus.vocabulary
    rows = rows.join(vocabulary.select("term", F.col("tf").alias("cf"), "df"), "term")
    tf, dl = F.col("tf"), F.col("dl")
    if scorer == "binary":
        score = scorers.doc_binary(tf)
    elif scorer == "bm25":
        score = scorers.doc_bm25(tf, dl, t["n_tokens"] / max(t["n_docs"], 1), t["n_docs"], F.col("df"))
    else:
        score = scorers.doc_keyness(scorers.KEYNESS["g2"], tf, dl, F.col("cf"), t["n_tokens"])
    return rows.select("term", "doc_id", "tf", F.round(score, DIGITS).alias("score"))


def similarities(corpus: Corpus, kind: str, terms: list[str]) -> DataFrame:
    """doc_id, term, score of the independence similarities."""
    n = corpus.totals["n_tokens"]
    rows = corpus.postings.where(F.col("term").isin(terms))
    cf = corpus.vocabulary.where(F.col("term").isin(terms)).select("term", F.col("tf").alias("cf"))
    score = scorers.SIMILARITY[kind](F.col("tf"), F.col("dl"), F.col("cf"), n)
    return rows.join(cf, "term").select("doc_id", "term", F.round(score, DIGITS).alias("score"))


def histogram(corpus: Corpus, condition: Column | None = None) -> DataFrame:
    """One row per year from the least to the greatest, empty years included: docs, tokens, width."""
    rows = corpus.doc_stats.where("year is not null")
    counted = (rows.where(condition) if condition is not None else rows).groupBy("year").agg(
        F.count("*").alias("docs"), F.sum("doc_tokens").alias("tokens"), F.sum("doc_width").alias("width")
    )
    years = rows.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("year"))
    return years.join(counted, "year", "left").na.fill(0, ["docs", "tokens", "width"])


def label_counts(df: DataFrame, label: Column, many: bool = False) -> DataFrame:
    """label, docs; for a set of labels each one counts."""
    rows = df.select(F.explode(F.array_distinct(label)).alias("label")) if many else df.select(label.alias("label"))
    return rows.where("label is not null").groupBy("label").agg(F.count("*").alias("docs"))


def top_labels(df: DataFrame, label: Column, k: int = 20) -> DataFrame:
    """The k commonest labels; ties go to the greater label."""
    return label_counts(df, label).orderBy(F.desc("docs"), F.desc("label")).limit(k)


def series_statistics(df: DataFrame, value: str) -> DataFrame:
    """size, min, max, mean, median, mode, q1, q3, stddev (population) and total; quantiles are values of the series."""
    stats = df.agg(
        F.count(value).alias("size"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.avg(value), DIGITS).alias("mean"),
        F.median(value).alias("median"), F.round(F.stddev_pop(value), DIGITS).alias("stddev"), F.sum(value).alias("total"),
        F.expr(f"percentile_disc(0.25) within group (order by {value})").cast("long").alias("q1"), F.expr(f"percentile_disc(0.75) within group (order by {value})").cast("long").alias("q3"),
    )
    mode = df.groupBy(value).count().orderBy(F.desc("count"), F.asc(value)).limit(1).select(F.col(value).alias("mode"))
    return stats.join(F.broadcast(mode), F.lit(True), "left")


def series_deciles(df: DataFrame, value: str) -> DataFrame:
    """One row, d1 to d9: the deciles, each a value of the series."""
    deciles = df.agg(F.expr(f"percentile_disc(array({', '.join(str(i / 10) for i in range(1, 10))})) within group (order by {value})").alias("d"))
    return deciles.select(*(F.get("d", F.lit(i)).cast("long").alias(f"d{i + 1}") for i in range(9)))


def typed_text(typed: str) -> str:
    """What was typed in the form that terms are compared in."""
    return folded_text(typed.lower()).strip(' ()"_*?')


def suggest(corpus: Corpus, typed: str, k: int = 20, focus: Column | None = None) -> DataFrame:
    """Terms that begin with (under three letters) or hold what was typed, without regard to accents and ligatures.

    Terms are folded once a term, in the vocabulary, and only the few that match are counted in the focus.
    """
    wanted = typed_text(typed)
    plain = F.col("plain")
    hit = plain.startswith(wanted) if len(wanted) < 3 else plain.contains(wanted)
    found = corpus.folded_vocabulary().where(hit)
    if focus is None:
        counts = found.select("term", F.col("tf").alias("freq"), F.col("df").alias("docs"))
    else:
        counts = focus_counts(corpus, focus).where("freq > 0").join(found.select("term"), "term", "left_semi")
    return top(counts, "freq", k).select("rank", "term", "freq", "docs")


def first_rank(ranked: DataFrame, label: str) -> DataFrame:
    """label, first rank at which it appears in a ranked list of documents."""
    return ranked.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.min("rank").alias("first_rank"))
