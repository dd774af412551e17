"""Contrast of one part of the corpus with the others: periods, part scores and rank contrasts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions import scorers
from lexigrain.plans.corpus import Corpus

from .rank import DIGITS


@dataclass
class Part:
    start: int
    end: int
    docs: int
    tokens: int
    focus: bool = False


def periods(
    histogram: list[tuple[int, int, int]], start: int, end: int, target: int = 12, edge_tokens: int = 25_000, inner_tokens: int = 1_000, least_docs: int = 10
) -> list[Part]:
    """Periods around a focus [start, end], from rows (value, docs, tokens): a few hundred at most, one per value.

    Periods are cut outward from the focus, empty ones dropped; weak outer ones merge inward, weak inner ones into the smaller neighbour.
    """
    start, end = min(start, end), max(start, end)
    tally = {v: (d, t) for v, d, t in histogram if t > 0}
    if not tally:
        raise ValueError("no values")
    lo, hi = min(tally), max(tally)
    start, end = max(start, lo), min(end, hi)

    def part(a: int, b: int, focus: bool = False) -> Part:
        inside = [tally[v] for v in range(a, b + 1) if v in tally]
        return Part(a, b, sum(d for d, _ in inside), sum(t for _, t in inside), focus)

    middle = part(start, end, True)
    if start > end or not middle.tokens:
        raise ValueError("the focus has no tokens")
    width = max(1, math.ceil((start - lo + hi - end) / target))
    left = [part(max(lo, b - width + 1), b) for b in range(start - 1, lo - 1, -width)]
    right = [part(a, min(hi, a + width - 1)) for a in range(end + 1, hi + 1, width)]

    def settled(side: list[Part]) -> list[Part]:
        """``side`` runs outward from the focus."""
        side = [p for p in side if p.tokens]

        def joined(a: Part, b: Part) -> Part:
            return Part(min(a.start, b.start), max(a.end, b.end), a.docs + b.docs, a.tokens + b.tokens)

        while len(side) > 1 and (side[-1].end - side[-1].start + 1 < width or side[-1].docs < least_docs or side[-1].tokens < edge_tokens):
            last = side.pop()
            side[-1] = joined(side[-1], last)
        side.sort(key=lambda p: p.start)
        i = 0
        while len(side) > 1 and i < len(side):
            if side[i].docs >= least_docs and side[i].tokens >= inner_tokens:
                i += 1
                continue
            if i == 0:
                j = 1
            elif i == len(side) - 1:
                j = i - 1
            else:
                j = i - 1 if side[i - 1].tokens <= side[i + 1].tokens else i + 1
            a, b = min(i, j), max(i, j)
            side[a : b + 1] = [joined(side[a], side[b])]
            i = max(0, a - 1)
        return side

    out = [*settled(left), middle, *settled(right)]
    if len(out) == 1:
        raise ValueError("there is nothing outside the focus")
    return out


def partition(corpus: Corpus, start: int, end: int, **limits) -> list[Part]:
    """Periods of the corpus; one row per year comes to the driver."""
    rows = corpus.doc_stats.where("year is not null and doc_tokens > 0").groupBy("year").agg(F.count("*"), F.sum("doc_tokens")).collect()
    return periods([tuple(r) for r in rows], start, end, **limits)


def part_of(parts: list[Part], year: Column) -> Column:
    """The number of the part that a year lies in, NULL outside; at most 128 parts."""
    if len(parts) > 128:
        raise ValueError("at most 128 parts")
    return F.coalesce(*(F.when(year.between(p.start, p.end), F.lit(i)) for i, p in enumerate(parts)))


def part_arrays(corpus: Corpus, part: Column, n: int, focus: int) -> DataFrame:
    """term, tf (array by part), focus_docs, all_tf: one aggregation, without a pivot per term."""
    rows = corpus.postings.withColumn("part", part).where("part is not null")
    slots = [F.coalesce(F.sum(F.when(F.col("part") == i, F.col("tf"))), F.lit(0)).alias(f"p{i}") for i in range(n)]
    grouped = rows.groupBy("term").agg(*slots, F.count_if(F.col("part") == focus).alias("focus_docs"))
    return grouped.select("term", F.array(*(F.col(f"p{i}") for i in range(n))).alias("tf"), "focus_docs")


def part_totals(corpus: Corpus, part: Column, n: int, focus: int) -> tuple[list[int], int]:
    """Tokens of each part (n numbers) and documents of the focus."""
    rows = corpus.doc_stats.withColumn("part", part).where("part is not null").groupBy("part").agg(F.sum("doc_tokens").alias("t"), F.count_if(F.col("doc_tokens") > 0).alias("d")).collect()
    tokens = {r["part"]: r["t"] for r in rows}
    return [tokens.get(i, 0) for i in range(n)], next((r["d"] for r in rows if r["part"] == focus), 0)


def _pairwise_g2(a, ta, b, tb) -> Column:
    absent = (a + b == 0) | (a + b == ta + tb)
    return F.when((ta <= 0) | (tb <= 0), scorers.null()).when(absent, F.lit(0.0)).otherwise(scorers.g2(a, ta, b, tb))


def part_score(kind: str, totals: list[int], focus: int, focus_docs: int, least_part: int = 1000, least_docs: int = 3, least_freq: int = 5, dispersion: float = 0.3, tail: float = 0.2, alpha: float | None = None) -> Column:
    """Score of a row (tf array, focus_docs): ll, ll_tail, residual, pearson, rate_ratio or specificity."""
    tf = [F.get(F.col("tf"), F.lit(i)).cast("double") for i in range(len(totals))]
    own, size, whole = tf[focus], float(totals[focus]), float(sum(totals))
    others = [i for i, t in enumerate(totals) if i != focus and t >= least_part]
    n = sum(tf[1:], tf[0])
    expected = n * size / whole
    if kind in ("ll", "ll_tail"):
        if not others:
            return scorers.null()
        scores = F.array_sort(F.array(*(_pairwise_g2(own, F.lit(size), tf[i], F.lit(float(totals[i]))) for i in others)))
        m = 1 if kind == "ll" else max(1, math.ceil(len(others) * tail - 1e-12))
        low = F.aggregate(F.slice(scores, 1, m), F.lit(0.0), lambda s, x: s + x) / float(m)
        spread = F.pow(F.col("focus_docs") / F.lit(float(max(focus_docs, 1))), F.lit(dispersion))
        return F.when(F.col("focus_docs") >= least_docs, low * spread)
    if kind == "residual":
        dev = lambda o, e: F.when(o > 0, 2.0 * (o * F.log(F.when(o > 0, o) / e) - o + e)).otherwise(2.0 * e)
        good = (own >= least_freq) & (expected > 0) & (expected < n)
        body = F.sqrt(F.greatest(dev(own, expected) + dev(n - own, n - expected), F.lit(0.0)))
        return F.when(good, F.when(own >= expected, body).otherwise(-body))
    if kind == "pearson":
        variance = expected * (1.0 - n / whole) * (1.0 - size / whole)
        return F.when(own >= least_freq, F.when(variance > 0, (own - expected) / F.sqrt(F.when(variance > 0, variance))).otherwise(0.0))
    if kind == "rate_ratio":
        a = 0.3 if alpha is None else alpha
        if not others:
            return scorers.null()
        rates = [(tf[i] + a) / (totals[i] + a) for i in others]
        top = F.greatest(*rates) if len(rates) > 1 else rates[0]
        return F.when(own >= least_freq, F.log2((own + a) / (size + a) / top))
    if kind == "specificity":
        up = own >= expected
        # Summed until what is left no longer counts, however long the tail is.
        good = own >= least_freq
        sum_p = F.when(good, scorers.hypergeometric_tail(own, F.lit(size), n, F.lit(whole), up))
        body = -F.log10(F.greatest(F.least(sum_p, F.lit(1.0)), F.lit(1e-300)))
        return F.when(good, F.when(up, body).otherwise(-body))
    raise ValueError(f"unknown part score {kind}")


def part_ranks(corpus: Corpus, part: Column, k: int) -> DataFrame:
    """part, term, freq, rank (from 0): the k commonest terms of each part."""
    rows = corpus.postings.withColumn("part", part).where("part is not null").groupBy("part", "term").agg(F.sum("tf").alias("freq"))
    order = Window.partitionBy("part").orderBy(F.desc("freq"), "term")
    return rows.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def rank_contrast(ranks: DataFrame, kind: str, n_parts: int, focus: int, capacity: int, totals: list[int]) -> DataFrame:
    """term, score from ranks by part; a part without the term counts as ``capacity``.

    Kinds: gap, rrf, weighted, rate, rate_median, ratio.
    """
    rows = ranks.groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct("part", "rank"))).alias("r"), F.map_from_entries(F.collect_list(F.struct("part", "freq"))).alias("f")
    )
    others = [i for i in range(n_parts) if i != focus]
    rank = lambda i: F.coalesce(F.try_element_at("r", F.lit(i)), F.lit(capacity)).cast("double")
    freq = lambda i: F.coalesce(F.try_element_at("f", F.lit(i)), F.lit(0)).cast("double")
    rrf = lambda x: 1.0 / (60.0 + x)
    theirs = F.array_sort(F.array(*(rank(i) for i in others)))
    best, own = F.get(theirs, F.lit(0)), rank(focus)
    rate = lambda i: freq(i) / float(max(totals[i], 1))
    rates = [rate(i) for i in others]
    top_rate = F.greatest(*rates) if len(rates) > 1 else rates[0]
    share = F.greatest(F.lit(0.0), 1.0 - scorers.ratio(top_rate, rate(focus)))
    weight = F.log(1.0 + freq(focus))
    half = len(others) // 2
    median = F.get(theirs, F.lit(half)) if len(others) % 2 else (F.get(theirs, F.lit(half - 1)) + F.get(theirs, F.lit(half))) / 2.0
    total = sum((rrf(rank(i)) for i in others), rrf(own))
    score = {
        "gap": best - own,
        "rrf": rrf(own) - rrf(best),
        "weighted": (rrf(own) - rrf(best)) * weight,
        "rate": (rrf(own) - rrf(best)) * weight * share,
        "rate_median": (rrf(own) - rrf(median)) * weight * share,
        "ratio": rrf(own) / total,
    }[kind]
    return rows.where(F.try_element_at("r", F.lit(focus)).isNotNull()).select("term", F.round(score, 8).alias("score"))
