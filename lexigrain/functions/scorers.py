"""Statistical scores as Column expressions.

Every function takes columns (or numbers) and returns one double column that
stays inside generated code.  An undefined score is NULL, so that ordering and
aggregation treat it alike everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def null() -> Column:
    return F.lit(None).cast("double")


def ratio(x: Column, y: Column) -> Column:
    """x / y, NULL where y is 0."""
    return F.try_divide(_d(x), _d(y))


def _cells(focus, focus_total, other, other_total):
    a, ta, b, tb = map(_d, (focus, focus_total, other, other_total))
    total, hit = ta + tb, a + b
    miss = total - hit
    return [(a, ratio(ta * hit, total)), (b, ratio(tb * hit, total)), (ta - a, ratio(ta * miss, total)), (tb - b, ratio(tb * miss, total))]


def _signed(value: Column, focus, focus_total, other, other_total) -> Column:
    a, ta, b, tb = map(_d, (focus, focus_total, other, other_total))
    up = ratio(a, ta) >= ratio(b, tb)
    return (
        F.when((ta <= 0) | (tb <= 0), F.lit(0.0))
        .when((a < 0) | (b < 0) | (a > ta) | (b > tb), null())
        .when(up, value)
        .otherwise(-value)
    )


# Keyness of a term in a focus against the rest: (a, focus total, b, other total).


def count(focus, focus_total, other, other_total) -> Column:
    return _d(focus)


def chi2(focus, focus_total, other, other_total) -> Column:
    parts = [F.when(e > 0, (o - e) * (o - e) / F.when(e > 0, e)).otherwise(0.0) for o, e in _cells(focus, focus_total, other, other_total)]
    return _signed(sum(parts[1:], parts[0]), focus, focus_total, other, other_total)


def g2(focus, focus_total, other, other_total) -> Column:
    parts = [F.when((o > 0) & (e > 0), 2.0 * o * F.log(F.when(o > 0, o) / F.when(e > 0, e))).otherwise(0.0) for o, e in _cells(focus, focus_total, other, other_total)]
    return _signed(sum(parts[1:], parts[0]), focus, focus_total, other, other_total)


def log_dice(focus, focus_total, other, other_total) -> Column:
    a, ta, b = _d(focus), _d(focus_total), _d(other)
    return F.when(ta <= 0, null()).when(a <= 0, F.lit(float("-inf"))).otherwise(14.0 + F.log2(2.0 * a / (ta + a + b)))


def log_ratio(focus, focus_total, other, other_total) -> Column:
    a, ta, b, tb = map(_d, (focus, focus_total, other, other_total))
    good = (a > 0) & (ta > 0) & (b > 0) & (tb > 0)
    return F.when(good, F.log2(ratio(ratio(a, ta), ratio(b, tb))) * F.log(a)).otherwise(0.0)


def simple_maths(focus, focus_total, other, other_total, k: float = 1.0) -> Column:
    a, ta, b, tb = map(_d, (focus, focus_total, other, other_total))
    return F.when((ta <= 0) | (tb <= 0), F.lit(0.0)).otherwise(ratio(ratio(a * 1e6, ta) + k, ratio(b * 1e6, tb) + k))


KEYNESS = {"count": count, "chi2": chi2, "g2": g2, "logdice": log_dice, "logratio": log_ratio, "simple": simple_maths}


# Association of two terms: (together, row margin, column margin, total).


def _pmi(o, r, c, n) -> Column:
    return F.log2(ratio(_d(o) * _d(n), _d(r) * _d(c)))


def assoc_log_dice(o, r, c, n) -> Column:
    return 14.0 + F.log2(ratio(2.0 * _d(o), _d(r) + _d(c)))


def assoc_g2(o, r, c, n) -> Column:
    o, r, c, n = map(_d, (o, r, c, n))
    cells = [(o, ratio(r * c, n)), (r - o, ratio(r * (n - c), n)), (c - o, ratio((n - r) * c, n)), (n - r - c + o, ratio((n - r) * (n - c), n))]
    parts = [F.when((x > 0) & (e > 0), 2.0 * x * F.log(F.when(x > 0, x) / F.when(e > 0, e))).otherwise(0.0) for x, e in cells]
    value = sum(parts[1:], parts[0])
    bad = (o > r) | (o > c) | (r > n) | (c > n) | (n - r - c + o < 0)
    return F.when(bad, null()).when(o >= ratio(r * c, n), value).otherwise(-value)


def assoc_npmi(o, r, c, n) -> Column:
    p = ratio(o, n)
    return F.when(_d(o) == 0, F.lit(-1.0)).when(p >= 1, F.lit(1.0)).otherwise(_pmi(o, r, c, n) / -F.log2(p))


def assoc_pearson(o, r, c, n) -> Column:
    e = ratio(_d(r) * _d(c), _d(n))
    return ratio(_d(o) - e, F.sqrt(e))


def assoc_ppmi(o, r, c, n) -> Column:
    return F.when(_d(o) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), _pmi(o, r, c, n)))


def assoc_raw(o, r, c, n) -> Column:
    return _d(o)


ASSOCIATION = {"logdice": assoc_log_dice, "g2": assoc_g2, "npmi": assoc_npmi, "pearson": assoc_pearson, "ppmi": assoc_ppmi, "raw": assoc_raw}


# Similarities of a document to a term: f occurrences in a document of length dl, corpus frequency cf of n tokens.


def _expected(dl, cf, n) -> Column:
    return ratio(_d(cf) * _d(dl), _d(n))


def sim_chi2(f, dl, cf, n) -> Column:
    e, f = _expected(dl, cf, n), _d(f)
    value = F.log2(F.when(f != e, (f - e) * (f - e) / e))
    return F.when(f < e, -value).otherwise(value)


def sim_chi2_inverse(f, dl, cf, n) -> Column:
    e, f = _expected(dl, cf, n), _d(f)
    return F.when(f > e, F.lit(0.0)).otherwise((f - e) * (f - e) / e)


def sim_frequency(f, dl, cf, n) -> Column:
    return _d(f)


def sim_g(f, dl, cf, n) -> Column:
    e, f, n = _expected(dl, cf, n), _d(f), _d(n)
    rest = F.when(n > f, (n - f) * F.log(F.when(n > f, n - f) / F.when(n > e, n - e))).otherwise(0.0)
    value = f * F.log(f / e) + rest
    return F.when(f < e, -value).otherwise(value)


def sim_g_simple(f, dl, cf, n) -> Column:
    e, f = _expected(dl, cf, n), _d(f)
    value = f * F.log(f / e)
    return F.when(f < e, -value).otherwise(value)


SIMILARITY = {"chi2": sim_chi2, "chi2inv": sim_chi2_inverse, "freq": sim_frequency, "g": sim_g, "gsimple": sim_g_simple}


# Weights of a term in a document.


def bm25_local(tf, dl, avgdl, k1: float = 1.2, b: float = 0.75) -> Column:
    tf, dl = _d(tf), _d(dl)
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / _d(avgdl)))


def bm25_idf(docs, df, exponent: float = 1.0) -> Column:
    return F.pow(F.log(1.0 + (_d(docs) - _d(df) + 0.5) / (_d(df) + 0.5)), F.lit(exponent))


def doc_binary(tf) -> Column:
    return F.when(_d(tf) > 0, 1.0).otherwise(0.0)


def doc_bm25(tf, dl, avgdl, docs, df, k1: float = 1.2, b: float = 0.75) -> Column:
    return bm25_idf(docs, df) * bm25_local(tf, dl, avgdl, k1, b)


def doc_keyness(scorer, tf, dl, cf, n) -> Column:
    tf, dl, cf, n = map(_d, (tf, dl, cf, n))
    return F.when((dl > n) | (tf > cf), null()).otherwise(scorer(tf, dl, cf - tf, n - dl))


def dkl(tf_sum, tf_log_tf, tf_log_dl, part_tokens) -> Column:
    """Divergence of a term's spread over documents from the documents' lengths."""
    f = _d(tf_sum)
    return F.when((f > 0) & (_d(part_tokens) > 0), ratio(_d(tf_log_tf) - f * F.log(f) - _d(tf_log_dl) + f * F.log(_d(part_tokens)), f))


def g2_part(tf, dl, rate) -> Column:
    tf = _d(tf)
    return 2.0 * tf * F.log(tf / (_d(rate) * _d(dl)))


def jaccard_part(tf, dl, cf) -> Column:
    return _d(tf) / (_d(dl) + _d(cf) - _d(tf))


# Residuals of a cell of a contingency table: observed o, expected e.


def residual_deviance(o, e) -> Column:
    o, e = _d(o), _d(e)
    body = F.when(o > 0, 2.0 * (o * F.log(o / e) - o + e)).otherwise(2.0 * e)
    return F.when(o >= e, 1.0).otherwise(-1.0) * F.sqrt(F.greatest(body, F.lit(0.0)))


def residual_freeman_tukey(o, e) -> Column:
    o, e = _d(o), _d(e)
    return F.sqrt(o) + F.sqrt(o + 1.0) - F.sqrt(4.0 * e + 1.0)


def residual_pearson(o, e) -> Column:
    return (_d(o) - _d(e)) / F.sqrt(_d(e))


RESIDUAL = {"deviance": residual_deviance, "freeman_tukey": residual_freeman_tukey, "pearson": residual_pearson}


def distance_gene_sharing(common, a, b) -> Column:
    least = F.least(_d(a), _d(b))
    return F.when(least == 0, F.when(_d(a) == _d(b), 0.0).otherwise(1.0)).otherwise(1.0 - ratio(common, least))


def distance_ochiai(common, a, b) -> Column:
    cos = ratio(common, F.sqrt(_d(a) * _d(b)))
    return F.when((_d(a) == 0) | (_d(b) == 0), F.when(_d(a) == _d(b), 0.0).otherwise(2.0**0.5)).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * cos)))


def log_gamma(x: Column) -> Column:
    """ln Gamma for x > 0: Stirling's series after shifting the argument above 8 (error below 1e-12)."""
    x = _d(x)
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(1.0), lambda p, i: p * (x + i))
    y = x + 8.0
    series = 1.0 / (12.0 * y) - 1.0 / (360.0 * F.pow(y, F.lit(3.0))) + 1.0 / (1260.0 * F.pow(y, F.lit(5.0))) - 1.0 / (1680.0 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(shift)


def gamma(x: Column) -> Column:
    """Gamma of x > 0."""
    return F.exp(log_gamma(x))


def incomplete_gamma(a: Column, x: Column, steps: int = 400) -> Column:
    """The regularised lower incomplete gamma function P(a, x), for a > 0 and x >= 0, by its power series; NULL where ``steps`` terms don't suffice."""
    a, x = _d(a), _d(x)
    empty = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    sums = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), empty, lambda acc, i: _bound(acc["t"] * x / (a + i), lambda t: F.struct(t.alias("t"), (acc["s"] + t).alias("s"))))
    value = _bound(sums, lambda r: F.when(r["t"] <= r["s"] * 1e-15, F.least(F.lit(1.0), F.exp(a * F.log(x) - x - log_gamma(a + 1.0)) * r["s"])))
    return F.when(x <= 0, 0.0).otherwise(value)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(_d(n) + 1.0) - log_gamma(_d(k) + 1.0) - log_gamma(_d(n) - _d(k) + 1.0)


def hypergeometric(k, n, r, m) -> Column:
    """P(k marked among n drawn) from m items of which r are marked."""
    return F.exp(log_choose(r, k) + log_choose(_d(m) - _d(r), _d(n) - _d(k)) - log_choose(m, n))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spread(n, r, m) -> Column:
    """Variance of the number of marked items among n drawn."""
    return _d(n) * _d(r) / _d(m) * (1.0 - _d(r) / _d(m)) * (_d(m) - _d(n)) / F.greatest(_d(m) - 1.0, F.lit(1.0))


def _run(k, n, r, m, up, depth, extra=0.0, most=None) -> Column:
    """Sum of P(x) / P(k) from k on, away from the mode (``up``: to greater x), by the ratio of neighbours.

    It runs to the end of the support, or until all that is left is below 1e-16 exp(-depth) of P(mode).  The count is a sum of
    independent trials, so Bernstein's inequality bounds the rest; P(mode) is 0.75 / (4 sd + 1) at least.  A k on the other side of
    the mode has its distance in ``extra``.  Terms above ``most`` are passed over.
    """
    given = F.struct(*(_d(v).alias(name) for name, v in {"k": k, "n": n, "r": r, "m": m, "v": _spread(n, r, m), "depth": depth, "extra": extra, "most": 1e308 if most is None else most}.items()), up.alias("up"))

    def total(g: Column) -> Column:
        level = 36.9 + F.log((4.0 * F.sqrt(g["v"]) + 1.0) / 0.75) + g["depth"]
        reach = level / 3.0 + F.sqrt(level * level / 9.0 + 2.0 * level * g["v"]) + g["extra"] + 3.0
        room = F.when(g["up"], F.least(g["n"], g["r"]) - g["k"]).otherwise(g["k"] - F.greatest(F.lit(0.0), g["n"] + g["r"] - g["m"]))
        steps = F.ceil(F.least(reach, room)).cast("long")

        def ratio_at(i: Column) -> Column:
            x, y = g["k"] + i, g["k"] - i
            upward = (g["r"] - x) * (g["n"] - x) / ((x + 1.0) * (g["m"] - g["r"] - g["n"] + x + 1.0))
            downward = y * (g["m"] - g["r"] - g["n"] + y) / ((g["r"] - y + 1.0) * (g["n"] - y + 1.0))
            return F.when(g["up"], upward).otherwise(downward)

        def added(term: Column, so_far: Column) -> Column:
            return F.struct(term.alias("t"), (so_far + F.when(term <= g["most"], term).otherwise(0.0)).alias("s"))

        places = F.when(steps > 0, F.sequence(F.lit(0).cast("long"), steps - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(places, added(F.lit(1.0), F.lit(0.0)), lambda a, i: _bound(a["t"] * ratio_at(i), lambda t: added(t, a["s"])), lambda a: a["s"])

    return _bound(given, total)


def _log_hypergeometric(k, n, r, m) -> Column:
    return log_choose(r, k) + log_choose(_d(m) - _d(r), _d(n) - _d(k)) - log_choose(m, n)


def hypergeometric_tail(k, n, r, m, up) -> Column:
    """P(X >= k) where ``up``, else P(X <= k), for a k on that side of the mean."""
    return hypergeometric(k, n, r, m) * _run(k, n, r, m, up, 0.0)


def fisher(n11, n12, n21, n22) -> Column:
    """Struct (two_sided, left_side, right_side) of exact p-values of a 2 x 2 table, for supports of any length."""
    row, col, total = _d(n11 + n12), _d(n11 + n21), _d(n11 + n12 + n21 + n22)
    up = _d(n11) * total >= row * col
    # From there on inward, neighbours differ by more than the tolerance of equal probabilities.
    tie = F.ceil(2e-7 * _spread(row, col, total)) + 1.0
    mode = F.floor((row + 1.0) * (col + 1.0) / (total + 2.0))
    first = F.when(up, F.least(mode + tie, _d(n11) - 1.0)).otherwise(F.greatest(mode - tie, _d(n11) + 1.0))
    given = F.struct(
        _d(n11).alias("k"), row.alias("row"), col.alias("col"), total.alias("total"), up.alias("up"), tie.alias("tie"), first.alias("first"),
        ((first >= F.greatest(F.lit(0.0), row + col - total)) & (first <= F.least(row, col))).alias("two"), _log_hypergeometric(n11, row, col, total).alias("own"),
    )

    def probabilities(g: Column) -> Column:
        at = (g["row"], g["col"], g["total"])
        start = F.when(g["two"], _log_hypergeometric(g["first"], *at))
        # Beyond exp(-745) a probability is zero.
        other = _bound(start, lambda b: F.exp(b) * _run(g["first"], *at, ~g["up"], F.least(F.greatest(b - g["own"], F.lit(0.0)), F.lit(745.0)), g["tie"] + 1.0, F.exp(F.least(g["own"] - b, F.lit(700.0))) * (1.0 + 1e-7)))
        return F.struct(g["up"].alias("up"), F.exp(g["own"]).alias("own"), (F.exp(g["own"]) * _run(g["k"], *at, g["up"], 0.0)).alias("near"), F.coalesce(other, F.lit(0.0)).alias("far"))

    def sides(p: Column) -> Column:
        cap = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
        back = 1.0 - p["near"] + p["own"]
        left, right = F.when(p["up"], back).otherwise(p["near"]), F.when(p["up"], p["near"]).otherwise(back)
        return F.struct(cap(p["near"] + p["far"]).alias("two_sided"), cap(left).alias("left_side"), cap(right).alias("right_side"))

    return _bound(given, lambda g: _bound(probabilities(g), sides))
