"""Vector and matrix operators: residual cells, cosine joins, distances, decompositions and maps.

Cells are long-form rows (row, col, value) or lie in the rows of their columns
(col, held: structs of row and value), where pairs of cells meet without a join.
Dense linear algebra runs on the driver, on matrices over pairs of terms, whose
side is checked against ``DENSE`` first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.functions import scorers
from lexigrain.plans import store
from lexigrain.plans.corpus import Corpus

from .rank import DIGITS

#: The largest side of a matrix that comes to the driver.
DENSE = 4000


def selected_terms(corpus: Corpus, least_docs: int, most: int, by: str = "tf") -> DataFrame:
    """term, tf, df of the commonest terms in ``least_docs`` documents or more; ties keep term order."""
    return corpus.vocabulary.where(F.col("df") >= least_docs).orderBy(F.desc(by), "term").limit(most)


def term_document_cells(corpus: Corpus, terms: DataFrame) -> DataFrame:
    """row, col, n of the selected terms."""
    return corpus.postings.join(F.broadcast(terms.select("term")), "term").select(F.col("term").alias("row"), F.col("doc_id").alias("col"), F.col("tf").alias("n"))


def with_expectation(cells: DataFrame) -> DataFrame:
    """Adds e = row total * column total / total to the cells that aren't zero."""
    rows = cells.groupBy("row").agg(F.sum("n").alias("rt"))
    cols = cells.groupBy("col").agg(F.sum("n").alias("ct"))
    # The rows are few; their sum is one row in the same plan.
    total = F.broadcast(rows.agg(F.sum("rt").cast("double").alias("total")))
    e = F.col("rt").cast("double") * F.col("ct") / F.col("total")
    return cells.join(rows, "row").join(cols, "col").join(total, F.lit(True)).withColumn("e", e).select("row", "col", "n", "e")


def residuals(cells: DataFrame, kind: str) -> DataFrame:
    """row, col, value of the non-zero cells; a zero cell's residual follows from its expectation."""
    return with_expectation(cells).select("row", "col", F.round(scorers.RESIDUAL[kind](F.col("n"), F.col("e")), DIGITS).alias("value"))


def inertia(cells: DataFrame) -> DataFrame:
    """One row: the table's G2, 2 sum o ln(o / e)."""
    return with_expectation(cells).agg(F.round(2.0 * F.sum(F.col("n") * F.log(F.col("n") / F.col("e"))), DIGITS).alias("g2"))


def bm25_weight(corpus: Corpus, k1: float = 1.2, b: float = 0.75) -> Callable[[Column, Column, Column, Column], Column]:
    """BM25 of a one-term query, without the factor k1 + 1, from tf, dl and the term's tf and df; lengths count all terms."""
    t = corpus.totals

    def weight(tf: Column, dl: Column, cf: Column, df: Column) -> Column:
        idf, tf = F.log(1.0 + (float(t["n_docs"]) - df + 0.5) / (df + 0.5)), tf.cast("double")
        return idf * tf / (tf + k1 * (1.0 - b + b * dl / F.lit(t["n_tokens"] / max(t["n_docs"], 1))))

    return weight


def g2_weight(corpus: Corpus, root: bool = False) -> Callable[[Column, Column, Column, Column], Column]:
    """Signed G2 of a term in a document against the corpus, or its signed root."""
    n = corpus.totals["n_tokens"]

    def weight(tf: Column, dl: Column, cf: Column, df: Column) -> Column:
        score = scorers.doc_keyness(scorers.g2, tf, dl, cf, n)
        return F.signum(score) * F.sqrt(F.abs(score)) if root else score

    return weight


def weighted_cells(corpus: Corpus, terms: DataFrame, weight: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """row, col, w of the selected terms (term, tf, df) from the postings."""
    rows = corpus.postings.join(F.broadcast(terms.select("term", F.col("tf").alias("cf"), "df")), "term")
    return rows.select(F.col("term").alias("row"), F.col("doc_id").alias("col"), weight(F.col("tf"), F.col("dl"), F.col("cf"), F.col("df")).alias("w"))


def document_cells(corpus: Corpus, terms: DataFrame, weight: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """The cells of ``weighted_cells`` as col, held, worked out in the documents' rows, which neither travel nor are sorted.

    With more than ``DENSE`` terms, and for rows that share an id, cells are brought together by column.
    """
    listed = terms.select("term", "tf", "df").limit(DENSE + 1).collect()
    if not listed or len(listed) > DENSE:
        return by_column(weighted_cells(corpus, terms, weight))
    of = lambda k: F.create_map(*(F.lit(x) for r in listed for x in (r["term"], r[k])))
    cf, df = of("tf"), of("df")
    words = F.filter("words", lambda w: w.isin([r["term"] for r in listed]))

    def cut(rail: DataFrame) -> DataFrame:
        # Behind generators, so that each step is worked out once, whatever uses it.
        rows = rail.select("doc_id", "dl", F.explode(F.array(F.sort_array(words))).alias("w")).where(F.size("w") > 0)
        begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
        rows = rows.select("doc_id", "dl", "w", F.explode(F.array(begins)).alias("b"))
        run = lambda i, k: F.struct(F.get("w", i).alias("row"), (F.coalesce(F.get("b", k + 1), F.size("w")) - i).cast("long").alias("tf"))
        rows = rows.select("doc_id", "dl", F.explode(F.array(F.transform("b", run))).alias("t"))
        cell = lambda c: F.struct(c["row"].alias("row"), weight(c["tf"], F.col("dl"), F.element_at(cf, c["row"]), F.element_at(df, c["row"])).alias("w"))
        return rows.select(F.col("doc_id").alias("col"), F.explode(F.array(F.transform("t", cell))).alias("held"))

    rail = corpus.rail.select("doc_id", "dl", "words")
    again = rail.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return cut(rail)
    shared = weighted_cells(corpus, terms, weight).join(again, F.col("col") == F.col("doc_id"), "left_semi")
    return cut(rail.join(again, "doc_id", "left_anti")).unionByName(by_column(shared))


def by_column(cells: DataFrame) -> DataFrame:
    """Cells as col, held; rows are in order in each column.  Those that are so already are left alone."""
    if "held" in cells.columns:
        return cells
    values = [c for c in cells.columns if c not in ("row", "col")]
    return cells.groupBy("col").agg(F.sort_array(F.collect_list(F.struct("row", *values))).alias("held"))


def _products(held: DataFrame, **sums: Callable[[Column, Column], Column]) -> DataFrame:
    """a, b, own and the sums of functions of two cells over the pairs of a column: a cell with itself (own) or with a later one.

    Rows of the result are summed in every task before the one exchange by pairs of rows.
    """
    cells = held.select("held", F.posexplode("held").alias("i", "a"))
    pairs = cells.select("a", F.posexplode(F.slice("held", F.col("i") + 1, F.size("held"))).alias("j", "b"))
    by = pairs.groupBy(F.col("a.row").alias("a"), F.col("b.row").alias("b"), (F.col("j") == 0).alias("own"))
    return by.agg(*(F.sum(f(F.col("a"), F.col("b"))).alias(n) for n, f in sums.items()))


def _dots(cells: DataFrame) -> DataFrame:
    """a, b, own, dot of cells' values w; written once, as plans with functions of array elements are never recognised as alike."""
    return store.kept(_products(by_column(cells), dot=lambda a, b: a["w"] * b["w"]), "dots")


def cosine_rows(cells: DataFrame, one: str | None = None) -> DataFrame:
    """a, b, cosine of the rows of cells (w) that share a column; of one row with all others if given."""
    table = _dots(cells)
    norms = table.where("own").select(F.col("a").alias("row"), F.sqrt("dot").alias("norm"))
    dots = table.where("a < b").select("a", "b", "dot")
    if one is not None:
        turned = dots.where(F.col("b") == one).select(F.col("b").alias("a"), F.col("a").alias("b"), "dot")
        dots = dots.where(F.col("a") == one).unionAll(turned)
    dots = dots.join(norms.select(F.col("row").alias("a"), F.col("norm").alias("na")), "a").join(norms.select(F.col("row").alias("b"), F.col("norm").alias("nb")), "b")
    return dots.where((F.col("na") > 0) & (F.col("nb") > 0)).select("a", "b", (F.round(F.col("dot") / (F.col("na") * F.col("nb")), DIGITS) + 0.0).alias("cosine"))


def euclid_rows(cells: DataFrame) -> DataFrame:
    """a, b, distance of all pairs of rows of cells (w), absent cells being 0.

    From squared norms and shared columns; the rows are a stated selection, whose pairs are the result.
    """
    table = _dots(cells)
    norms = table.where("own").select(F.col("a").alias("row"), F.col("dot").alias("sq"))
    dots = table.where("a < b").select("a", "b", "dot")
    pairs = norms.select(F.col("row").alias("a"), F.col("sq").alias("na")).join(norms.select(F.col("row").alias("b"), F.col("sq").alias("nb")), F.col("a") < F.col("b"))
    square = F.col("na") + F.col("nb") - 2.0 * F.coalesce("dot", F.lit(0.0))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", F.round(F.sqrt(F.greatest(square, F.lit(0.0))), DIGITS).alias("distance"))


def residual_cosine(cells: DataFrame, one: str, kind: str) -> DataFrame:
    """Cosine of a row's independence residuals with the other rows', zero cells included.

    Pearson: a zero cell is -sqrt(e), so both sums follow from margins and shared cells.  Deviance: a zero cell
    is -sqrt(2 e); the product over all columns is put together from shared and single cells in the same way.
    """
    total = F.lit(float(cells.agg(F.sum("w")).first()[0]))
    rt = cells.groupBy("row").agg(F.sum("w").alias("rt"))
    ct = cells.groupBy("col").agg(F.sum("w").alias("ct"))
    rows = cells.join(rt, "row").join(ct, "col").withColumn("e", F.col("rt") * F.col("ct") / total)
    if kind == "pearson":
        value, zero = scorers.residual_pearson(F.col("w"), F.col("e")), lambda e: -F.sqrt(e)
    else:
        value, zero = scorers.residual_deviance(F.col("w"), F.col("e")), lambda e: -F.sqrt(2.0 * e)
    # Written as zero cell + surplus: surplus is 0 wherever the cell is.
    rows = rows.withColumn("z", zero(F.col("e"))).withColumn("s", value - F.col("z")).select("row", "col", "z", "s", "rt")
    scale = 1.0 if kind == "pearson" else 2.0
    norms = rows.groupBy("row").agg(F.sum(2.0 * F.col("z") * F.col("s") + F.col("s") * F.col("s")).alias("extra"), F.first("rt").alias("rt"))
    norms = norms.select("row", "rt", F.sqrt(F.col("extra") + scale * F.col("rt")).alias("norm"))  # sum of z^2 over all columns = scale * rt
    mine = rows.where(F.col("row") == one).select("col", F.col("z").alias("za"), F.col("s").alias("sa"), F.col("rt").alias("ra"))
    margins = norms.where(F.col("row") == one).select(F.col("rt").alias("ra"), F.col("norm").alias("na"))
    # sum z_a z_b = scale sqrt(ra rb);  sum s_a z_b over a's cells = sqrt(rb / ra) sum s_a z_a, and the same for b.
    own = mine.agg(F.coalesce(F.sum(F.col("sa") * F.col("za")), F.lit(0.0)).alias("sz"))
    other = rows.groupBy("row").agg(F.sum(F.col("s") * F.col("z")).alias("sz_b"))
    both = rows.join(mine, "col").groupBy("row").agg(F.sum(F.col("s") * F.col("sa")).alias("ss"))
    got = norms.where(F.col("row") != one).join(other, "row").join(both, "row", "left").join(F.broadcast(margins), F.lit(True)).join(F.broadcast(own), F.lit(True))
    dot = scale * F.sqrt(F.col("ra") * F.col("rt")) + F.sqrt(F.col("rt") / F.col("ra")) * F.col("sz") + F.sqrt(F.col("ra") / F.col("rt")) * F.col("sz_b") + F.coalesce("ss", F.lit(0.0))
    return got.select(F.lit(one).alias("a"), F.col("row").alias("b"), F.round(dot / (F.col("na") * F.col("norm")), DIGITS).alias("cosine"))


def contrast_neighbours(cells: DataFrame, term: str, alpha: float = 1.0, k: int = 30) -> DataFrame:
    """Neighbours of a term in contrast space: b, cosine.

    Documents are unit columns of the scored cells; a term is its weighted mean over them, against the mean
    document, in the space of the documents' Gram matrix.  Term by term this is a few sums over shared documents.
    """
    square = F.aggregate("held", F.lit(0.0), lambda x, c: x + F.coalesce(c["w"] * c["w"], F.lit(0.0)))
    unit = by_column(cells).select("held", F.explode(F.array(F.sqrt(square))).alias("norm")).where("norm > 0")
    # g: entry of the unit document; a term's weights w over its total are those of its mean, and are divided by it here.
    held = unit.select(F.explode(F.array(F.transform("held", lambda c: F.struct(c["row"].alias("row"), c["w"].alias("w"), (c["w"] / F.col("norm")).alias("g"))))).alias("held"))
    sums = _products(
        held, hh=lambda a, b: a["g"] * b["g"], wg=lambda a, b: a["w"] * b["g"], gw=lambda a, b: a["g"] * b["w"], ww=lambda a, b: a["w"] * b["w"], t=lambda a, b: a["w"], g=lambda a, b: a["g"]
    )
    every, (h, q, k_), margins = _matrices(sums, [("hh", "hh"), ("wg", "gw"), ("ww", "ww")], ["t", "g"])
    docs = held.count()
    total, mean = np.array(margins["t"]), np.array(margins["g"]) / max(docs, 1)
    used = np.flatnonzero(total)
    names = [every[i] for i in used]
    p, weight = q[used] / total[used, None], k_[np.ix_(used, used)] / np.outer(total[used], total[used])
    # A term is (p - mean document) g + alpha v over the documents; products of two such rows need term pairs only.
    away = p - mean[None, :]
    cross = away @ p.T
    inner = away @ h @ away.T + alpha * (cross + cross.T) + alpha**2 * weight
    length = np.sqrt(np.maximum(np.diag(inner), 0))
    own = names.index(term)
    size = length * length[own]
    cos = inner[own] / np.where(size > 0, size, np.nan)
    order = [i for i in np.lexsort((names, -np.nan_to_num(cos, nan=-9.0))) if i != own and np.isfinite(cos[i])][:k]
    spark = cells.sparkSession
    return spark.createDataFrame([(names[i], round(float(cos[i]), DIGITS)) for i in order], "b string, cosine double")


def _matrices(sums: DataFrame, products: Sequence[tuple[str, str]], margins: Sequence[str]) -> tuple[list, list[np.ndarray], dict[str, list[float]]]:
    """Row names, the matrices of ``_products`` (sum of a pair, sum of the pair turned) and the sums over rows' own cells.

    Columns stay distributed, each with the few rows it holds; only rows are checked against ``DENSE``.
    """
    found = store.kept(sums, "products")
    rows = sorted(r[0] for r in found.where("own").select("a").limit(DENSE + 1).collect())
    if len(rows) > DENSE:
        raise ValueError(f"the matrix has more than {DENSE} rows; select fewer")
    at = {r: i for i, r in enumerate(rows)}
    out, sides = [np.zeros((len(rows), len(rows))) for _ in products], {m: [0.0] * len(rows) for m in margins}
    for r in found.toLocalIterator():
        i, j = at[r["a"]], at[r["b"]]
        for m, (x, y) in zip(out, products, strict=True):
            m[i, j] += r[x] or 0.0
            if not r["own"]:
                m[j, i] += r[y] or 0.0
        if r["own"]:
            for name in margins:
                sides[name][i] += r[name] or 0.0
    return rows, out, sides


def deviance_gram(cells: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Row names, row totals and the products of the rows' deviance residuals of counts (n), zero cells included.

    A zero cell is z = -sqrt(2 e), and every cell is z + s with s = 0 where the count is; see ``residual_cosine``.
    """
    held = by_column(cells)
    totals = {r["row"]: r["rt"] for r in held.select(F.explode("held").alias("c")).groupBy("c.row").agg(F.sum("c.n").cast("double").alias("rt")).limit(DENSE + 1).collect()}
    if len(totals) > DENSE:
        raise ValueError(f"the matrix has more than {DENSE} rows; select fewer")
    if not totals:
        return [], np.zeros(0), np.zeros((0, 0))
    rt_of, total = F.create_map(*(F.lit(x) for kv in totals.items() for x in kv)), F.lit(sum(totals.values()))
    ct = F.aggregate("held", F.lit(0.0), lambda x, c: x + c["n"].cast("double"))
    rows = held.select("held", F.explode(F.array(ct)).alias("ct"))
    expected = lambda c: F.struct(c["row"].alias("row"), c["n"].alias("n"), (F.element_at(rt_of, c["row"]) * F.col("ct") / total).alias("e"))
    rows = rows.select(F.explode(F.array(F.transform("held", expected))).alias("held"))
    surplus = lambda c: F.struct(c["row"].alias("row"), (-F.sqrt(2.0 * c["e"])).alias("z"), (scorers.residual_deviance(c["n"], c["e"]) + F.sqrt(2.0 * c["e"])).alias("s"))
    rows = rows.select(F.explode(F.array(F.transform("held", surplus))).alias("held"))
    names, (ss,), margins = _matrices(_products(rows, ss=lambda a, b: a["s"] * b["s"], sz=lambda a, b: a["s"] * a["z"]), [("ss", "ss")], ["sz"])
    rt, sz = np.array([totals[n] for n in names]), np.array(margins["sz"])
    root = np.sqrt(rt)
    # sum z_a z_b = 2 root_a root_b;  sum s_a z_b = root_b / root_a sum s_a z_a.
    mixed = (sz / root)[:, None] * root[None, :]
    return names, rt, 2.0 * np.outer(root, root) + mixed + mixed.T + ss


def decompose_gram(gram: np.ndarray, dims: int, power: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``decompose`` of a matrix given by the products of its rows."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:dims]
    sigma = np.sqrt(np.maximum(values[order], 0))
    return _signs_fixed(vectors[:, order]) * sigma**power, sigma, sigma**2 / (float(np.trace(gram)) or 1.0)


def word_plane_gram(gram: np.ndarray, mass: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_plane`` of rows given by their products; an axis is turned by its greatest coordinate, as columns aren't at hand."""
    m = np.asarray(mass, dtype=float) / np.sum(mass)
    centre = np.eye(len(m)) - m[None, :]
    root = np.sqrt(m)
    values, axes = np.linalg.eigh(root[:, None] * (centre @ gram @ centre.T) * root[None, :])
    order = np.argsort(values)[::-1][:2]
    inertia_ = np.maximum(values[order], 1e-30)
    coords = _signs_fixed(axes[:, order] / root[:, None] * np.sqrt(inertia_))
    return coords, m[:, None] * coords**2 / inertia_, inertia_ / max(np.maximum(values, 0).sum(), 1e-30)


def residual_matrix(counts: np.ndarray, kind: str = "deviance") -> np.ndarray:
    """Residuals of a dense table, zero cells included."""
    e = counts.sum(1, keepdims=True) * counts.sum(0, keepdims=True) / counts.sum()
    if kind == "freeman_tukey":
        return np.sqrt(counts) + np.sqrt(counts + 1) - np.sqrt(4 * e + 1)
    if kind == "pearson":
        return (counts - e) / np.sqrt(np.where(e > 0, e, 1))
    ratio = np.where(counts > 0, counts, 1) / np.where(e > 0, e, 1)
    body = 2 * (np.where(counts > 0, counts * np.log(ratio), 0) - counts + e)
    return np.where(counts >= e, 1, -1) * np.sqrt(np.maximum(body, 0))


def _signs_fixed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of greatest size is positive."""
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1, 1)


def decompose(matrix: np.ndarray, dims: int, power: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row coordinates (axes weighted by sigma^power), singular values and shares of inertia of a truncated SVD."""
    small = matrix if matrix.shape[0] >= matrix.shape[1] else matrix.T
    values, vectors = np.linalg.eigh(small.T @ small)
    order = np.argsort(values)[::-1][:dims]
    sigma = np.sqrt(np.maximum(values[order], 0))
    right = vectors[:, order]
    left = small @ right / np.where(sigma > 0, sigma, 1)
    rows = left if matrix.shape[0] >= matrix.shape[1] else right
    total = float((matrix**2).sum())
    return _signs_fixed(rows) * sigma**power, sigma, sigma**2 / (total or 1.0)


def all_but_the_top(vectors: np.ndarray, remove: int) -> np.ndarray:
    """Centred vectors without their ``remove`` principal directions."""
    centred = vectors - vectors.mean(axis=0)
    if remove:
        _, axes = np.linalg.eigh(centred.T @ centred)
        top = axes[:, -remove:]
        centred = centred - centred @ top @ top.T
    return centred


def noise_floor(counts: np.ndarray, kind: str = "deviance", draws: int = 20, seed: int = 1) -> np.ndarray:
    """Mean spectrum of tables drawn from independence with the same margins' shares."""
    p = counts.sum(1, keepdims=True) * counts.sum(0, keepdims=True) / counts.sum() ** 2
    rng = np.random.default_rng(seed)
    out = [np.linalg.svd(residual_matrix(rng.multinomial(int(counts.sum()), p.ravel()).reshape(counts.shape).astype(float), kind), compute_uv=False) for _ in range(draws)]
    return np.mean(out, axis=0)


def map_layout(cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classical scaling of chord distances sqrt(2 - 2 cos): coordinates in the plane, quality of each point, shares of the axes."""
    d2 = np.maximum(2 - 2 * np.clip(cosines, -1, 1), 0)
    n = len(d2)
    centre = np.eye(n) - 1.0 / n
    gram = -0.5 * centre @ d2 @ centre
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    positive = np.maximum(values[order], 0)
    coords = _signs_fixed(vectors[:, order[:2]]) * np.sqrt(positive[:2])
    full = np.maximum((vectors[:, order] ** 2 * positive).sum(axis=1), 1e-30)
    return coords, np.clip((coords**2).sum(axis=1) / full, 0, 1), positive[:2] / max(positive.sum(), 1e-30)


def word_plane(rows: np.ndarray, mass: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mass-weighted principal plane: coordinates, contributions of the points to the axes, shares of the axes."""
    m = np.asarray(mass, dtype=float) / np.sum(mass)
    centred = rows - m @ rows
    values, axes = np.linalg.eigh(centred.T @ (centred * m[:, None]))
    order = np.argsort(values)[::-1][:2]
    coords = centred @ _signs_fixed(axes[:, order])
    inertia_ = np.maximum(values[order], 1e-30)
    return coords, m[:, None] * coords**2 / inertia_, inertia_ / max(np.maximum(values, 0).sum(), 1e-30)


def procrustes(points: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """``points`` turned, scaled and moved onto ``reference``."""
    a, b = points - points.mean(0), reference - reference.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    return a @ (u @ vt) * (s.sum() / max((a**2).sum(), 1e-30)) + reference.mean(0)


def stress(points: np.ndarray, distances: np.ndarray) -> float:
    """Kruskal's stress 1 of a layout."""
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    return float(np.sqrt(((d - distances) ** 2).sum() / max((d**2).sum(), 1e-30)))


def coordinates_frame(spark: SparkSession, names: Sequence, coords: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(str(n), [round(float(x), DIGITS) for x in c]) for n, c in zip(names, coords, strict=True)], "name string, coords array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclid", id_col: str = "vec_id", vector_col: str = "embedding", most: int = 1000) -> DataFrame:
    """query_id, rank, id, value: exact nearest rows of the given query vectors.

    The queries are broadcast behind a check that they are at most ``most``; ``lexigrain`` users with more queries
    split them into blocks.  Each task keeps the k best of a query before anything is shuffled.
    """
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q"))
    if asked.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries")
    held = asked.agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
    rows = vectors.join(F.broadcast(held), F.lit(True)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.explode("qs").alias("s"))
    rows = rows.where(F.col("id") != F.col("s.query_id"))
    q = F.col("s.q")
    if metric == "euclid":
        value = F.sqrt(F.aggregate(F.zip_with("v", q, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
        best = F.asc("value")
    else:
        norm = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(q, q))
        value = F.when(norm > 0, dot(F.col("v"), q) / norm).otherwise(0.0)
        best = F.desc("value")
    scored = rows.select(F.col("s.query_id").alias("query_id"), "id", F.round(value, DIGITS).alias("value"))
    order = Window.partitionBy("query_id").orderBy(best, "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "value")


def profile_distance(cells: DataFrame, kind: str) -> DataFrame:
    """a, b, distance between the rows of a contingency table (row, col, n): hellinger or keyness_chord, on unit profiles."""
    rt = cells.groupBy("row").agg(F.sum("n").alias("rt"))
    if kind == "hellinger":
        w = F.sqrt(F.col("n") / F.col("rt"))
        rows = cells.join(rt, "row")
    else:
        ct = cells.groupBy("col").agg(F.sum("n").alias("ct"))
        total = cells.agg(F.sum("n")).first()[0] or 0
        rows = cells.join(rt, "row").join(ct, "col")
        score = scorers.g2(F.col("n"), F.col("rt"), F.col("ct") - F.col("n"), F.lit(total) - F.col("rt"))
        w = F.sqrt(F.greatest(score, F.lit(0.0)))
    rows = rows.select("row", "col", w.alias("w")).where("w > 0")
    norm = rows.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = rows.join(norm, "row").select("row", "col", (F.col("w") / F.col("norm")).alias("w"))
    a = unit.select(F.col("row").alias("a"), "col", F.col("w").alias("x"))
    b = unit.select(F.col("row").alias("b"), "col", F.col("w").alias("y"))
    shared = a.join(b, "col").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cos"))
    # A stated set of rows against itself: every pair of profiles has a distance, also without a shared column.
    names = norm.select("row")
    pairs = names.select(F.col("row").alias("a")).join(names.select(F.col("row").alias("b")), F.col("a") < F.col("b"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("cos", F.lit(0.0))))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.round(F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * cos)), DIGITS).alias("distance"))


def set_distance(cells: DataFrame, kind: str) -> DataFrame:
    """a, b, distance between the sets of columns of rows that share one: gene_sharing or ochiai."""
    members = F.transform(F.array_distinct(F.transform("held", lambda c: c["row"])), lambda r: F.struct(r.alias("row")))
    held = by_column(cells).select(F.explode(F.array(members)).alias("held"))
    table = store.kept(_products(held, common=lambda a, b: F.lit(1)), "common")
    size = table.where("own").select(F.col("a").alias("row"), F.col("common").alias("n"))
    common = table.where("a < b").select("a", "b", "common")
    rows = common.join(size.select(F.col("row").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("row").alias("b"), F.col("n").alias("nb")), "b")
    score = (scorers.distance_gene_sharing if kind == "gene_sharing" else scorers.distance_ochiai)(F.col("common"), F.col("na"), F.col("nb"))
    return rows.select("a", "b", F.round(score, DIGITS).alias("distance"))
