"""Exact top-k inner products by tiles.

Vectors become integers, floor(scale * x).  Candidates are dealt to shards of
bounded size, and each travels to its shard once.  Queries are sent to every
shard of their length and streamed past it: a task holds the shard as a matrix,
multiplies it slice by slice with one tile of queries after the other, selects
the best k of each slice without sorting it, and folds that into the tile's
running lists.  So nothing that grows with the queries is ever held, and the
queries, not the candidates, are what is repeated.  The lists of the shards are
merged in a tree, ``FAN`` neighbouring shards at a time and level by level,
until one list is left, so no task ever gathers the lists of all shards.

Products are exact: float64 where every sum is below 2^53, 64-bit integers
where it is below 2^63, and whole numbers of any size beyond that.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; vectors of different lengths aren't compared; rows
with the query's own vec_id aren't its candidates; a repeated candidate row
counts each time and a repeated query row once; null ids take no part; a query
without candidates has no rows; components and scores beyond 64 bits count as
the ends of that range, so that scores there tie; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import slices, tidied

#: Bytes of a shard's vectors (8 a component), queries in a tile, candidates multiplied at once, lists merged at once.
SHARD_BYTES, TILE, SLICE, FAN = 64 << 20, 256, 8_192, 32
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, in that order."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _greatest(m: np.ndarray) -> np.ndarray:
    """The greatest absolute value of each row, as float (its rounding is upwards of no bound below)."""
    return np.abs(m.astype(np.float64)).max(axis=1, initial=0.0)


def _whole_product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Products as whole numbers of any size, put into 64 bits."""
    return np.clip(queries.astype(object) @ rows.astype(object).T, _LEAST, _MOST).astype(np.int64)


def _product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    a, b, n = _greatest(queries), _greatest(rows), queries.shape[1]
    bound = a.max(initial=0.0) * b.max(initial=0.0) * n
    if bound < 1 << 52:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return queries @ rows.T
    # Only rows that are large themselves need whole numbers.
    edge = math.isqrt((1 << 61) // n)
    out = np.zeros((len(queries), len(rows)), dtype=np.int64)
    few, big = (a <= edge), (b <= edge)
    if few.any() and big.any():
        out[np.ix_(few, big)] = queries[few] @ rows[big].T
    if (~few).any():
        out[~few] = _whole_product(queries[~few], rows)
    if few.any() and (~big).any():
        out[np.ix_(few, ~big)] = _whole_product(queries[few], rows[~big])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Shard:
    """The candidates of one shard, and the search of query tiles among them."""

    def __init__(self, k: int):
        self.k, self.parts, self.ids, self.rows = k, [], None, None

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.parts.append((ids, rows))

    def search(self, queries: np.ndarray, asked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Scores and ids of the k best of every query."""
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        if self.parts:
            self.ids, self.rows = np.concatenate([i for i, _ in self.parts]), np.concatenate([r for _, r in self.parts])
            self.parts = []
            self.order = np.argsort(self.ids, kind="stable")
            self.sorted = self.ids[self.order]
        lists = [none] * len(asked)
        if self.ids is None:
            return lists
        for at in range(0, len(self.ids), SLICE):
            scores, part = _product(queries, self.rows[at : at + SLICE]), self.ids[at : at + SLICE]
            for i, q in enumerate(asked):
                s, v = scores[i], part
                own = self.order[np.searchsorted(self.sorted, q) : np.searchsorted(self.sorted, q, "right")]
                own = own[(own >= at) & (own < at + len(part))] - at
                if len(own):
                    s, v = np.delete(s, own), np.delete(v, own)
                best = _best(s, v, self.k)
                s, v = np.concatenate([lists[i][0], s[best]]), np.concatenate([lists[i][1], v[best]])
                best = _best(s, v, self.k)
                lists[i] = (s[best], v[best])
        return lists


def _search(k: int):
    """Rows (length, shard, side, id, vector) in order: a shard's candidates, then the queries that stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for batch in batches:
            for part in slices(batch, TILE):
                lengths, shards, sides, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in range(4))
                cuts = np.flatnonzero((np.diff(lengths) != 0) | (np.diff(shards) != 0) | (np.diff(sides) != 0)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                    if a == b:
                        continue
                    if (now := (int(lengths[a]), int(shards[a]))) != key:
                        key, shard = now, _Shard(k)
                    rows, own = _matrix(part.column(4).slice(a, b - a)), ids[a:b].copy()
                    if sides[a] == 0:
                        shard.add(own, rows.copy())
                        continue
                    lists = shard.search(rows, own)
                    n = [len(s) for s, _ in lists]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(own, n)), pa.array(np.full(sum(n), key[1], np.int32)), pa.array(np.concatenate([v for _, v in lists])), pa.array(np.concatenate([s for s, _ in lists]))],
                        names=["query_id", "shard", "vec_id", "score"],
                    )

    return run


def top_k(
    vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row for which the condition ``is_query`` holds."""
    good = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.col(id_col).isNotNull()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = vectors.where(good & F.forall(vector_col, finite)).select(
        F.col(id_col).cast("long").alias("vec_id"), whole.alias("vector"), F.size(vector_col).alias("length"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    sizes = rows.groupBy("length").agg(F.ceil(F.count("*") * F.col("length") * 8 / F.lit(SHARD_BYTES)).cast("int").alias("shards"), F.count_if("asks").alias("asked"))
    # As many rows as there are vector lengths; joined, as nothing bounds that number.
    sizes = sizes.where("asked > 0").select("length", "shards")
    most = sizes.agg(F.coalesce(F.max("shards"), F.lit(0))).first()[0]
    rows = rows.join(sizes, "length")
    held = rows.select("length", F.pmod(F.xxhash64("vec_id", "vector"), "shards").cast("int").alias("shard"), F.lit(0).alias("side"), "vec_id", "vector")
    asked = rows.where("asks").dropDuplicates(["vec_id", "vector"])
    asked = asked.select("length", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("side"), "vec_id", "vector")
    dealt = held.unionAll(asked).repartition("length", "shard").sortWithinPartitions("length", "shard", "side")
    found = dealt.mapInArrow(tidied(_search(k)), "query_id long, shard int, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    # One level of the tree after the other: the lists of FAN neighbouring branches become one.
    while most > FAN:
        found = best(found.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")), "query_id", "shard").drop("rank")
        most = -(-most // FAN)
    return best(found, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
