"""Connected components of an edge table, by alternating star contraction.

Every step is a grouped minimum and an equi-join, so no node's neighbours are
ever collected in one place; a node with very many edges costs one partial
minimum per task, and adaptive execution splits its rows in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def _relinked(edges: DataFrame, keep) -> DataFrame:
    """Point the neighbours of each ``u`` at the least of them and u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return (
        pairs.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on another."""
    up = edges.select(F.col("u").alias("id"), F.lit(1).alias("ups"), F.lit(0).alias("downs"))
    ends = up.unionAll(edges.select(F.col("v").alias("id"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    return ends.groupBy("id").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).where("ups > 1 or ups > 0 and downs > 0").isEmpty()


def component_roots(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(node, root) for every node of an edge; root is the least id of its component and has no row itself.

    ``edges`` has two long columns.  Nulls and self-loops are ignored; no edges give no rows.
    """
    a, b = edges.columns[:2]
    now = work.write(_ordered(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), f"{name}-0")
    step = 0
    while not _settled(now):
        step += 1
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = work.write(_ordered(_relinked(both, F.col("v") > F.col("u"))), f"{name}-{step}-large")
        small = _relinked(large, F.lit(True)).unionAll(
            large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        now = work.write(_ordered(small), f"{name}-{step}")
        work.drop(f"{name}-{step}-large")
        work.drop(f"{name}-{step - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
