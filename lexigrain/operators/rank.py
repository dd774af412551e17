"""Top lists with the engine's tie rules: undefined scores never rank, ties go to the lesser id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def top(df: DataFrame, score: str, k: int, tie: str = "term", lowest: bool = False, no_zero: bool = False) -> DataFrame:
    """The k best rows with a ``rank`` from 1; a bounded heap per task, then one merge."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    if no_zero:
        rows = rows.where(F.col(score) != 0)
    order = [F.asc(score) if lowest else F.desc(score), F.asc(tie)]
    best = rows.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_with_includes(df: DataFrame, score: str, k: int, include: list[str], exclude: list[str] = (), tie: str = "term") -> DataFrame:
    """Terms of ``include`` take slots first, ordinary terms the rest; then all are ordered by score together."""
    forced = F.col(tie).isin(list(include)) if include else F.lit(False)
    rows = df.where(~F.col(tie).isin(list(exclude))) if exclude else df
    rows = rows.withColumn("included", forced).where(forced | (F.col(score).isNotNull() & (F.col("freq") > 0)))
    rows = rows.withColumn(score, F.coalesce(F.col(score), F.lit(float("-inf"))))
    best = rows.orderBy(F.desc("included"), F.desc(score), F.asc(tie)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(tie))))


def top_per_group(df: DataFrame, group: list[str], score: str, k: int, tie: str) -> DataFrame:
    """The k best rows of every group; Spark limits each group before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), F.asc(tie))
    return df.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_outside(counts: DataFrame, ranking: DataFrame, by: str = "score") -> DataFrame:
    """A ranking made elsewhere (term, score) over the corpus counts, ordered anew by ``by`` (score or freq); terms the counts lack are left out."""
    rows = counts.join(ranking.select("term", "score"), "term")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), F.asc("term"))))


def sorted_by_label(docs: DataFrame, label: str, k: int, reverse: bool = False, id_col: str = "doc_id") -> DataFrame:
    """The first k documents in the order of a label, those without one last; ties by id."""
    order = F.desc_nulls_last(label) if reverse else F.asc_nulls_last(label)
    return docs.orderBy(order, F.asc(id_col)).limit(k)
