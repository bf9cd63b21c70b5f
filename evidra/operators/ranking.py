"""Thresholds by rank, ties included, and grids of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_fraction(df: DataFrame, keys: list[str], score: str, fraction: float, least: int = 1) -> DataFrame:
    """Rows whose score is at least that of rank ceil(fraction * n) of their group, ties included.

    Ranks come from counts of distinct scores, summed before the window, so a group with very many rows costs a
    window over its distinct scores only.
    """
    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys).orderBy(F.desc(score))
    above = counts.withColumns({"__upto": F.sum("__n").over(order), "__all": F.sum("__n").over(Window.partitionBy(*keys))})
    rank = F.least(F.greatest(F.ceil(F.col("__all") * F.lit(fraction)), F.lit(least)), F.col("__all"))
    edge = above.where(F.col("__upto") >= rank).groupBy(*keys).agg(F.max(score).alias("__edge"))
    return df.join(edge, keys).where(F.col(score) >= F.col("__edge")).drop("__edge")


def top_percent_positive(df: DataFrame, keys: list[str], value: str, percent: float, up: bool = True) -> DataFrame:
    """The same over positive values: rank max(1, ceil or floor of n * percent / 100)."""
    positive = df.where(F.col(value) > 0)
    counts = positive.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys).orderBy(F.desc(value))
    above = counts.withColumns({"__upto": F.sum("__n").over(order), "__all": F.sum("__n").over(Window.partitionBy(*keys))})
    share = F.col("__all") * F.lit(percent) / 100
    rank = F.greatest(F.ceil(share) if up else F.floor(share), F.lit(1))
    edge = above.where(F.col("__upto") >= rank).groupBy(*keys).agg(F.max(value).alias("__edge"))
    return positive.join(edge, keys).where(F.col(value) >= F.col("__edge")).drop("__edge")


def best_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in a total order, as an aggregation with partial maxima instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__best")).select(*keys, "__best.*")


def fan_out(df: DataFrame, q: str, thresholds: list[tuple[str, float]]) -> DataFrame:
    """A copy of each row for each threshold that its q-value meets; labels of equal thresholds stay apart."""
    grid = F.array(*[F.when(F.col(q) <= F.lit(float(t)), F.lit(label)) for label, t in thresholds])
    return df.withColumn("threshold", F.explode(F.filter(grid, lambda x: x.isNotNull())))
