"""Ranking, fusion and bounds: the total order is score descending, then id ascending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
RRF_K, DEPTH = 60.0, 100
TOOLS_K, SKILLS_K, FACTS_K, MOST_K = 5, 3, 3, 50


def clamp_k(k: object, default: int, most: int | None = MOST_K) -> int:
    """A result count as asked for, or the default if it isn't a whole number of at least 1."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        return default
    return k if most is None else min(k, most)


def clamp_k_column(k: Column, default: int, most: int = MOST_K) -> Column:
    return F.when(k.isNull() | (k < 1), F.lit(default)).otherwise(F.least(k, F.lit(most)))


def depth(k: int) -> int:
    return max(DEPTH, k)


def ranked(hits: DataFrame, by: list[str], score: str = "score", entry: str = "id") -> DataFrame:
    """hits with rank, from 0, in each group; scores that are no numbers are left out, not ranked."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(entry).asc())
    sound = hits.where(F.col(score).isNotNull() & ~F.isnan(score))
    return sound.withColumn("rank", F.row_number().over(order) - 1)


def top(hits: DataFrame, by: list[str], k: int | Column, score: str = "score", entry: str = "id") -> DataFrame:
    """The k best of each group, with their ranks."""
    return ranked(hits, by, score, entry).where(F.col("rank") < k)


def fuse(arms: list[tuple[DataFrame, float | Column]], by: list[str], entry: str = "id") -> DataFrame:
    """Weighted reciprocal rank fusion of ranked arms: sum of weight / (60 + rank), rank from 0. An arm of weight 0 still lists its ids."""
    parts = [arm.select(*by, entry, ((w if isinstance(w, Column) else F.lit(float(w))) / (F.lit(RRF_K) + F.col("rank"))).alias("_part")) for arm, w in arms]
    return reduce(DataFrame.unionByName, parts).groupBy(*by, entry).agg(F.sum("_part").alias("score"))


def rrf(arms: list[tuple[DataFrame, float | Column]], by: list[str], k: int, entry: str = "id") -> DataFrame:
    return top(fuse(arms, by, entry).withColumn("score", F.round("score", 9)), by, k, entry=entry).withColumn("fused", F.lit(True))
