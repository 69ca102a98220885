"""Reciprocal rank fusion and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, FINAL_TOP, LEAST_PER_PERIOD = 60, 8, 3


def fuse(lexical: DataFrame, vector: DataFrame, key: list[str], k: int = RRF_K, top: int = FINAL_TOP) -> DataFrame:
    """key, chunk_id, fused, rank: union of two ranked lanes; ties favour the lexical lane.

    Both lanes are ranked lists already cut to their tops, so this shuffles a few rows per query.
    """
    lanes = lexical.select(*key, "chunk_id", "rank", F.lit(0).alias("lane")).unionByName(vector.select(*key, "chunk_id", "rank", F.lit(1).alias("lane")))
    scored = lanes.groupBy(*key, "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("fused"), F.min(F.struct("lane", "rank")).alias("first"))
    w = Window.partitionBy(*key).orderBy(F.col("fused").desc(), "first.lane", "first.rank", "chunk_id")
    return scored.withColumn("final_rank", F.row_number().over(w).cast("bigint")).filter(F.col("final_rank") <= top).select(*key, "chunk_id", "fused", "final_rank")


def per_period_top(n_periods: int) -> int:
    return max(FINAL_TOP // max(1, n_periods), LEAST_PER_PERIOD)


def first_period_wins(hits: DataFrame, key: str, period: str) -> DataFrame:
    """A chunk found for several periods stays with the first."""
    rest = [c for c in hits.columns if c not in (key, "chunk_id")]
    return hits.groupBy(key, "chunk_id").agg(F.min_by(F.struct(*rest), period).alias("h")).select(key, "chunk_id", "h.*")
