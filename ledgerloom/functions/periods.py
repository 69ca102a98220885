"""Period semantics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANNUAL, QUARTERLY, DERIVED, INSTANT, UNKNOWN = "annual_cumulative", "quarterly_standalone", "derived_standalone", "instant", "unknown"
SEMANTICS = (ANNUAL, QUARTERLY, DERIVED, INSTANT, UNKNOWN)


def classify_period(is_instant: Column, period_start: Column, period_end: Column) -> Column:
    """What a fact's period means, from its end and (for year ends) its start."""
    month = F.month(period_end)
    fourth = (F.month(period_start) == 10) & (F.dayofmonth(period_start) == 1)
    return (
        F.when(is_instant, INSTANT)
        .when((month == 12) & (F.dayofmonth(period_end) == 31), F.when(fourth, DERIVED).otherwise(ANNUAL))
        .when(month.isin(3, 6, 9, 12), QUARTERLY)
        .otherwise(UNKNOWN)
    )


def compatible(a: Column, b: Column) -> Column:
    """Whether two meanings may be compared: unknown with nothing, derived with quarterly."""
    known = (a != UNKNOWN) & (b != UNKNOWN)
    mixed = a.isin(QUARTERLY, DERIVED) & b.isin(QUARTERLY, DERIVED)
    return known & ((a == b) | mixed)


def compatibility_matrix(spark: SparkSession) -> DataFrame:
    """Every pair of meanings with its verdict."""
    kinds = spark.createDataFrame([(s,) for s in SEMANTICS], "a string")
    return kinds.crossJoin(F.broadcast(kinds.withColumnRenamed("a", "b"))).select("a", "b", compatible(F.col("a"), F.col("b")).alias("compatible"))


def period_label(fiscal_year: Column, fiscal_quarter: Column) -> Column:
    """FY1996 or Q1-1996."""
    return F.when(fiscal_quarter.isNull(), F.concat(F.lit("FY"), fiscal_year)).otherwise(F.concat(F.lit("Q"), fiscal_quarter, F.lit("-"), fiscal_year))
