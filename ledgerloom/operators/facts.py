"""Fact hygiene: first-wins, coverage, nearest periods, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("entity", "concept", "period_end", "is_instant", "period_start")


def first_wins(facts: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The fact filed first of each identity; one partial aggregation, no sort."""
    rest = [c for c in facts.columns if c not in key]
    return facts.groupBy(*key).agg(F.min_by(F.struct(*rest), "ord").alias("first")).select(*key, "first.*")


def keep_last(rows: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Upsert: the last write of each key stays, at its own place."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*key, "last.*")


def point_filter(facts: DataFrame, entity: str | None = None, concept: str | None = None, period_end: str | None = None) -> DataFrame:
    """Equality on whatever is given; the predicates reach the scan below."""
    for name, value in (("entity", entity), ("concept", concept), ("period_end", period_end)):
        if value is not None:
            facts = facts.filter(F.col(name) == F.lit(value).cast("date" if name == "period_end" else "string"))
    return facts


def concept_list(facts: DataFrame) -> DataFrame:
    return facts.select("concept").distinct()


def summarize(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("n_facts"),
        F.count_distinct("concept").alias("n_concepts"),
        F.count_distinct("period_end").alias("n_periods"),
        F.count_distinct("entity").alias("n_entities"),
    )


def coverage(required: DataFrame, facts: DataFrame) -> DataFrame:
    """required (entity, period_end, concept) against facts: counts per entity and period."""
    have = facts.select("entity", "period_end", "concept").distinct().withColumn("found", F.lit(1))
    return (
        required.join(have, ["entity", "period_end", "concept"], "left")
        .groupBy("entity", "period_end")
        .agg(
            F.count(F.lit(1)).alias("n_required"),
            F.count("found").alias("n_found"),
            F.array_join(F.sort_array(F.collect_list(F.when(F.col("found").isNull(), F.col("concept")))), ",").alias("missing"),
        )
    )


def missing(required: DataFrame, facts: DataFrame) -> DataFrame:
    return required.join(facts.select("entity", "period_end", "concept"), ["entity", "period_end", "concept"], "left_anti")


def nearest_same_year(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """For each wanted (entity, concept, period_end) the nearest period with a fact in its year.

    An equi-join on the year bounds the candidates; ties go to the earlier period.
    """
    have = facts.select("entity", "concept", F.col("period_end").alias("near"), F.year("period_end").alias("y")).distinct()
    both = wanted.withColumn("y", F.year("period_end")).join(have, ["entity", "concept", "y"], "left")
    return both.groupBy("entity", "concept", "period_end").agg(
        F.min_by("near", F.struct(F.abs(F.date_diff("near", "period_end")), "near")).alias("nearest")
    )


def scope(years: list[int], types: list[str], quarters: list[int]) -> Column:
    """Year and type must match; quarters only matter for quarterly reports."""
    return F.col("fiscal_year").isin(years) & F.col("filing_type").isin(types) & ((F.col("filing_type") != "10-Q") | F.col("fiscal_quarter").isin(quarters))


def trend_direction(series: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """up, down, stable or fluctuating, from neighbours in order."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    return (
        series.withColumn("step", step)
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n_periods"),
            F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True)).alias("rising"),
            F.coalesce(F.bool_and(F.col("step") <= 0), F.lit(True)).alias("falling"),
        )
        .select(
            *key,
            "n_periods",
            F.when(F.col("rising") & F.col("falling"), "stable").when(F.col("rising"), "up").when(F.col("falling"), "down").otherwise("fluctuating").alias("direction"),
        )
    )
