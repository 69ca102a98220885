"""Facts as lines of an answer, concepts of each period, and periods without narrative evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fact_lines(facts: DataFrame, key: list[str], required: DataFrame | None = None) -> DataFrame:
    """facts (key, concept, period_end, value, label, unit, ord) as one line each, the first filed of a
    concept and period; with required periods (period_end) only those."""
    if required is not None:
        facts = facts.join(required.select("period_end").distinct(), "period_end", "left_semi")
    first = facts.groupBy(*key, "concept", "period_end").agg(F.min_by(F.struct("label", "value", "unit"), "ord").alias("f"))
    amount = F.concat_ws(" ", F.format_number(F.col("f.value"), 2), "f.unit")
    return first.select(*key, "concept", "period_end", F.concat(F.col("f.label"), F.lit(" (FY"), F.year("period_end"), F.lit("): "), amount).alias("line"))


def concepts_by_period(facts: DataFrame, key: list[str]) -> DataFrame:
    """The distinct concepts of each period; the set is bounded by the catalog of concepts."""
    return facts.groupBy(*key, "period_end").agg(F.sort_array(F.collect_set("concept")).alias("concepts"))


def narrative_gaps(required: DataFrame, sections: DataFrame, excluded: DataFrame) -> DataFrame:
    """query_id, period_end of required periods with no section evidence, but for the excluded ones."""
    key = ["query_id", "period_end"]
    return required.select(*key).distinct().join(sections.select(*key), key, "left_anti").join(excluded.select(*key), key, "left_anti")
