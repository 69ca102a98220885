"""Names of concepts as column expressions, and the concept catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spaced(local_name: Column) -> Column:
    """CamelCase as lower-case words."""
    return F.lower(F.regexp_replace(local_name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))


def aliases(local_name: Column, label: Column) -> Column:
    """Distinct ways to write a concept: its words, with and without a plural, and its label's variants."""
    words, low = spaced(local_name), F.lower(F.coalesce(label, F.lit("")))
    other = F.when(words.endswith("s"), F.expr("null")).otherwise(F.concat(words, F.lit("s")))
    single = F.when(words.endswith("s"), F.regexp_replace(words, "s$", ""))
    made = F.array(words, other, single, low, F.regexp_replace(low, ",", ""), F.regexp_replace(low, "&", "and"), F.regexp_replace(low, r"\band\b", "&"))
    return F.array_distinct(F.filter(F.transform(made, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.isNotNull() & (x != "")))


def catalog(facts: DataFrame) -> DataFrame:
    """concept, label, aliases, embedding_text of every concept of flattened company facts."""
    one = facts.groupBy("concept").agg(F.min("label").alias("label"))
    local = F.element_at(F.split("concept", ":"), -1)
    named = one.withColumn("aliases", aliases(local, F.col("label")))
    return named.withColumn("embedding_text", F.concat_ws(" | ", "concept", "label", F.array_join("aliases", " | ")))


#: Concepts that stand for each other.
EQUIVALENT = {
    "us-gaap:CostOfGoodsAndServicesSold": "us-gaap:CostOfRevenue",
    "us-gaap:NetCashProvidedByUsedInOperatingActivities": "us-gaap:NetCashProvidedByOperatingActivities",
    "custom:CapitalExpenditure": "us-gaap:PaymentsToAcquirePropertyPlantAndEquipment",
}


def equivalent(concept: Column) -> Column:
    """The concept that may stand in, else null."""
    pairs = [(a, b) for x, y in EQUIVALENT.items() for a, b in ((x, y), (y, x))]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])[concept]
