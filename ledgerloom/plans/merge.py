"""What a language model proposes, made to fit the rule-based plan: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.concepts import equivalent


def mentions(items: Column) -> Column:
    """Metric mentions of a proposal: trimmed, distinct in order, without empty ones and without dates."""
    is_date = lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(x, "yyyy-MM-dd").isNotNull()
    trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "") & ~is_date(x)))


def mentions_of_map(items: Column) -> Column:
    """The same of a mapping: each key, its underscores read as spaces, then its value."""
    return mentions(F.flatten(F.transform(F.map_entries(items), lambda e: F.array(F.replace(e["key"], F.lit("_"), F.lit(" ")), e["value"]))))


def supported(resolved: Column, fallback: Column) -> Column:
    """Whether any resolved concept is, or may stand in for, one of the rule plan's."""
    return F.exists(fallback, lambda f: F.exists(resolved, lambda r: (r == f) | F.coalesce(equivalent(f) == r, F.lit(False))))


def required_concepts(resolved: Column, fallback: Column, composite: Column) -> Column:
    """The rule plan's concepts followed by the resolved ones; a composite question keeps the rule plan's
    alone where nothing resolved supports them."""
    a, b = F.array_distinct(resolved), F.array_distinct(fallback)
    return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).when(composite & ~supported(a, b), b).otherwise(F.array_union(b, a))


def candidate_concepts(fallback: Column, candidates: Column) -> Column:
    """The rule plan's concepts, then each candidate of each resolution that is new."""
    return F.array_union(fallback, F.flatten(candidates))


def fast_path(concepts: Column, shape: Column) -> Column:
    """Whether the rule plan is enough: it names concepts and the answer is of one kind."""
    return (F.size(concepts) > 0) & (shape != "composite")
