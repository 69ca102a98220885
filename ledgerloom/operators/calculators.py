"""Financial calculators over first-wins facts (entity, concept, period_end, value, ord ...).

Missing operands give 0.0, as answers expect; the ``status`` columns tell it from a real zero.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import CASH_FLOW, PPE


def number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def annual(facts: DataFrame) -> DataFrame:
    return facts.filter("fiscal_quarter IS NULL AND NOT is_instant")


def aggregate_concept(facts: DataFrame, operation: str) -> DataFrame:
    """sum, avg, max or min of each entity's concept; avg divides the exact sum."""
    value = {
        "sum": number(F.sum("value")),
        "avg": number(F.sum("value")) / F.count("value"),
        "max": number(F.max("value")),
        "min": number(F.min("value")),
    }[operation]
    return facts.groupBy("entity", "concept").agg(value.alias("result"), F.count("value").alias("n_facts"))


def extreme_period(facts: DataFrame, largest: bool) -> DataFrame:
    """The period of the largest (smallest) value, the first filed on ties."""
    if largest:
        at = F.max_by(F.struct("period_end", "value"), F.struct("value", -F.col("ord")))
    else:
        at = F.min_by(F.struct("period_end", "value"), F.struct("value", "ord"))
    return facts.groupBy("entity", "concept").agg(at.alias("at")).select("entity", "concept", F.col("at.period_end").alias("period_end"), number("at.value").alias("result"))


def at_period(facts: DataFrame, concept: str | None, period: str) -> Column:
    """The first filed value at a period, as an aggregate."""
    hit = F.col("period_end") == F.lit(period).cast("date")
    if concept:
        hit = hit & (F.col("concept") == concept)
    return F.min_by(F.when(hit, F.col("value")), F.when(hit, F.col("ord")))


def period_over_period(facts: DataFrame, before: str, after: str, percent: bool = False) -> DataFrame:
    """after - before for every entity and concept; percent divides by abs(before)."""
    both = facts.groupBy("entity", "concept").agg(at_period(facts, None, before).alias("a"), at_period(facts, None, after).alias("b"))
    a, b = number("a"), number("b")
    change = F.try_divide(b - a, F.abs(a)) * 100 if percent else b - a
    return both.select(
        "entity", "concept", F.round(F.coalesce(change, F.lit(0.0)), 6).alias("result"), F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").otherwise("ok").alias("status")
    )


def yoy(facts: DataFrame) -> DataFrame:
    """Percent change of each annual value on the year before, by one window."""
    w = Window.partitionBy("entity", "concept").orderBy("fiscal_year")
    last, year = F.lag("value").over(w), F.lag("fiscal_year").over(w)
    return (
        annual(facts)
        .withColumn("last", last)
        .withColumn("last_year", year)
        .filter(F.col("last_year") == F.col("fiscal_year") - 1)
        .select("entity", "concept", F.col("fiscal_year").cast("bigint").alias("fiscal_year"), F.round(F.try_divide(number("value") - number("last"), F.abs(number("last"))) * 100, 6).alias("pct_change"))
    )


def pivot_concepts(facts: DataFrame, concepts: dict[str, str], key: list[str]) -> DataFrame:
    """One column for each named concept: a conditional aggregation instead of self-joins."""
    wanted = facts.filter(F.col("concept").isin(list(concepts)))
    return wanted.groupBy(*key).agg(*[F.min_by(F.when(F.col("concept") == c, F.col("value")), F.when(F.col("concept") == c, F.col("ord"))).alias(n) for c, n in concepts.items()])


def ratio(facts: DataFrame, numerator: str, denominator: str) -> DataFrame:
    both = pivot_concepts(facts, {numerator: "num", denominator: "den"}, ["entity", "period_end"])
    return both.select("entity", "period_end", F.round(F.coalesce(F.try_divide(number("num"), number("den")), F.lit(0.0)), 6).alias("ratio"))


def ratio_delta(facts: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """Last minus first annual ratio, in percentage points."""
    r = ratio(annual(facts), numerator, denominator)
    return r.groupBy("entity").agg(
        F.min("period_end").alias("first_period"), F.max("period_end").alias("last_period"), F.round((F.max_by("ratio", "period_end") - F.min_by("ratio", "period_end")) * 100, 4).alias("delta_pp")
    )


def rank_values(rows: DataFrame, key: list[str], value: Column, tie: Column, descending: bool = True) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(value.desc() if descending else value.asc(), tie)
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint"))


def derive_fourth_quarter(facts: DataFrame) -> DataFrame:
    """Year less its three reported quarters, only if all four are there."""
    q, v = F.col("fiscal_quarter"), F.col("value")
    return (
        facts.filter("NOT is_instant")
        .groupBy("entity", "concept", "fiscal_year")
        .agg(F.max(F.when(q.isNull(), v)).alias("fy"), F.sum(F.when(q.between(1, 3), v)).alias("quarters"), F.count_distinct(F.when(q.between(1, 3), q)).alias("n"))
        .filter("fy IS NOT NULL AND n = 3")
        .select("entity", "concept", F.col("fiscal_year").cast("bigint").alias("fiscal_year"), number(F.col("fy") - F.col("quarters")).alias("q4_value"))
    )


def free_cash_flow(raw: DataFrame) -> DataFrame:
    """Operating cash flow less capital expenditure (abs of the payments), joined null-safely."""
    key = ["entity", "period_start", "period_end", "is_instant"]

    def side(concept: str, name: str) -> DataFrame:
        return raw.filter(F.col("concept") == concept).groupBy(*key).agg(F.min_by("value", "ord").alias(name))

    flow, ppe = side(CASH_FLOW, "ocf"), side(PPE, "payments").select(*[F.col(k).alias(f"r_{k}") for k in key], "payments")
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key]
    return flow.join(ppe, on).select("entity", "period_end", number("ocf").alias("ocf"), number(F.abs("payments")).alias("capex"), number(F.col("ocf") - F.abs("payments")).alias("fcf"))


_CALL = re.compile(r"^\s*(sum|avg|max|min|change|pct_change|ratio)\s*\(([^)]*)\)\s*$", re.I)
_PAIR = re.compile(r"^\s*(\S+)\s+([/-])\s+(\S+)\s*$")
_DAY = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def calculate(expression: str, facts: DataFrame) -> DataFrame:
    """The expression language: one (entity, result, trace) row for each entity.

    sum(c) avg(c) max(c) min(c) change(c, p1, p2) pct_change(c, p1, p2) ratio(a, b[, period])
    ``a / b`` ``a - b`` or a bare concept (its first value). Too few arguments or bad dates give 0.0.
    """

    def first(concept: str, period: str | None = None) -> Column:
        hit = F.col("concept") == concept
        if period:
            hit = hit & (F.col("period_end") == F.lit(period).cast("date"))
        return number(F.min_by(F.when(hit, F.col("value")), F.when(hit, F.col("ord"))))

    def row(value: Column, trace: str) -> DataFrame:
        return facts.groupBy("entity").agg(F.coalesce(value, F.lit(0.0)).alias("result")).withColumn("trace", F.lit(trace))

    call, pair = _CALL.match(expression), _PAIR.match(expression)
    if call:
        name, args = call[1].lower(), [a.strip() for a in call[2].split(",") if a.strip()]
        if name in ("sum", "avg", "max", "min") and args:
            v = F.when(F.col("concept") == args[0], F.col("value"))
            made = {"sum": number(F.sum(v)), "avg": number(F.sum(v)) / F.nullif(F.count(v), F.lit(0)), "max": number(F.max(v)), "min": number(F.min(v))}[name]
            return row(made, f"{name}({args[0]})")
        if name in ("change", "pct_change"):
            if len(args) < 3 or not all(_DAY.match(a) for a in args[1:3]):
                return row(F.max(F.lit(0.0)), "expected concept, period, period")
            a, b = first(args[0], args[1]), first(args[0], args[2])
            return row(F.try_divide(b - a, F.abs(a)) * 100 if name == "pct_change" else b - a, f"{name}({args[0]}: {args[1]} -> {args[2]})")
        if name == "ratio" and len(args) >= 2:
            period = args[2] if len(args) > 2 and _DAY.match(args[2]) else None
            return row(F.try_divide(first(args[0], period), first(args[1], period)), f"{args[0]} / {args[1]}")
        return row(F.max(F.lit(0.0)), "too few arguments")
    if pair:
        a, b = first(pair[1]), first(pair[3])
        return row(F.try_divide(a, b) if pair[2] == "/" else a - b, expression.strip())
    return row(first(expression.strip()), expression.strip())
