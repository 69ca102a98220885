"""Judging answers and summarising runs; agent traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"-?[\d,]+\.?\d*"


def legacy_check(status_ok: Column, text: Column, keywords: Column, has_citations: Column) -> Column:
    """Every keyword occurs in the answer; without keywords, there must be citations."""
    low = F.lower(text)
    return status_ok & F.when(F.size(keywords) == 0, has_citations).otherwise(F.forall(keywords, lambda k: low.contains(F.lower(k))))


def numbers_in(text: Column) -> Column:
    """All numbers of a text, commas dropped; what is no number is left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    return F.filter(found, lambda x: x.isNotNull())


def closest_error(numbers: Column, expected: Column) -> Column:
    """Relative error of the best candidate."""
    return F.array_min(F.transform(numbers, lambda x: F.abs(x - expected) / F.greatest(F.abs(expected), F.lit(1e-9))))


def structured_check(expected_periods: Column, got_periods: Column, error: Column, tolerance: Column, expected_op: Column, got_op: Column) -> Column:
    """All configured assertions hold: periods covered, value within tolerance, operation compatible."""
    covered = F.size(F.array_except(expected_periods, got_periods)) == 0
    value = error.isNotNull() & (error <= tolerance)
    op = (expected_op == got_op) | ((expected_op == "lookup") & (got_op == "step_trace"))
    return covered & value & op


def run_summary(results: DataFrame, key: list[str]) -> DataFrame:
    """results (.., outcome in pass/fail/error, latency_ms); errors count with latency 0."""
    latency = F.when(F.col("outcome") == "error", F.lit(0.0)).otherwise(F.col("latency_ms"))
    grouped = results.groupBy(*key) if key else results.groupBy()
    counts = [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("pass", "fail", "error")]
    return grouped.agg(F.count(F.lit(1)).alias("total"), *counts, F.round(F.avg(latency), 2).alias("avg_latency_ms"), F.round(F.count_if(F.col("outcome") == "pass") / F.count(F.lit(1)), 4).alias("pass_rate"))


def report(results: DataFrame, a: str, b: str) -> DataFrame:
    """Pass rates by both, by the first and in all."""
    return results.rollup(a, b).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "pass").alias("n_pass"), F.round(F.count_if(F.col("outcome") == "pass") / F.count(F.lit(1)), 4).alias("pass_rate"))


def trace_summary(turns: DataFrame, trace: str, order: str, action: str) -> DataFrame:
    """Iterations, actions in order and whether any action repeats its forerunner (no progress)."""
    acts = F.transform(F.sort_array(F.collect_list(F.struct(order, action))), lambda x: x[action])  # a trace's turns: a few
    out = turns.groupBy(trace).agg(F.count(F.lit(1)).alias("iterations"), acts.alias("acts"))
    return out.select(trace, "iterations", F.array_join("acts", ",").alias("actions"), F.exists(F.transform("acts", lambda x, i: (i > 0) & (x == F.get("acts", i - 1))), lambda x: x).alias("no_progress"))


def next_action(candidates: DataFrame, attempted: DataFrame, trace: str) -> DataFrame:
    """The untried action of least priority number: candidates (trace, action, priority)."""
    left = candidates.join(attempted.select(trace, "action").distinct(), [trace, "action"], "left_anti")
    return left.groupBy(trace).agg(F.min_by("action", F.struct("priority", "action")).alias("action"))
