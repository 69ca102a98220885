"""Corpus storage, catalog, answers and run artifacts."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.concepts import catalog
from ledgerloom.operators import answers, runs
from ledgerloom.plans import planner
from ledgerloom.sources import corpus


def test_write_replace_and_read(spark, tmp_path):
    root = str(tmp_path / "c")
    first = spark.createDataFrame([(1, 2022, "a"), (2, 2022, "b"), (3, 2023, "c")], "doc_id long, fiscal_year int, text string")
    corpus.write(first, root, "chunks")
    corpus.replace_filings(spark.createDataFrame([(2, 2022, "new"), (2, 2022, "newer")], first.schema), root, "chunks")
    got = corpus.read(spark, root, ("chunks",))["chunks"].select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "new"), (2, "newer"), (3, "c")]
    with pytest.raises(corpus.CorpusError, match="facts is missing"):
        corpus.read(spark, root, ("facts",))
    assert corpus.read_state(spark, root).count() == 0
    other = str(tmp_path / "d")
    corpus.remove_filings(spark, first.filter("doc_id = 1"), root, "chunks", other)
    assert corpus.read(spark, other, ("chunks",))["chunks"].count() == 3


def test_fact_lines(spark, tmp_path):
    path = str(tmp_path / "f")
    facts = spark.createDataFrame([("e", "c", "l", 1.5, "USD", 1, None, date(2022, 12, 31), False, "d")], corpus.FACT_SCHEMA)
    corpus.write_facts_lines(facts, path)
    assert corpus.read_facts_lines(spark, path).collect() == facts.collect()


def test_index_check(spark):
    v = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "embedding array<double>")
    corpus.check_index(v, 2, 2)
    with pytest.raises(corpus.CorpusError):
        corpus.check_index(v, 3, 2)


def test_filing_keys(spark):
    df = spark.createDataFrame([(2023, None), (2023, 1)], "y int, q int")
    out = df.select(corpus.period_key(F.col("y"), F.col("q")), corpus.estimated_filing_date(F.col("y"), F.col("q")), corpus.stable_id(F.col("y"), F.col("q"))).collect()
    assert (out[0][0], out[0][1]) == ("FY2023", date(2024, 2, 1)) and (out[1][0], out[1][1]) == ("Q1-2023", date(2023, 4, 25)) and out[0][2] != out[1][2]


def test_catalog(spark):
    rows = spark.createDataFrame([("us-gaap:CostOfRevenue", "Cost of Revenue, Total & Other")], "concept string, label string")
    got = catalog(rows).first()
    assert got["aliases"][:2] == ["cost of revenue", "cost of revenues"] and "cost of revenue total & other" in got["aliases"]


def test_runs(spark, tmp_path):
    q = [{"question_id": "1", "question": "x", "expected_facts": ["a"], "expected_calc": None}, {"question_id": "2", "question": "y"}]
    (tmp_path / "q.json").write_text(json.dumps(q))
    loaded = runs.has_assertions(runs.load_questions(spark, str(tmp_path / "q.json")))
    assert {r["question_id"]: r["has_assertions"] for r in loaded.collect()} == {"1": True, "2": False}
    results = spark.createDataFrame([("1", "pass", 2.0)], "question_id string, outcome string, latency_ms double")
    from ledgerloom.operators.evaluation import run_summary

    runs.save_run(results, run_summary(results, []), str(tmp_path), "r1")
    runs.accept_baseline(spark, str(tmp_path), "r1")
    assert runs.load_baseline(spark, str(tmp_path)).first()["pass_rate"] == 1.0


def test_repair_swaps_then_relaxes(spark):
    plans = planner.features(planner.plan_questions(spark.createDataFrame([(1, "What was the cost of revenue in FY2022?"), (2, "What was total revenue in FY2023?")], "question_id long, question string")))
    facts = spark.createDataFrame([("e", "us-gaap:CostOfRevenue", date(2022, 12, 31), 5.0, 1), ("e", "us-gaap:Revenues", date(2023, 9, 30), 7.0, 2)], "entity string, concept string, period_end date, value double, ord long")
    operands, trace = answers.repair(answers.needs(plans, facts.select("entity").distinct()), facts)
    got = {r["question_id"]: (r["result"], r["status"]) for r in answers.compose(plans, operands).collect()}
    assert got == {1: (5.0, "ok"), 2: (7.0, "ok")}
    assert [r["n_missing"] for r in trace.filter("question_id = 1").orderBy("iteration").collect()] == [1, 0, 0]
    assert [r["n_missing"] for r in trace.filter("question_id = 2").orderBy("iteration").collect()] == [1, 1, 0]
