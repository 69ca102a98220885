"""Evaluation artifacts: question files, run files, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION_SCHEMA = (
    "question_id string, question string, category string, difficulty string, expected_answer_contains array<string>, required_periods array<string>, required_concepts array<string>,"
    " expected_status string, expected_facts array<string>, expected_calc struct<operation:string,numerator:string,denominator:string,expected_value:double,tolerance:double>, expected_narrative_terms array<string>"
)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def has_assertions(questions: DataFrame) -> DataFrame:
    """Whether a question has anything for the structured judge."""
    some = [F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("required_periods", "required_concepts", "expected_facts", "expected_narrative_terms")]
    return questions.withColumn("has_assertions", some[0] | some[1] | some[2] | some[3] | F.col("expected_calc").isNotNull())


def save_run(results: DataFrame, summary: DataFrame, path: str, run_id: str) -> None:
    """Results and summary of a run below one folder."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{path}/{run_id}/results")
    summary.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").json(f"{path}/{run_id}/summary")


def accept_baseline(spark: SparkSession, path: str, run_id: str) -> None:
    spark.read.json(f"{path}/{run_id}/summary").write.mode("overwrite").json(f"{path}/baseline")


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/baseline")
