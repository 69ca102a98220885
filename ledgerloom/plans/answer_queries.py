"""Questions answered end to end over the fact model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers
from . import planner
from .facts_queries import FACTS_SQL, first

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

QUESTIONS = [
    (1, "What was total revenue in FY1996?"),
    (2, "How did revenue grow from FY1995 to FY1996?"),
    (3, "What was the gross margin in FY1997?"),
    (4, "What is the difference between gross profit in FY1996 and FY1997?"),
    (5, "Which year had the highest total revenue: FY1996, FY1997 or FY1998?"),
    (6, "What was the cost of revenue in FY1999?"),
    (7, "What was total revenue in FY2001?"),
    (8, "比较FY1996和FY1997的毛利率"),
]


def _parts(spark: SparkSession, sf_dir: str, questions: list[tuple[int, str]]):
    plans = planner.features(planner.plan_questions(spark.createDataFrame(questions, "question_id long, question string")))
    facts = first(spark, sf_dir).persist()  # read by every repair step; lost blocks are computed again
    rows = answers.needs(plans, facts.select("entity").distinct())
    return plans, answers.repair(rows, facts)


def answer(spark: SparkSession, sf_dir: str, questions: list[tuple[int, str]]) -> DataFrame:
    plans, (operands, _) = _parts(spark, sf_dir, questions)
    return answers.compose(plans, operands)


def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(spark, sf_dir, QUESTIONS).select("question_id", "entity", "intent", "result", "n_missing", "status")


def agent_repair_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, QUESTIONS)[1][1].select("question_id", "entity", F.col("iteration").cast("bigint").alias("iteration"), "action", "n_missing")


QUERIES |= {"answer_questions": answer_questions, "agent_repair_trace": agent_repair_trace}

_V = "(SELECT CAST(arg_min(value, ord) AS DOUBLE) FROM facts f WHERE f.entity = e.entity AND concept = '{c}' AND period_end = DATE '{y}-12-31')"
_REV, _GP, _COST = "us-gaap:Revenues", "us-gaap:GrossProfit", "us-gaap:CostOfRevenue"


def _v(concept: str, year: int) -> str:
    return _V.format(c=concept, y=year)


ORACLE["answer_questions"] = FACTS_SQL + ", e AS (SELECT DISTINCT entity FROM facts) " + " UNION ALL ".join(
    f"SELECT CAST({k} AS BIGINT) AS question_id, entity, '{intent}' AS intent, round({value}, 6) AS result, CAST({gone} AS BIGINT) AS n_missing, '{status}' AS status FROM e"
    for k, intent, value, gone, status in (
        (1, "lookup", _v(_REV, 1996), 0, "ok"),
        (2, "pct_change", f"({_v(_REV, 1996)} - {_v(_REV, 1995)}) / abs({_v(_REV, 1995)}) * 100", 0, "ok"),
        (3, "ratio", f"{_v(_GP, 1997)} / {_v(_REV, 1997)}", 0, "ok"),
        (4, "difference", f"{_v(_GP, 1997)} - {_v(_GP, 1996)}", 0, "ok"),
        (5, "rank", f"greatest({_v(_REV, 1996)}, {_v(_REV, 1997)}, {_v(_REV, 1998)})", 0, "ok"),
        (6, "lookup", _v(_COST, 1999), 0, "ok"),
        (7, "lookup", f"(SELECT CAST(arg_max(value, period_end) AS DOUBLE) FROM facts f WHERE f.entity = e.entity AND concept = '{_REV}' AND year(period_end) = 2001)", 0, "ok"),
        (8, "ratio", f"({_v(_GP, 1997)} / {_v(_REV, 1997)} - {_v(_GP, 1996)} / {_v(_REV, 1996)}) * 100", 0, "ok"),
    )
)
