"""Queries over a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import planner

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

QUESTIONS = [
    (1, "What was total revenue in Q3 2022?"),
    (2, "How did revenue grow from FY2022 to FY2023?"),
    (3, "Which quarter of 2023 had the highest operating margin: Q1 2023, Q2 2023 or Q3 2023?"),
    (4, "What was the gross margin in fiscal year 2023?"),
    (5, "Show step by step how to subtract capital expenditures from operating cash flow to get free cash flow for FY2022"),
    (6, "What risk factors about the supply chain are mentioned in the 2022 10-K, and how did cost of revenue change from 2021 to 2022?"),
    (7, "2022年第三季度的营业收入是多少？"),
    (8, "比较2022年和2023年的毛利率"),
    (9, "What is the difference between net income in 2021 and 2023?"),
    (10, "How did free cash flow trend from 2019 to 2023?"),
    (11, "Discuss the outlook and guidance of the company"),
    (12, "从2020到2022年净利润的趋势 compared with R&D"),
    (13, "As of 2023-06-30, what were cash and cash equivalents?"),
    (14, ""),
]
MENTIONS = ["Total Revenue", "gross profit margin", "operating_cash flow", "Net income's", "goodwill", "long term", "自由现金流", "research and development costs"]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id long, question string")


def planned(spark: SparkSession) -> DataFrame:
    return planner.features(planner.plan_questions(questions(spark)))


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


@query(
    "plan_language",
    f"""SELECT CAST(q AS BIGINT) AS question_id, CASE WHEN regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') AND regexp_matches(t, '[A-Za-z]') THEN 'mixed'
  WHEN regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'chinese' ELSE 'english' END AS language FROM (VALUES {values(QUESTIONS)}) v(q, t)""",
)
def plan_language(spark, sf_dir):
    return questions(spark).select("question_id", planner.language(F.col("question")).alias("language"))


@query("plan_periods")
def plan_periods(spark, sf_dir):
    return planned(spark).select("question_id", F.explode("periods").alias("period_end"))


@query("plan_metrics")
def plan_metrics(spark, sf_dir):
    return planned(spark).select("question_id", F.posexplode("required_concepts").alias("ordinal", "concept"))


@query("plan_intent")
def plan_intent(spark, sf_dir):
    return planned(spark).select("question_id", "query_type", "intent", "step_trace")


@query("plan_shape")
def plan_shape(spark, sf_dir):
    return planned(spark).select("question_id", "shape")


@query("plan_subqueries")
def plan_subqueries(spark, sf_dir):
    return planner.sub_queries(planned(spark))


@query("plan_keywords")
def plan_keywords(spark, sf_dir):
    return planned(spark).select("question_id", "search_text", F.array_join("keywords", " ").alias("keywords"))


@query("plan_period_semantics")
def plan_period_semantics(spark, sf_dir):
    return planned(spark).select("question_id", F.inline(F.arrays_zip("periods", "period_semantics"))).withColumnRenamed("periods", "period_end")


@query("plan_operands")
def plan_operands(spark, sf_dir):
    return planner.operands(planned(spark))


def alias_rows() -> list[tuple[str, str]]:
    return [(c, a) for c, names in planner.ALIASES.items() for a in names]


_NORM = "trim(regexp_replace(regexp_replace(replace(replace(lower({x}), '_', ' '), '''s', ''), '[^\\w\\x{{4e00}}-\\x{{9fff}}\\s:&-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "concept_resolve_cascade",
    f"""WITH m AS (SELECT mention, {_NORM.format(x='mention')} AS norm FROM (VALUES {values([(x,) for x in MENTIONS])}) v(mention)),
k AS (SELECT concept, {_NORM.format(x='a')} AS norm FROM (VALUES {values(alias_rows())}) v(concept, a)),
ex AS (SELECT mention, min(concept) AS exact_c FROM m JOIN k USING (norm) GROUP BY mention),
w AS (SELECT mention, len(list_distinct(string_split(norm, ' '))) AS n, unnest(list_distinct(string_split(norm, ' '))) AS w FROM m),
bw AS (SELECT DISTINCT concept, unnest(string_split(norm, ' ')) AS w FROM k),
o AS (SELECT mention, concept, count(*) * 1e0 / n AS score FROM w JOIN bw USING (w) GROUP BY mention, concept, n),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, concept) = 1)
SELECT m.mention, CASE WHEN exact_c IS NOT NULL THEN exact_c WHEN b.score >= 0.8e0 THEN b.concept END AS concept, CASE WHEN exact_c IS NOT NULL THEN 'exact' WHEN b.score >= 0.8e0 THEN 'lexical' ELSE 'unresolved' END AS method,
  round(CASE WHEN exact_c IS NOT NULL THEN 1e0 ELSE coalesce(b.score, 0e0) END, 6) AS score FROM m LEFT JOIN ex USING (mention) LEFT JOIN b ON m.mention = b.mention""",
)
def concept_resolve_cascade(spark, sf_dir):
    return planner.resolve_concepts(spark.createDataFrame([(x,) for x in MENTIONS], "mention string"), spark.createDataFrame(alias_rows(), "concept string, alias string"))
