"""Queries of the evidence linker over statement tables and texts printed from the facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as ops
from ..operators import factlines, linker
from ..sources import tables as src
from . import merge
from .facts_queries import FACTS_SQL, FILINGS_SQL, first

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: What annual reports print in tables, in this order; operating cash flow stands in the text only.
LABELS = ((src.REVENUE, "Total revenues"), (src.COST, "Cost of revenues"), (src.GROSS, "Gross profit"), (src.OPERATING, "Operating income"), (src.PPE, "Purchases of property and equipment"))
ALIASES = {src.REVENUE: ["total revenues", "revenues"], src.GROSS: ["gross profit"], src.PPE: ["purchases of property"], src.CASH_FLOW: ["net cash provided by operating activities"]}
WANTED = (src.REVENUE, src.GROSS, src.PPE, src.CASH_FLOW)
#: These are not tagged in annual reports here.
UNTAGGED = (src.GROSS, src.PPE, src.CASH_FLOW)


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return put


def _listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


_LABEL_SQL = ", ".join(f"({k}, '{c}', '{n}')" for k, (c, n) in enumerate(LABELS))
_ALIAS_SQL = ", ".join(f"('{c}', {i}, '{a}')" for c, names in ALIASES.items() for i, a in enumerate(names))

#: Printed rows: value of the year and of the year before, in thousands in even years.
PRINTED_SQL = (
    FACTS_SQL
    + f""", annual AS (SELECT entity, fiscal_year, concept, CAST(floor(value) AS BIGINT) AS v FROM facts WHERE fiscal_quarter IS NULL AND NOT is_instant),
pair AS (SELECT a.entity, a.fiscal_year AS fy, a.concept, a.v AS v1, b.v AS v2, CASE WHEN a.fiscal_year % 2 = 0 THEN 1000 ELSE 1 END AS unit FROM annual a LEFT JOIN annual b ON a.entity = b.entity AND a.concept = b.concept AND b.fiscal_year = a.fiscal_year - 1),
lab(k, concept, label) AS (VALUES {_LABEL_SQL}), al(concept, i, alias) AS (VALUES {_ALIAS_SQL}),
cell AS (SELECT p.*, k, label, CASE WHEN v1 < 0 THEN -1e0 ELSE 1e0 END * (abs(v1) // unit) AS n1, CASE WHEN v2 < 0 THEN -1e0 ELSE 1e0 END * (abs(v2) // unit) AS n2 FROM pair p LEFT JOIN lab USING (concept)),
store AS (SELECT entity, period_end, concept FROM facts WHERE NOT (fiscal_quarter IS NULL AND concept IN ({_listed(UNTAGGED)}))),
required AS (SELECT entity, last_day(make_date(y, m, 1)) AS period_end, concept FROM (SELECT DISTINCT entity FROM facts), (SELECT unnest(range(1993, 2000)) AS y), (SELECT unnest([3, 6, 9, 12]) AS m), (SELECT unnest([{_listed(WANTED)}]) AS concept)),
gone AS (SELECT * FROM required r WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.entity = r.entity AND s.period_end = r.period_end AND s.concept = r.concept)),
named AS (SELECT c.*, al.concept AS asked, al.alias FROM cell c JOIN al ON contains(lower(c.label), al.alias) WHERE c.label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c.entity, c.fy, c.k, al.concept ORDER BY al.i) = 1),
aimed AS (SELECT g.entity, g.period_end, g.concept, n.fy, n.k, n.alias, n.unit, CASE WHEN year(g.period_end) = fy THEN n1 WHEN year(g.period_end) = fy - 1 THEN coalesce(n2, n1) WHEN n2 IS NULL THEN n1 END AS raw_value,
  CASE WHEN year(g.period_end) = fy - 1 AND n2 IS NOT NULL THEN 2 ELSE 1 END AS column_index FROM gone g JOIN named n ON n.entity = g.entity AND n.asked = g.concept),
by_table AS (SELECT entity, period_end, concept, entity || '/' || fy AS table_id, k AS row_index, alias, unit AS scale, column_index, raw_value, raw_value * unit AS value FROM aimed WHERE raw_value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY entity, period_end, concept ORDER BY make_date(fy, 12, 31) <> period_end, fy, k) = 1),
by_text AS (SELECT g.entity, g.period_end, g.concept, c.entity || '/' || fy AS chunk_id, '{ALIASES[src.CASH_FLOW][0]}' AS alias, unit AS scale, year(g.period_end) = fy - 1 AS second,
  abs(CASE WHEN year(g.period_end) = fy THEN n1 ELSE coalesce(n2, 0e0) END) AS raw_value FROM gone g JOIN cell c ON c.entity = g.entity AND c.concept = g.concept AND year(g.period_end) IN (fy, fy - 1) WHERE g.concept = '{src.CASH_FLOW}'
  QUALIFY row_number() OVER (PARTITION BY g.entity, g.period_end, g.concept ORDER BY fy) = 1)
"""
)


def annual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, fiscal_year, concept, v1, v2: annual values and those of the year before, as whole numbers."""
    annual = first(spark, sf_dir).filter("fiscal_quarter IS NULL AND NOT is_instant").select("entity", "concept", "fiscal_year", F.floor("value").cast("bigint").alias("v"))
    before = annual.select("entity", "concept", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("v").alias("v2"))
    return annual.withColumnRenamed("v", "v1").join(before, ["entity", "concept", "fiscal_year"], "left")


def _printed(v: Column, unit: Column, none: str) -> Column:
    n = F.format_number(F.floor(F.abs(v) / unit).cast("bigint"), 0)
    return F.when(v.isNull(), F.lit(none)).when(v < 0, F.concat(F.lit("("), n, F.lit(")"))).otherwise(F.concat(F.lit("$ "), n))


def _unit() -> Column:
    return F.when(F.col("fiscal_year") % 2 == 0, 1000).otherwise(1)


def _caption(title: str) -> Column:
    return F.when(F.col("fiscal_year") % 2 == 0, f"{title} (in thousands)").otherwise(title)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement table for each annual report: two years side by side, a dash for what is unknown."""
    order = F.create_map(*[F.lit(x) for k, (c, _) in enumerate(LABELS) for x in (c, k)])
    label = F.create_map(*[F.lit(x) for p in LABELS for x in p])
    cells = F.array(label[F.col("concept")], _printed(F.col("v1"), _unit(), "–"), _printed(F.col("v2"), _unit(), "–"))
    rows = annual_pairs(spark, sf_dir).filter(F.col("concept").isin([c for c, _ in LABELS])).select("entity", "fiscal_year", F.struct(order[F.col("concept")].alias("k"), cells.alias("cells")).alias("row"))
    years = rows.groupBy("entity", "fiscal_year").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # five rows at most
    name = lambda y: F.concat(F.lit("FY"), y.cast("string"))
    return years.select(
        F.concat_ws("/", "entity", "fiscal_year").alias("table_id"), "entity", F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("period_end"), F.col("fiscal_year").alias("ord"),
        _caption("Consolidated statements").alias("caption"), F.array(name(F.col("fiscal_year")), name(F.col("fiscal_year") - 1)).alias("headers"), F.col("rows.cells").alias("rows"),
    )


def liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each annual report with operating cash flow of two years."""
    pair = annual_pairs(spark, sf_dir).filter(F.col("concept") == src.CASH_FLOW)
    line = F.concat_ws(" ", F.lit("Net cash provided by operating activities"), _printed(F.col("v1"), _unit(), "0"), _printed(F.col("v2"), _unit(), "0"))
    years = F.concat_ws(" ", F.lit("Years ended in December"), "fiscal_year", F.col("fiscal_year") - 1)
    return pair.select(F.concat_ws("/", "entity", "fiscal_year").alias("chunk_id"), "entity", F.col("fiscal_year").alias("ord"), F.concat_ws("\n", _caption("Liquidity"), F.lit(""), years, line).alias("text"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first(spark, sf_dir).filter(~(F.col("fiscal_quarter").isNull() & F.col("concept").isin(*UNTAGGED)))


def wanted(facts: DataFrame) -> DataFrame:
    """Every entity, quarter end of 1993-1999 and wanted concept."""
    grid = facts.select("entity").distinct().withColumn("y", F.explode(F.sequence(F.lit(1993), F.lit(1999)))).withColumn("m", F.explode(F.array(*[F.lit(m) for m in (3, 6, 9, 12)])))
    return grid.select("entity", F.last_day(F.make_date("y", "m", F.lit(1))).alias("period_end"), F.explode(F.array(*[F.lit(c) for c in WANTED])).alias("concept"))


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = store(spark, sf_dir)
    return ops.missing(wanted(facts), facts)


def _words(spark: SparkSession) -> DataFrame:
    return linker.vocabulary(spark, list(WANTED), ALIASES)


@query("link_table_fallback", PRINTED_SQL + "SELECT * FROM by_table")
def link_table_fallback(spark, sf_dir):
    return linker.table_fallback(_gone(spark, sf_dir), statements(spark, sf_dir), _words(spark))


@query("link_text_fallback", PRINTED_SQL + "SELECT entity, period_end, concept, chunk_id, 2 AS line_no, alias, scale, CAST(second AS INTEGER) AS column_index, raw_value, raw_value * scale AS value FROM by_text")
def link_text_fallback(spark, sf_dir):
    return linker.text_fallback(_gone(spark, sf_dir), liquidity(spark, sf_dir), _words(spark))


@query(
    "link_coverage",
    PRINTED_SQL
    + """, filled AS (SELECT entity, period_end, concept FROM store UNION ALL SELECT entity, period_end, concept FROM by_table UNION ALL SELECT entity, period_end, concept FROM by_text),
has AS (SELECT r.*, EXISTS (SELECT 1 FROM filled f WHERE f.entity = r.entity AND f.period_end = r.period_end AND f.concept = r.concept) AS ok FROM required r)
SELECT entity, period_end, count_if(ok)::BIGINT AS concept_count, coalesce(string_agg(CASE WHEN ok THEN concept END, ',' ORDER BY concept), '') AS matched_concepts, coalesce(string_agg(CASE WHEN NOT ok THEN concept END, ',' ORDER BY concept), '') AS missing_concepts,
  (SELECT count(*) FROM filled f WHERE f.entity = has.entity AND f.period_end = has.period_end) AS fact_count, bool_and(ok) AS has_required FROM has GROUP BY entity, period_end""",
)
def link_coverage(spark, sf_dir):
    facts = store(spark, sf_dir).select("entity", "period_end", "concept")
    required = wanted(facts)
    filled = linker.fill(ops.missing(required, facts), statements(spark, sf_dir), liquidity(spark, sf_dir), _words(spark))
    return linker.period_coverage(required, facts.unionByName(filled.select("entity", "period_end", "concept")))


_ASKED = ", q AS (SELECT item_id AS query_id, last_day(make_date(CAST(1993 + item_id % 5 AS BIGINT), CAST(12 - 3 * (item_id % 3) AS BIGINT), 1)) AS period_end FROM benchmark)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required period of each benchmark question."""
    item = F.col("item_id")
    day = F.last_day(F.make_date((1993 + item % 5).cast("int"), (12 - 3 * (item % 3)).cast("int"), F.lit(1)))
    return src.read_table(spark, sf_dir, "benchmark").select(item.alias("query_id"), day.alias("period_end"))


@query("link_facts", FACTS_SQL + _ASKED + f" SELECT query_id, f.entity, f.concept, f.period_end, CAST(value AS DOUBLE) AS result FROM q JOIN facts f USING (period_end) WHERE concept IN ({_listed(WANTED)})")
def link_facts(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    concepts = asked.select("query_id", F.explode(F.array(*[F.lit(c) for c in WANTED])).alias("concept"))
    return linker.linked_facts(asked, first(spark, sf_dir), concepts).select("query_id", "entity", "concept", "period_end", F.col("value").cast("double").alias("result"))


@query("link_tables", PRINTED_SQL + _ASKED + " SELECT DISTINCT query_id, c.entity || '/' || fy AS table_id, 0e0 AS score FROM q JOIN cell c ON make_date(fy, 12, 31) = q.period_end WHERE NOT (query_id % 2 = 0 AND c.entity = 'BUILDING')")
def link_tables(spark, sf_dir):
    """Every statement names a wanted concept; even questions have retrieved those of one entity already."""
    asked, tables = _asked(spark, sf_dir), statements(spark, sf_dir)
    concepts = asked.select("query_id", F.explode(F.array(*[F.lit(c) for c in WANTED])).alias("concept"))
    hits = asked.filter("query_id % 2 = 0").join(tables.filter("entity = 'BUILDING'").select("table_id", "period_end"), "period_end").select("query_id", "table_id")
    return linker.linked_tables(tables, asked, concepts, _words(spark), hits)


@query(
    "link_periods",
    FILINGS_SQL + "SELECT DISTINCT query_id, period_end FROM (SELECT item_id AS query_id, period_end FROM benchmark JOIN filings ON doc_id = item_id UNION ALL SELECT item_id, last_day(make_date(CAST(1993 + item_id % 5 AS BIGINT), CAST(12 - 3 * (item_id % 3) AS BIGINT), 1)) FROM benchmark)",
)
def link_periods(spark, sf_dir):
    """The document of a question's own id stands for what was retrieved."""
    hits = src.read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("doc_id"))
    return linker.relevant_periods(hits, src.filings(spark, sf_dir), _asked(spark, sf_dir))


@query(
    "narrative_gaps",
    FILINGS_SQL + ", q AS (SELECT item_id AS query_id, last_day(make_date(CAST(2021 + item_id % 5 AS BIGINT), CAST(12 - 3 * (item_id % 3) AS BIGINT), 1)) AS period_end FROM benchmark) SELECT query_id, period_end FROM q WHERE NOT EXISTS (SELECT 1 FROM filings f WHERE f.doc_id = q.query_id AND f.period_end = q.period_end) AND query_id % 7 <> 0",
)
def narrative_gaps(spark, sf_dir):
    """Required periods whose question has no document of that period; every seventh question is excused."""
    item = F.col("item_id")
    items = src.read_table(spark, sf_dir, "benchmark")
    need = items.select(item.alias("query_id"), F.last_day(F.make_date((2021 + item % 5).cast("int"), (12 - 3 * (item % 3)).cast("int"), F.lit(1))).alias("period_end"))
    filings = src.filings(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "period_end")
    return factlines.narrative_gaps(need, filings, need.filter("query_id % 7 = 0"))


@query("fact_lines", FACTS_SQL + " SELECT entity, concept, period_end, split_part(concept, ':', 2) || ' (FY' || year(period_end) || '): ' || format('{:,}', CAST(floor(arg_min(value, ord)) AS BIGINT)) || '.00 USD' AS line FROM facts WHERE month(period_end) = 12 GROUP BY entity, concept, period_end")
def fact_lines(spark, sf_dir):
    facts = first(spark, sf_dir).select("entity", "concept", "period_end", F.floor("value").cast("double").alias("value"), F.element_at(F.split("concept", ":"), -1).alias("label"), F.lit("USD").alias("unit"), "ord")
    ends = facts.select("period_end").filter(F.month("period_end") == 12)
    return factlines.fact_lines(facts, ["entity"], ends)


@query("facts_by_period", FACTS_SQL + " SELECT entity, period_end, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concepts FROM facts GROUP BY 1, 2")
def facts_by_period(spark, sf_dir):
    return factlines.concepts_by_period(first(spark, sf_dir), ["entity"]).withColumn("concepts", F.array_join("concepts", ","))


@query(
    "plan_merge_concepts",
    """WITH c AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['us-gaap:CostOfRevenue', 'us-gaap:CostOfRevenue'] WHEN 2 THEN ['us-gaap:GrossProfit'] ELSE ['us-gaap:Revenues', 'us-gaap:GrossProfit'] END AS r,
  CASE item_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['us-gaap:CostOfGoodsAndServicesSold'] ELSE ['us-gaap:Revenues'] END AS f, item_id % 2 = 1 AS composite FROM benchmark)
SELECT item_id, CASE WHEN item_id % 4 = 0 THEN array_to_string(f, ',') WHEN item_id % 3 = 0 THEN CASE item_id % 4 WHEN 1 THEN 'us-gaap:CostOfRevenue' WHEN 2 THEN 'us-gaap:GrossProfit' ELSE 'us-gaap:Revenues,us-gaap:GrossProfit' END
  WHEN composite AND NOT (item_id % 4 = 1 AND item_id % 3 = 1 OR item_id % 4 = 3 AND item_id % 3 = 2) THEN f[1]
  WHEN item_id % 4 = 3 AND item_id % 3 = 2 THEN 'us-gaap:Revenues,us-gaap:GrossProfit' WHEN item_id % 4 = 1 THEN f[1] || ',us-gaap:CostOfRevenue' WHEN item_id % 4 = 2 THEN f[1] || ',us-gaap:GrossProfit' ELSE f[1] || ',us-gaap:Revenues,us-gaap:GrossProfit' END AS concepts FROM c""",
)
def plan_merge_concepts(spark, sf_dir):
    """Each question with the concepts of a rule plan and of a proposal, dealt by its id."""
    n = F.col("item_id")

    def dealt(k: int, *lists: list[str]) -> Column:
        out = F.array().cast("array<string>")
        for i, names in enumerate(lists, 1):
            out = F.when(n % k == i, F.array(*[F.lit(x) for x in names])).otherwise(out)
        return out

    resolved = dealt(4, [linker.COST_OF_REVENUE] * 2, [src.GROSS], [src.REVENUE, src.GROSS])
    fallback = dealt(3, [linker.COST_OF_GOODS], [src.REVENUE])
    return src.read_table(spark, sf_dir, "benchmark").select("item_id", F.array_join(merge.required_concepts(resolved, fallback, n % 2 == 1), ",").alias("concepts"))
