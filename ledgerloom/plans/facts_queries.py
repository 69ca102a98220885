"""Queries over facts: calculators and fact hygiene, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import classify_period, compatibility_matrix, period_label
from ..operators import calculators as calc
from ..operators import facts as ops
from ..sources import tables as src

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The fact model for DuckDB; continue with further CTEs or a SELECT.
FACTS_SQL = """
WITH lines AS (
  SELECT c.c_mktsegment AS entity, year(o.o_orderdate) AS fiscal_year, quarter(o.o_orderdate) AS q, l.l_returnflag AS rf,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_tax AS DECIMAL(4,2)) AS tax
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey),
wide AS (
  SELECT entity, fiscal_year, q, CAST(sum(price - price * disc) AS DECIMAL(28,4)) AS revenue, CAST(sum(price * disc) AS DECIMAL(28,4)) AS cost,
         CAST(sum(price - price * disc) - sum(price * disc) AS DECIMAL(28,4)) AS gross,
         CAST(sum(CASE WHEN rf = 'N' THEN price - price * disc ELSE 0 END) AS DECIMAL(28,4)) AS operating,
         CAST(sum(CASE WHEN rf <> 'R' THEN price - price * disc ELSE 0 END) AS DECIMAL(28,4)) AS cash_flow,
         CAST(-sum(price * tax) AS DECIMAL(28,4)) AS ppe, CAST(sum(price * tax) AS DECIMAL(28,4)) AS cash
  FROM lines GROUP BY ALL),
reports AS (
  SELECT entity, fiscal_year, q, revenue, cost, gross, operating, cash_flow, ppe, cash FROM wide WHERE q <= 3
  UNION ALL
  SELECT entity, fiscal_year, NULL, sum(revenue), sum(cost), sum(gross), sum(operating), sum(cash_flow), sum(ppe), sum(CASE WHEN q = 4 THEN cash END)
  FROM wide GROUP BY entity, fiscal_year HAVING count(*) = 4),
dated AS (SELECT *, last_day(make_date(fiscal_year, coalesce(q, 4) * 3, 1)) AS period_end,
  CASE WHEN q IS NULL THEN make_date(fiscal_year, 1, 1) ELSE make_date(fiscal_year, q * 3 - 2, 1) END AS begin_day FROM reports),
filed AS (
  SELECT entity, u.concept, fiscal_year, q AS fiscal_quarter, u.k = 6 AS is_instant, u.v AS value,
         CASE WHEN u.k <> 6 THEN begin_day END AS period_start, period_end, (fiscal_year * 10 + coalesce(q, 4)) * 10 + u.k AS ord
  FROM (SELECT *, unnest([
    {'k': 0, 'concept': 'us-gaap:Revenues', 'v': revenue}, {'k': 1, 'concept': 'us-gaap:CostOfRevenue', 'v': cost},
    {'k': 2, 'concept': 'us-gaap:GrossProfit', 'v': gross}, {'k': 3, 'concept': 'us-gaap:OperatingIncomeLoss', 'v': operating},
    {'k': 4, 'concept': 'us-gaap:NetCashProvidedByOperatingActivities', 'v': cash_flow},
    {'k': 5, 'concept': 'us-gaap:PaymentsToAcquirePropertyPlantAndEquipment', 'v': ppe},
    {'k': 6, 'concept': 'us-gaap:CashAndCashEquivalentsAtCarryingValue', 'v': cash}]) AS u FROM dated)),
raw AS (SELECT * FROM filed UNION ALL
  SELECT entity, concept, fiscal_year, fiscal_quarter, is_instant, CAST(CAST(value * 101 AS DECIMAL(32,4)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(28,4)), period_start, period_end, ord + 100
  FROM filed WHERE concept = 'us-gaap:Revenues' AND fiscal_quarter IS NULL),
facts AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY entity, concept, period_end, is_instant, period_start ORDER BY ord) = 1)
"""


def query(name: str, sql: str | None = None, facts: bool = True):
    """Register a query; its SQL follows the fact model unless ``facts`` is false."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = (FACTS_SQL if facts else "") + sql
        return f

    return put


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.raw_facts(spark, sf_dir)


def first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_wins(raw(spark, sf_dir))


for _op, _sql in {"sum": "CAST(sum(value) AS DOUBLE)", "avg": "CAST(sum(value) AS DOUBLE) / count(value)", "max": "CAST(max(value) AS DOUBLE)", "min": "CAST(min(value) AS DOUBLE)"}.items():

    @query(f"calc_{_op}_concept", f"SELECT entity, concept, {_sql} AS result, count(value) AS n_facts FROM facts GROUP BY ALL")
    def _aggregate(spark, sf_dir, op=_op):
        return calc.aggregate_concept(first(spark, sf_dir), op)


for _name, _order in {"argmax": "value DESC, ord", "argmin": "value, ord"}.items():

    @query(
        f"calc_{_name}_period",
        f"SELECT entity, concept, period_end, CAST(value AS DOUBLE) AS result FROM facts QUALIFY row_number() OVER (PARTITION BY entity, concept ORDER BY {_order}) = 1",
    )
    def _extreme(spark, sf_dir, largest=_name == "argmax"):
        return calc.extreme_period(first(spark, sf_dir), largest)


_PAIR_SQL = """, pair AS (SELECT entity, concept, CAST(arg_min(CASE WHEN period_end = DATE '{a}' THEN value END, CASE WHEN period_end = DATE '{a}' THEN ord END) AS DOUBLE) AS a,
  CAST(arg_min(CASE WHEN period_end = DATE '{b}' THEN value END, CASE WHEN period_end = DATE '{b}' THEN ord END) AS DOUBLE) AS b FROM facts GROUP BY ALL)
SELECT entity, concept, round(coalesce({e}, 0e0), 6) AS result, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' ELSE 'ok' END AS status FROM pair"""


@query("calc_change", _PAIR_SQL.format(a="1995-12-31", b="1996-12-31", e="b - a"))
def calc_change(spark, sf_dir):
    return calc.period_over_period(first(spark, sf_dir), "1995-12-31", "1996-12-31")


@query("calc_pct_change", _PAIR_SQL.format(a="1995-12-31", b="1996-12-31", e="(b - a) / nullif(abs(a), 0) * 100"))
def calc_pct_change(spark, sf_dir):
    return calc.period_over_period(first(spark, sf_dir), "1995-12-31", "1996-12-31", percent=True)


@query("calc_difference", _PAIR_SQL.format(a="2000-12-31", b="2001-12-31", e="b - a"))
def calc_difference(spark, sf_dir):
    """2001 has no annual report: the missing operand gives 0.0 with its status."""
    return calc.period_over_period(first(spark, sf_dir), "2000-12-31", "2001-12-31")


@query(
    "calc_yoy_all_years",
    """, y AS (SELECT entity, concept, fiscal_year, CAST(value AS DOUBLE) AS v, CAST(lag(value) OVER w AS DOUBLE) AS p, lag(fiscal_year) OVER w AS py FROM facts
  WHERE fiscal_quarter IS NULL AND NOT is_instant WINDOW w AS (PARTITION BY entity, concept ORDER BY fiscal_year))
SELECT entity, concept, CAST(fiscal_year AS BIGINT) AS fiscal_year, round((v - p) / nullif(abs(p), 0) * 100, 6) AS pct_change FROM y WHERE py = fiscal_year - 1""",
)
def calc_yoy_all_years(spark, sf_dir):
    return calc.yoy(first(spark, sf_dir))


_RATIO_SQL = """, pv AS (SELECT entity, period_end, CAST(arg_min(CASE WHEN concept = '{n}' THEN value END, CASE WHEN concept = '{n}' THEN ord END) AS DOUBLE) AS num,
  CAST(arg_min(CASE WHEN concept = 'us-gaap:Revenues' THEN value END, CASE WHEN concept = 'us-gaap:Revenues' THEN ord END) AS DOUBLE) AS den
  FROM facts WHERE concept IN ('{n}', 'us-gaap:Revenues') {w} GROUP BY ALL),
r AS (SELECT entity, period_end, round(coalesce(num / nullif(den, 0), 0e0), 6) AS ratio FROM pv)
"""


@query("calc_ratio_margin", _RATIO_SQL.format(n="us-gaap:GrossProfit", w="") + "SELECT * FROM r")
def calc_ratio_margin(spark, sf_dir):
    return calc.ratio(first(spark, sf_dir), src.GROSS, src.REVENUE)


@query(
    "calc_ratio_pp_delta",
    _RATIO_SQL.format(n="us-gaap:OperatingIncomeLoss", w="AND fiscal_quarter IS NULL AND NOT is_instant")
    + "SELECT entity, min(period_end) AS first_period, max(period_end) AS last_period, round((arg_max(ratio, period_end) - arg_min(ratio, period_end)) * 100, 4) AS delta_pp FROM r GROUP BY entity",
)
def calc_ratio_pp_delta(spark, sf_dir):
    return calc.ratio_delta(first(spark, sf_dir), src.OPERATING, src.REVENUE)


@query("calc_rank_periods", "SELECT entity, concept, period_end, ord, CAST(value AS DOUBLE) AS result, row_number() OVER (PARTITION BY entity, concept ORDER BY value DESC, ord) AS rank FROM facts")
def calc_rank_periods(spark, sf_dir):
    ranked = calc.rank_values(first(spark, sf_dir), ["entity", "concept"], F.col("value"), F.col("ord"))
    return ranked.select("entity", "concept", "period_end", "ord", calc.number("value").alias("result"), "rank")


@query("calc_rank_margin", _RATIO_SQL.format(n="us-gaap:OperatingIncomeLoss", w="") + "SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ratio DESC, period_end) AS rank FROM r")
def calc_rank_margin(spark, sf_dir):
    return calc.rank_values(calc.ratio(first(spark, sf_dir), src.OPERATING, src.REVENUE), ["entity"], F.col("ratio"), F.col("period_end"))


_Q4_SQL = """, q4 AS (SELECT entity, concept, fiscal_year, max(CASE WHEN fiscal_quarter IS NULL THEN value END) AS fy, sum(CASE WHEN fiscal_quarter BETWEEN 1 AND 3 THEN value END) AS qs,
  count(DISTINCT CASE WHEN fiscal_quarter BETWEEN 1 AND 3 THEN fiscal_quarter END) AS n FROM facts WHERE NOT is_instant GROUP BY ALL)
SELECT entity, concept, CAST(fiscal_year AS BIGINT) AS fiscal_year, CAST(fy - qs AS DOUBLE) AS q4_value FROM q4 WHERE fy IS NOT NULL AND n = 3"""


@query("calc_q4_derived", _Q4_SQL)
def calc_q4_derived(spark, sf_dir):
    return calc.derive_fourth_quarter(first(spark, sf_dir))


_FCF_SQL = """, ocf AS (SELECT entity, period_start, period_end, is_instant, arg_min(value, ord) AS ocf FROM raw WHERE concept = 'us-gaap:NetCashProvidedByOperatingActivities' GROUP BY ALL),
ppe AS (SELECT entity, period_start, period_end, is_instant, arg_min(value, ord) AS pay FROM raw WHERE concept = 'us-gaap:PaymentsToAcquirePropertyPlantAndEquipment' GROUP BY ALL),
fcf AS (SELECT o.entity, o.period_end, o.ocf, abs(p.pay) AS capex, o.ocf - abs(p.pay) AS fcf FROM ocf o JOIN ppe p
  ON o.entity = p.entity AND o.period_end = p.period_end AND o.is_instant = p.is_instant AND o.period_start IS NOT DISTINCT FROM p.period_start)
"""


@query("calc_fcf", _FCF_SQL + "SELECT entity, period_end, CAST(ocf AS DOUBLE) AS ocf, CAST(capex AS DOUBLE) AS capex, CAST(fcf AS DOUBLE) AS fcf FROM fcf")
def calc_fcf(spark, sf_dir):
    return calc.free_cash_flow(raw(spark, sf_dir))


@query(
    "calc_fcf_step_trace",
    _FCF_SQL
    + """SELECT entity, period_end, CAST(ocf AS DOUBLE) AS minuend, CAST(capex AS DOUBLE) AS subtrahend, CAST(fcf AS DOUBLE) AS grounded,
  abs(CAST(ocf AS DOUBLE) - CAST(capex AS DOUBLE) - CAST(fcf AS DOUBLE)) < 1e-6 AS consistent FROM fcf""",
)
def calc_fcf_step_trace(spark, sf_dir):
    fcf = calc.free_cash_flow(raw(spark, sf_dir))
    return fcf.select(
        "entity", "period_end", F.col("ocf").alias("minuend"), F.col("capex").alias("subtrahend"), F.col("fcf").alias("grounded"), (F.abs(F.col("ocf") - F.col("capex") - F.col("fcf")) < 1e-6).alias("consistent")
    )


@query(
    "calc_trend_direction",
    """, s AS (SELECT entity, concept, value - lag(value) OVER (PARTITION BY entity, concept ORDER BY fiscal_year) AS step FROM facts WHERE fiscal_quarter IS NULL AND NOT is_instant),
t AS (SELECT entity, concept, count(*) AS n_periods, coalesce(bool_and(step >= 0), true) AS up, coalesce(bool_and(step <= 0), true) AS down FROM s GROUP BY ALL)
SELECT entity, concept, n_periods, CASE WHEN up AND down THEN 'stable' WHEN up THEN 'up' WHEN down THEN 'down' ELSE 'fluctuating' END AS direction FROM t""",
)
def calc_trend_direction(spark, sf_dir):
    return ops.trend_direction(calc.annual(first(spark, sf_dir)), ["entity", "concept"], "fiscal_year", "value")


@query("calc_lookup", "SELECT entity, concept, period_end, CAST(arg_min(value, ord) AS DOUBLE) AS result FROM facts GROUP BY ALL")
def calc_lookup(spark, sf_dir):
    return first(spark, sf_dir).groupBy("entity", "concept", "period_end").agg(calc.number(F.min_by("value", "ord")).alias("result"))


@query(
    "calc_expression",
    """, v AS (SELECT entity, CAST(arg_min(CASE WHEN concept = 'us-gaap:GrossProfit' THEN value END, CASE WHEN concept = 'us-gaap:GrossProfit' THEN ord END) AS DOUBLE) AS g,
  CAST(arg_min(CASE WHEN concept = 'us-gaap:Revenues' THEN value END, CASE WHEN concept = 'us-gaap:Revenues' THEN ord END) AS DOUBLE) AS r FROM facts GROUP BY entity)
SELECT entity, g / nullif(r, 0) AS result, 'us-gaap:GrossProfit / us-gaap:Revenues' AS trace FROM v""",
)
def calc_expression(spark, sf_dir):
    return calc.calculate("us-gaap:GrossProfit / us-gaap:Revenues", first(spark, sf_dir))


@query(
    "fact_classify_period",
    """SELECT entity, concept, period_end, ord, CASE WHEN is_instant THEN 'instant' WHEN month(period_end) = 12 AND day(period_end) = 31
  THEN CASE WHEN month(period_start) = 10 AND day(period_start) = 1 THEN 'derived_standalone' ELSE 'annual_cumulative' END
  WHEN month(period_end) IN (3, 6, 9, 12) THEN 'quarterly_standalone' ELSE 'unknown' END AS semantics,
  CASE WHEN fiscal_quarter IS NULL THEN 'FY' || fiscal_year ELSE 'Q' || fiscal_quarter || '-' || fiscal_year END AS label FROM facts""",
)
def fact_classify_period(spark, sf_dir):
    return first(spark, sf_dir).select(
        "entity", "concept", "period_end", "ord", classify_period(F.col("is_instant"), F.col("period_start"), F.col("period_end")).alias("semantics"),
        period_label(F.col("fiscal_year"), F.col("fiscal_quarter")).alias("label"),
    )


@query(
    "period_compat_matrix",
    """WITH s(a) AS (VALUES ('annual_cumulative'), ('quarterly_standalone'), ('derived_standalone'), ('instant'), ('unknown'))
SELECT x.a, y.a AS b, x.a <> 'unknown' AND y.a <> 'unknown' AND (x.a = y.a OR (x.a IN ('quarterly_standalone', 'derived_standalone') AND y.a IN ('quarterly_standalone', 'derived_standalone'))) AS compatible
FROM s x, s y""",
    facts=False,
)
def period_compat_matrix(spark, sf_dir):
    return compatibility_matrix(spark)


@query("fact_first_wins_dedupe", "SELECT entity, concept, period_end, CAST(value AS DOUBLE) AS result, ord FROM facts")
def fact_first_wins_dedupe(spark, sf_dir):
    return first(spark, sf_dir).select("entity", "concept", "period_end", calc.number("value").alias("result"), "ord")


@query(
    "fact_upsert_keep_last",
    "SELECT entity, concept, period_end, CAST(value AS DOUBLE) AS result, ord FROM raw QUALIFY row_number() OVER (PARTITION BY entity, concept, period_end, is_instant, period_start ORDER BY ord DESC) = 1",
)
def fact_upsert_keep_last(spark, sf_dir):
    return ops.keep_last(raw(spark, sf_dir), list(ops.KEY)).select("entity", "concept", "period_end", calc.number("value").alias("result"), "ord")


_REQUIRED_SQL = """, required AS (SELECT entity, make_date(y, m, 1) AS d0, last_day(make_date(y, m, 1)) AS period_end, concept
  FROM (SELECT DISTINCT entity FROM facts), (SELECT unnest(range(1995, 2002)) AS y), (SELECT unnest([3, 6, 9, 12]) AS m), (SELECT unnest(['us-gaap:Revenues', 'us-gaap:GrossProfit']) AS concept))
"""


def required(facts: DataFrame) -> DataFrame:
    """The required grid: every entity, quarter end of 1995-2001 and two concepts."""
    days = F.explode(F.sequence(F.lit(1995), F.lit(2001)))
    grid = facts.select("entity").distinct().withColumn("y", days).withColumn("m", F.explode(F.array(*[F.lit(m) for m in (3, 6, 9, 12)])))
    return grid.select("entity", F.last_day(F.make_date("y", "m", F.lit(1))).alias("period_end"), F.explode(F.array(F.lit(src.REVENUE), F.lit(src.GROSS))).alias("concept"))


@query(
    "coverage_matrix",
    _REQUIRED_SQL
    + """SELECT r.entity, r.period_end, count(*) AS n_required, count(f.concept) AS n_found, coalesce(string_agg(CASE WHEN f.concept IS NULL THEN r.concept END, ',' ORDER BY r.concept), '') AS missing
FROM required r LEFT JOIN (SELECT DISTINCT entity, period_end, concept FROM facts) f USING (entity, period_end, concept) GROUP BY 1, 2""",
)
def coverage_matrix(spark, sf_dir):
    facts = first(spark, sf_dir)
    return ops.coverage(required(facts), facts)


@query("missing_periods", _REQUIRED_SQL + "SELECT entity, period_end, concept FROM required r WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.entity = r.entity AND f.period_end = r.period_end AND f.concept = r.concept)")
def missing_periods(spark, sf_dir):
    facts = first(spark, sf_dir)
    return ops.missing(required(facts), facts)


@query(
    "nearest_same_year_period",
    _REQUIRED_SQL
    + """, gone AS (SELECT entity, period_end, concept FROM required r WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.entity = r.entity AND f.period_end = r.period_end AND f.concept = r.concept)),
have AS (SELECT DISTINCT entity, concept, period_end AS near FROM facts)
SELECT g.entity, g.concept, g.period_end, near AS nearest FROM gone g LEFT JOIN have h ON g.entity = h.entity AND g.concept = h.concept AND year(g.period_end) = year(near)
QUALIFY row_number() OVER (PARTITION BY g.entity, g.concept, g.period_end ORDER BY abs(near - g.period_end), near) = 1""",
)
def nearest_same_year_period(spark, sf_dir):
    facts = first(spark, sf_dir)
    return ops.nearest_same_year(ops.missing(required(facts), facts), facts)


@query("facts_filter_point", "SELECT entity, concept, period_end, CAST(value AS DOUBLE) AS result FROM facts WHERE concept = 'us-gaap:Revenues' AND period_end = DATE '1996-12-31'")
def facts_filter_point(spark, sf_dir):
    return ops.point_filter(first(spark, sf_dir), concept=src.REVENUE, period_end="1996-12-31").select("entity", "concept", "period_end", calc.number("value").alias("result"))


@query("concept_list", "SELECT DISTINCT concept FROM facts")
def concept_list(spark, sf_dir):
    return ops.concept_list(first(spark, sf_dir))


@query("facts_summary", "SELECT count(*) AS n_facts, count(DISTINCT concept) AS n_concepts, count(DISTINCT period_end) AS n_periods, count(DISTINCT entity) AS n_entities FROM facts")
def facts_summary(spark, sf_dir):
    return ops.summarize(first(spark, sf_dir))


#: The filing model for DuckDB.
FILINGS_SQL = """WITH filings AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '10-K' ELSE '10-Q' END AS filing_type, CAST(2021 + (doc_id // 4) % 5 AS INTEGER) AS fiscal_year,
  CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 END AS fiscal_quarter,
  last_day(make_date(2021 + (doc_id // 4) % 5, CASE WHEN doc_id % 4 = 0 THEN 12 ELSE 3 * (doc_id % 4) END, 1)) AS period_end, source, text FROM documents)
"""


@query(
    "scope_filter_semi",
    FILINGS_SQL + "SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM filings f WHERE f.doc_id = d.doc_id AND fiscal_year IN (2022, 2023) AND (filing_type = '10-K' OR fiscal_quarter IN (1, 3)))",
    facts=False,
)
def scope_filter_semi(spark, sf_dir):
    wanted = src.filings(spark, sf_dir).filter(ops.scope([2022, 2023], ["10-K", "10-Q"], [1, 3]))
    return src.read_table(spark, sf_dir, "documents").select("doc_id", "source").join(wanted.select("doc_id"), "doc_id", "left_semi")


@query("filing_range_scan", FILINGS_SQL + "SELECT doc_id, filing_type, CAST(fiscal_year AS BIGINT) AS fiscal_year, period_end FROM filings WHERE period_end BETWEEN DATE '2022-03-31' AND DATE '2023-06-30'", facts=False)
def filing_range_scan(spark, sf_dir):
    day = F.col("period_end")
    f = src.filings(spark, sf_dir).filter(day.between(F.lit("2022-03-31").cast("date"), F.lit("2023-06-30").cast("date")))
    return f.select("doc_id", "filing_type", F.col("fiscal_year").cast("bigint").alias("fiscal_year"), "period_end")


@query("available_periods", FILINGS_SQL + "SELECT CAST(fiscal_year AS BIGINT) AS fiscal_year, count(DISTINCT fiscal_quarter) AS n_quarters, count(*) AS n_filings FROM filings GROUP BY 1", facts=False)
def available_periods(spark, sf_dir):
    return src.filings(spark, sf_dir).groupBy(F.col("fiscal_year").cast("bigint").alias("fiscal_year")).agg(F.count_distinct("fiscal_quarter").alias("n_quarters"), F.count(F.lit(1)).alias("n_filings"))
