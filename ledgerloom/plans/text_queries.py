"""Queries over chunks, vectors, evidence and ingestion, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import numeric_cells, suspicious_cell, table_scale
from ..operators import chunking, evaluation, evidence, fusion, ingestion, layout, lexical, vectors
from ..sources import tables as src
from ..sources.work import materialize, work_dir
from .facts_queries import FACTS_SQL, first

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# --- lexical ------------------------------------------------------------------------------------

CHUNKS_SQL = r"""WITH chunk AS (SELECT doc_id AS chunk_id, source, text, CAST(2021 + (doc_id // 4) % 5 AS BIGINT) AS fiscal_year,
  regexp_extract_all(lower(source || ' ' || text), '[a-z0-9]+(?:[-''][a-z0-9]+)*') AS tokens FROM documents),
sized AS (SELECT *, len(tokens) AS dl FROM chunk), word AS (SELECT chunk_id, dl, unnest(tokens) AS token FROM sized)
"""
SCORES_SQL = CHUNKS_SQL + r""", asked AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-''][a-z0-9]+)*')) AS token FROM benchmark) GROUP BY ALL),
tf AS (SELECT chunk_id, dl, token, count(*) AS tf FROM word WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), st AS (SELECT count(*) AS n, avg(dl) AS a FROM sized),
score AS (SELECT query_id, chunk_id, round(sum(qtf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / a)))), 6) AS score
  FROM asked JOIN df USING (token) JOIN tf USING (token), st GROUP BY ALL HAVING score > 0)
"""


def chunk_tokens(spark: SparkSession, sf_dir: str, make=lexical.tokenized) -> DataFrame:
    return make(src.chunks(spark, sf_dir), "chunk_id", F.concat_ws(" ", "section_title", "text"), F.col("fiscal_year").cast("bigint").alias("fiscal_year"))


def question_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), lexical.tokens(F.col("text")).alias("tokens"))


def lexical_top(spark: SparkSession, sf_dir: str, k: int, group: str | None = None, where: str | None = None) -> DataFrame:
    return lexical.bm25_top(chunk_tokens(spark, sf_dir, lexical.lowered), question_tokens(spark, sf_dir), k, group, where)


@query("tokenize_df", CHUNKS_SQL + "SELECT token, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM word GROUP BY token")
def tokenize_df(spark, sf_dir):
    return lexical.document_frequency(chunk_tokens(spark, sf_dir))


@query("corpus_stats", CHUNKS_SQL + "SELECT count(*) AS n_chunks, CAST(sum(dl) AS BIGINT) AS n_tokens, round(avg(dl), 6) AS avg_dl FROM sized")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(chunk_tokens(spark, sf_dir))


_TOP_SQL = "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {t} QUALIFY rank <= {k}"


@query("bm25_topk", SCORES_SQL + _TOP_SQL.format(t="score", k=15))
def bm25_topk(spark, sf_dir):
    return lexical_top(spark, sf_dir, lexical.TOP)


@query("bm25_doc_filtered", SCORES_SQL + ", f AS (SELECT s.* FROM score s JOIN sized USING (chunk_id) WHERE fiscal_year = 2023) " + _TOP_SQL.format(t="f", k=15))
def bm25_doc_filtered(spark, sf_dir):
    """Statistics stay global; only the hits are restricted."""
    top = lexical_top(spark, sf_dir, lexical.TOP, "fiscal_year", "fiscal_year = 2023")
    return top.select("query_id", "chunk_id", "score", "rank")


_PERIOD_SQL = ", f AS (SELECT s.*, fiscal_year FROM score s JOIN sized USING (chunk_id)) SELECT query_id, fiscal_year, chunk_id, score, row_number() OVER (PARTITION BY query_id, fiscal_year ORDER BY score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 3"


@query("bm25_per_period", SCORES_SQL + _PERIOD_SQL)
def bm25_per_period(spark, sf_dir):
    return lexical_top(spark, sf_dir, fusion.per_period_top(5), "fiscal_year").select("query_id", "fiscal_year", "chunk_id", "score", "rank")


# --- vectors and fusion -------------------------------------------------------------------------

VECTORS_SQL = """WITH v AS (SELECT vec_id, vec_id // 4 AS source_chunk_id, vec_id % 4 AS segment_index, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, v.source_chunk_id, v.label, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6) AS score
  FROM v, v q WHERE q.vec_id % 100 = 0)
"""
_VTOP = "SELECT query_id, vec_id, source_chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s {w} QUALIFY rank <= 15"


def vector_pairs(spark: SparkSession, sf_dir: str, k: int, match: tuple[str, str] | None = None) -> DataFrame:
    """The stated query set is every vector whose id is divisible by 100."""
    v = src.vectors(spark, sf_dir)
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("embedding").alias("query_embedding"))
    rows = src.read_table(spark, sf_dir, "embeddings").count()
    return vectors.search(v, asked, k, rows, -(-rows // 100), match)


@query("vector_topk", VECTORS_SQL + _VTOP.format(w=""))
def vector_topk(spark, sf_dir):
    return vector_pairs(spark, sf_dir, 15)


@query("vector_filtered_topk", VECTORS_SQL + _VTOP.format(w="WHERE label = query_label"))
def vector_filtered_topk(spark, sf_dir):
    return vector_pairs(spark, sf_dir, 15, ("label", "query_label"))


_COLLAPSE = ", c AS (SELECT query_id, source_chunk_id, max(score) AS score, arg_min(vec_id, {'a': -score, 'b': vec_id}) AS vec_id FROM (" + _VTOP.format(w="").replace("<= 15", "<= 60") + ") GROUP BY ALL) "


@query("vector_segment_collapse", VECTORS_SQL + _COLLAPSE + "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_chunk_id) AS rank FROM c QUALIFY rank <= 15")
def vector_segment_collapse(spark, sf_dir):
    """15 chunks from the 60 best segments: a chunk has four segments at most."""
    best = vectors.collapse_segments(vector_pairs(spark, sf_dir, 60))
    return lexical.top_k(best, ["query_id"], 15, "source_chunk_id")


@query(
    "vector_lineage_check",
    """WITH v AS (SELECT vec_id // 4 AS c, vec_id % 4 AS s FROM embeddings)
SELECT DISTINCT c AS chunk_id, 'orphan' AS problem FROM v WHERE c NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'not_indexed' FROM documents WHERE doc_id NOT IN (SELECT c FROM v)
UNION ALL SELECT DISTINCT c, 'repeated_segment' FROM (SELECT c, s FROM v GROUP BY ALL HAVING count(*) > 1)""",
)
def vector_lineage_check(spark, sf_dir):
    return vectors.lineage(src.vectors(spark, sf_dir), src.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")))


_LANES = SCORES_SQL + """, v AS (SELECT vec_id, vec_id // 4 AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vs AS (SELECT i.item_id AS query_id, v.chunk_id, max(round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6)) AS score
  FROM benchmark i JOIN v q ON q.vec_id = i.item_id, v GROUP BY ALL),
yr AS (SELECT doc_id AS chunk_id, CAST(2021 + (doc_id // 4) % 5 AS BIGINT) AS fiscal_year FROM documents)
"""
_FUSE = """, both_lanes AS (SELECT {k}, chunk_id, rank, 0 AS lane FROM lex UNION ALL SELECT {k}, chunk_id, rank, 1 FROM vec),
fused AS (SELECT {k}, chunk_id, round(sum(1e0 / (60 + rank)), 9) AS fused, min({{'lane': lane, 'rank': rank}}) AS f FROM both_lanes GROUP BY ALL),
hits AS (SELECT {k}, chunk_id, fused, row_number() OVER (PARTITION BY {k} ORDER BY fused DESC, f.lane, f.rank, chunk_id) AS final_rank FROM fused QUALIFY final_rank <= {n})
"""
_SINGLE = ", lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM score QUALIFY rank <= 15), vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs QUALIFY rank <= 15)" + _FUSE.format(k="query_id", n=8)
_PERIOD = ", lex AS (SELECT query_id, fiscal_year, chunk_id, row_number() OVER (PARTITION BY query_id, fiscal_year ORDER BY score DESC, chunk_id) AS rank FROM score JOIN yr USING (chunk_id) QUALIFY rank <= 15), vec AS (SELECT query_id, fiscal_year, chunk_id, row_number() OVER (PARTITION BY query_id, fiscal_year ORDER BY score DESC, chunk_id) AS rank FROM vs JOIN yr USING (chunk_id) QUALIFY rank <= 15)" + _FUSE.format(k="query_id, fiscal_year", n=3)


def vector_lane(spark: SparkSession, sf_dir: str, k: int, group: str | None = None) -> DataFrame:
    """query_id, (group,) chunk_id, score, rank: each question's own vector against all, best segment of each chunk."""
    v = src.vectors(spark, sf_dir)
    items = src.read_table(spark, sf_dir, "benchmark")
    asked = v.join(items, v.vec_id == items.item_id).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    rows, n = src.read_table(spark, sf_dir, "embeddings").count(), items.count()
    if group:
        years = src.filings(spark, sf_dir).select(F.col("doc_id").alias("source_chunk_id"), F.col("fiscal_year").cast("bigint").alias("fiscal_year"))
        v = v.join(years, "source_chunk_id")
    found = vectors.search(v, asked, k, rows, n, group=group, collapse=True)
    return found.select("query_id", *([group] if group else []), F.col("source_chunk_id").alias("chunk_id"), "score", "rank")


def single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(lexical_top(spark, sf_dir, 15), vector_lane(spark, sf_dir, 15), ["query_id"])


@query("hybrid_single_pass", _LANES + _SINGLE + "SELECT * FROM hits")
def hybrid_single_pass(spark, sf_dir):
    return single_pass(spark, sf_dir)


@query("hybrid_per_period", _LANES + _PERIOD + "SELECT query_id, chunk_id, min(fiscal_year) AS fiscal_year, arg_min(fused, fiscal_year) AS fused, arg_min(final_rank, fiscal_year) AS final_rank FROM hits GROUP BY 1, 2")
def hybrid_per_period(spark, sf_dir):
    lex, vec = lexical_top(spark, sf_dir, 15, "fiscal_year"), vector_lane(spark, sf_dir, 15, "fiscal_year")
    return fusion.first_period_wins(fusion.fuse(lex, vec, ["query_id", "fiscal_year"], top=fusion.per_period_top(5)), "query_id", "fiscal_year")


# --- evidence -----------------------------------------------------------------------------------

_HITS = SCORES_SQL + ", top AS (" + _TOP_SQL.format(t="score", k=15) + "), hit AS (SELECT t.query_id, t.chunk_id, t.rank, d.text, d.source AS section_title, CASE WHEN d.doc_id % 3 > 0 THEN d.doc_id % 50 END AS page_number FROM top t JOIN documents d ON d.doc_id = t.chunk_id)\n"
CUES = ["tion", "ement", "ung", "risk"]


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = src.chunks(spark, sf_dir).select("chunk_id", "text", "section_title", F.when(F.col("chunk_id") % 3 > 0, F.col("chunk_id") % 50).alias("page_number"))
    # Written, so that the planner knows how few they are: they are broadcast, and the texts stay where they are.
    return materialize(bm25_topk(spark, sf_dir), "hits").join(chunks, "chunk_id")


@query(
    "citations_ranked",
    _HITS
    + """, once AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY query_id, substr(text, 1, 200) ORDER BY rank, chunk_id) = 1),
p AS (SELECT *, CAST(CASE WHEN page_number IS NOT NULL AND section_title IS NOT NULL THEN 0 WHEN section_title IS NOT NULL THEN 1 WHEN page_number IS NOT NULL THEN 2 ELSE 3 END AS BIGINT) AS priority FROM once)
SELECT query_id, chunk_id, priority, row_number() OVER (PARTITION BY query_id ORDER BY priority, rank, chunk_id) AS place FROM p QUALIFY place <= 8""",
)
def citations_ranked(spark, sf_dir):
    return evidence.citations(hits(spark, sf_dir), "query_id")


@query(
    "confidence_status",
    _HITS
    + """, n AS (SELECT query_id, count(CASE WHEN rank <= 8 AND page_number IS NOT NULL THEN 1 END) AS n, bool_or(page_number > 40) AS m, query_id % 2 = 0 AS narr, bool_or(page_number < 10) AS sec FROM hit GROUP BY query_id),
b AS (SELECT *, CASE WHEN coalesce(m, false) THEN least(least(n / 5e0, 1e0) + 0.2e0, 1e0) ELSE least(n / 5e0, 1e0) * 0.5e0 END AS base FROM n),
c AS (SELECT query_id, n, round(CASE WHEN narr AND NOT coalesce(sec, false) THEN base * 0.3e0 ELSE base END, 2) AS confidence FROM b)
SELECT query_id, n AS n_items, confidence, CASE WHEN n = 0 THEN 'insufficient_evidence' WHEN confidence < 0.5e0 THEN 'partial' ELSE 'ok' END AS status FROM c""",
)
def confidence_status(spark, sf_dir):
    page = F.col("page_number")
    per = hits(spark, sf_dir).groupBy("query_id").agg(
        F.count(F.when((F.col("rank") <= 8) & page.isNotNull(), 1)).alias("n_items"), F.coalesce(F.bool_or(page > 40), F.lit(False)).alias("matched"), F.coalesce(F.bool_or(page < 10), F.lit(False)).alias("sections")
    )
    c = evidence.confidence(F.col("n_items"), F.col("matched"), F.col("query_id") % 2 == 0, F.col("sections"))
    return per.select("query_id", "n_items", c.alias("confidence")).withColumn("status", evidence.status(F.col("n_items"), F.col("confidence")))


_N_CUES = " + ".join(f"CAST(contains(lower(text), '{c}') AS BIGINT)" for c in CUES)


@query("narrative_cue_rerank", _HITS + f", c AS (SELECT query_id, chunk_id, rank, {_N_CUES} AS n_cues FROM hit) SELECT query_id, chunk_id, n_cues, row_number() OVER (PARTITION BY query_id ORDER BY n_cues DESC, rank, chunk_id) AS place FROM c QUALIFY place <= 3")
def narrative_cue_rerank(spark, sf_dir):
    return evidence.cue_rerank(hits(spark, sf_dir), "query_id", CUES, 3)


_AT = "coalesce(" + ", ".join(f"nullif(strpos(lower(text), '{c}'), 0)" for c in CUES) + ", 1)"


@query("narrative_excerpt", f"SELECT doc_id, substr(text, greatest(1, {_AT} - 80), 300) AS excerpt FROM documents")
def narrative_excerpt(spark, sf_dir):
    return src.read_table(spark, sf_dir, "documents").select("doc_id", evidence.excerpt(F.col("text"), CUES).alias("excerpt"))


# --- tables -------------------------------------------------------------------------------------

_RENDER = """cell AS (SELECT l_orderkey AS table_id, CAST(l_linenumber AS BIGINT) AS row_index,
  CASE l_linenumber % 8 WHEN 0 THEN '(' || p || ')' WHEN 1 THEN '$ ' || p WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '%' WHEN 3 THEN p || ' M' WHEN 4 THEN '–'
    WHEN 5 THEN '–' || p WHEN 6 THEN l_returnflag || l_linestatus || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '1,' || p || 'bn' END AS raw_value
  FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM lineitem))"""


def rendered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as table cells in the many ways that reports write numbers."""
    li = src.read_table(spark, sf_dir, "lineitem")
    p, n, q = F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_linenumber") % 8, F.col("l_quantity").cast("bigint").cast("string")
    forms = [F.concat(F.lit("("), p, F.lit(")")), F.concat(F.lit("$ "), p), F.concat(q, F.lit("%")), F.concat(p, F.lit(" M")), F.lit("–"), F.concat(F.lit("–"), p), F.concat("l_returnflag", "l_linestatus", q), F.concat(F.lit("1,"), p, F.lit("bn"))]
    value = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        value = F.when(n == k, f).otherwise(value)
    return li.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("bigint").alias("row_index"), value.alias("raw_value"))


_PARSED = f"""WITH {_RENDER}, parsed AS (SELECT *, CASE
  WHEN raw_value LIKE '(%' THEN -CAST(substr(raw_value, 2, length(raw_value) - 2) AS DOUBLE) WHEN raw_value LIKE '$%' THEN CAST(substr(raw_value, 3) AS DOUBLE)
  WHEN raw_value LIKE '%\\%' ESCAPE '\\' THEN CAST(replace(raw_value, '%', '') AS DOUBLE) / 100e0 WHEN raw_value LIKE '% M' THEN CAST(replace(raw_value, ' M', '') AS DOUBLE) * 1e6
  WHEN raw_value = '–' THEN 0e0 WHEN raw_value LIKE '–%' THEN -CAST(substr(raw_value, 2) AS DOUBLE) WHEN raw_value LIKE '%bn' THEN CAST(replace(replace(raw_value, 'bn', ''), ',', '') AS DOUBLE) * 1e9 END AS value,
  CASE WHEN raw_value LIKE '%\\%' ESCAPE '\\' THEN 'percent' WHEN raw_value LIKE '% M' THEN 'scaled_1e+06' WHEN raw_value = '–' THEN 'dash_zero' WHEN raw_value LIKE '%bn' THEN 'scaled_1e+09'
  WHEN regexp_matches(raw_value, '^[A-Z]') AND NOT regexp_matches(raw_value, '^[NT]+[0-9]') THEN 'non_numeric' WHEN regexp_matches(raw_value, '^[A-Z]') THEN 'parse_failed: ''' || raw_value || '''' ELSE 'ok' END AS detail FROM cell)
"""


@query("numeric_cell_normalize", _PARSED + "SELECT * FROM parsed")
def numeric_cell_normalize(spark, sf_dir):
    return numeric_cells(rendered_cells(spark, sf_dir), "raw_value")


_SUSPECT = r"CASE WHEN regexp_matches({c}, '[Il][0-9]') THEN 1 WHEN regexp_matches({c}, '[0-9][Oo][0-9]') THEN 2 WHEN regexp_matches({c}, '[0-9][Ss][0-9]') THEN 3 WHEN regexp_matches({c}, '\b[A-Za-z]+\d+[A-Za-z]+\b') THEN 4 END"


@query("numeric_cell_suspect", "SELECT event_id, CAST(" + _SUSPECT.format(c="x") + " AS BIGINT) AS pattern FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'l' || user_id WHEN 1 THEN '51,' || user_id || 'O8' WHEN 2 THEN '7S' || user_id WHEN 3 THEN 'ab' || user_id || 'cd' ELSE CAST(user_id AS VARCHAR) END AS x FROM events)")
def numeric_cell_suspect(spark, sf_dir):
    e, u = src.read_table(spark, sf_dir, "events"), F.col("user_id").cast("string")
    k = F.col("event_id") % 5
    x = F.when(k == 0, F.concat(F.lit("l"), u)).when(k == 1, F.concat(F.lit("51,"), u, F.lit("O8"))).when(k == 2, F.concat(F.lit("7S"), u)).when(k == 3, F.concat(F.lit("ab"), u, F.lit("cd"))).otherwise(u)
    return e.select("event_id", suspicious_cell(x).alias("pattern"))


@query("table_status_rollup", _PARSED + """, st AS (SELECT table_id, CASE WHEN detail LIKE 'parse_failed%' THEN 2 WHEN detail = 'non_numeric' AND len(regexp_extract_all(raw_value, '\\d')) >= 2 AND (""" + _SUSPECT.format(c="raw_value") + """) IS NOT NULL THEN 1 ELSE 0 END AS s FROM parsed)
SELECT table_id, count(*) AS n_cells, CASE max(s) WHEN 2 THEN 'failed' WHEN 1 THEN 'suspect' ELSE 'valid' END AS table_status FROM st GROUP BY table_id""")
def table_status_rollup(spark, sf_dir):
    return ingestion.table_status(ingestion.validate_cells(rendered_cells(spark, sf_dir)), ["table_id"])


_ROWS_SQL = """WITH r AS (SELECT l_orderkey AS table_id, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 OR l_orderkey % 4 = 0 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS c, l_orderkey % 4 = 0 AS narrow FROM lineitem)"""


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of lines; every fourth has but one column, and cells carry white space to clean."""
    li = src.read_table(spark, sf_dir, "lineitem")
    narrow = F.col("l_orderkey") % 4 == 0
    cell = F.when((F.col("l_linenumber") % 3 == 0) | narrow, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("bigint").cast("string"), F.lit("\t")))
    rows = li.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", cell.alias("c")))).alias("lines"))  # seven lines at most
    body = F.transform("lines", lambda x: F.array(F.concat(F.lit("Line "), x["l_linenumber"].cast("string")), x["c"]))
    head = F.array(F.lit("Line"), F.when(F.col("table_id") % 4 == 0, "").otherwise("Quantity"))
    return rows.select("table_id", F.concat(F.array(head, F.array(F.lit(""), F.lit(None).cast("string"))), body).alias("raw"))


@query(
    "table_layout",
    _ROWS_SQL + " SELECT table_id, count(*) >= 2 AND NOT bool_and(narrow) AS is_table, 'Line | ' || CASE WHEN bool_and(narrow) THEN '' ELSE 'Quantity' END || chr(10) || string_agg('Line ' || n || ' | ' || c, chr(10) ORDER BY n, c) AS text FROM r GROUP BY table_id",
)
def table_layout(spark, sf_dir):
    made = layout.split_table(raw_tables(spark, sf_dir), "raw")
    return made.select("table_id", layout.is_table(F.col("headers"), F.col("rows")).alias("is_table"), layout.table_text(F.col("headers"), F.col("rows")).alias("text"))


_TABLE_STATUS = """, st AS (SELECT table_id, max(CASE WHEN detail LIKE 'parse_failed%' THEN 2 WHEN detail = 'non_numeric' AND len(regexp_extract_all(raw_value, '\\d')) >= 2 AND (""" + _SUSPECT.format(c="raw_value") + """) IS NOT NULL THEN 1 ELSE 0 END) AS s FROM parsed GROUP BY table_id)"""


_CELLS_SQL = """, cell AS (SELECT entity || '/' || strftime(period_end, '%Y-%m-%d') AS table_id, entity, period_end, CASE concept WHEN 'us-gaap:Revenues' THEN 'Total revenues (USD)' WHEN 'us-gaap:GrossProfit' THEN 'Gross profit' ELSE 'Other' END AS header,
  CAST(value AS DOUBLE) * (CASE WHEN month(period_end) = 6 THEN 1.05e0 ELSE 1e0 END) AS value FROM facts WHERE NOT is_instant),
lab(concept, label) AS (VALUES ('us-gaap:Revenues', 'revenues'), ('us-gaap:GrossProfit', 'gross profit')),
named AS (SELECT * FROM cell JOIN lab ON contains(lower(header), label))
SELECT n.table_id, n.entity, n.period_end, n.concept, round(n.value, 4) AS table_value, round(CAST(f.value AS DOUBLE), 4) AS fact_value, abs(n.value - CAST(f.value AS DOUBLE)) / greatest(abs(CAST(f.value AS DOUBLE)), 1e-9) <= 0.01e0 AS matched
FROM named n JOIN facts f USING (entity, period_end, concept)"""


@query("reconcile_theta", FACTS_SQL + _CELLS_SQL)
def reconcile_theta(spark, sf_dir):
    facts = first(spark, sf_dir)
    header = F.when(F.col("concept") == src.REVENUE, "Total revenues (USD)").when(F.col("concept") == src.GROSS, "Gross profit").otherwise("Other")
    cells = facts.filter("NOT is_instant").select(
        F.concat("entity", F.lit("/"), F.date_format("period_end", "yyyy-MM-dd")).alias("table_id"), "entity", "period_end", header.alias("header"),
        (F.col("value").cast("double") * F.when(F.month("period_end") == 6, 1.05).otherwise(1.0)).alias("value"),
    )
    labels = spark.createDataFrame([(src.REVENUE, "revenues"), (src.GROSS, "gross profit")], "concept string, label string")
    return ingestion.reconcile(cells, facts, labels)


#: A statement table as reports print it.
TABLE_ROWS = [
    (1, 0, "Segment", "Revenue", 1_000_000), (1, 1, "Total automotive revenues", "71,462", 1_000_000), (1, 2, "Total revenues", "81,462", 1_000_000), (1, 3, "Gross profit", "20,853", 1_000_000),
    (2, 0, "Operating loss", "(1,994)", 1_000), (2, 1, "Revenues", "$ 19963", 1_000), (2, 2, "Income from operations", "-7.5", 1_000),
]
ALIASES = [(src.REVENUE, "total revenues"), (src.REVENUE, "revenues"), (src.GROSS, "gross profit"), (src.OPERATING, "operating loss"), (src.OPERATING, "income from operations")]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


@query(
    "table_value_extract",
    f"""WITH r(table_id, row_index, label, cell, scale) AS (VALUES {_values(TABLE_ROWS)}), a(concept, alias) AS (VALUES {_values(ALIASES)}),
h AS (SELECT table_id, concept, row_index, cell, scale FROM r JOIN a ON contains(lower(label), alias) QUALIFY row_number() OVER (PARTITION BY table_id, concept ORDER BY row_index, alias) = 1)
SELECT CAST(table_id AS BIGINT) AS table_id, concept, CAST(row_index AS BIGINT) AS row_index, (CASE WHEN contains(cell, '(') OR cell LIKE '-%' THEN -1e0 ELSE 1e0 END) * CAST(replace(regexp_extract(cell, '[0-9][0-9,.]*'), ',', '') AS DOUBLE) * scale AS value FROM h""",
)
def table_value_extract(spark, sf_dir):
    rows = spark.createDataFrame(TABLE_ROWS, "table_id long, row_index long, label string, cell string, scale long")
    return evidence.table_values(rows, spark.createDataFrame(ALIASES, "concept string, alias string"))


@query("table_scale_infer", "SELECT * FROM (VALUES ('(In millions, except per share)', 1000000), ('in thousands of units', 1000), ('amounts IN BILLIONS', 1000000000), ('in thousands and in millions', 1000000), ('plain', 1)) t(caption, scale)")
def table_scale_infer(spark, sf_dir):
    t = spark.createDataFrame([(x,) for x in ("(In millions, except per share)", "in thousands of units", "amounts IN BILLIONS", "in thousands and in millions", "plain")], "caption string")
    return t.select("caption", table_scale(F.col("caption")).cast("int").alias("scale"))


HEADERS = [(1, 0, "Year"), (1, 1, "Revenue"), (1, 2, "Revenue"), (1, 3, ""), (1, 4, "Revenue"), (2, 0, "Revenue")]


@query(
    "header_dedupe",
    f"""WITH h(table_id, col, name) AS (VALUES {_values(HEADERS)}), n AS (SELECT *, row_number() OVER (PARTITION BY table_id, name ORDER BY col) AS k FROM h)
SELECT CAST(table_id AS BIGINT) AS table_id, CAST(col AS BIGINT) AS col, name || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS name FROM n""",
)
def header_dedupe(spark, sf_dir):
    return ingestion.dedupe_headers(spark.createDataFrame(HEADERS, "table_id long, col long, name string"))


@query("table_clean", "SELECT * FROM (VALUES (1, 'Segment|Revenue / Auto motive|71,462'), (2, '')) t(table_id, cells)")
def table_clean(spark, sf_dir):
    raw = [(1, [[" Segment ", "Revenue\n"], ["", None], ["Auto \t motive", "71,462"]]), (2, [["", " "]])]
    t = spark.createDataFrame(raw, "table_id int, raw array<array<string>>").withColumn("rows", ingestion.clean_table(F.col("raw")))
    return t.select("table_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), " / ").alias("cells"))


# --- ingestion ----------------------------------------------------------------------------------

RAW_FILES = ["Acme_2023_全年_10-K.pdf", "Acme_2023_Q1_10-Q.pdf", "Acme_2023_Q2_10-Q.pdf", "Acme_2022_全年_10-K.pdf", "notes.pdf", "Acme_2023_Q4_10-Q.pdf"]


@query(
    "manifest_gaps",
    """WITH g AS (SELECT y AS fiscal_year, q AS fiscal_quarter, CASE WHEN q IS NULL THEN '10-K' ELSE '10-Q' END AS form FROM (SELECT unnest(range(2021, 2026)) AS y), (SELECT unnest([NULL, 1, 2, 3]) AS q)),
l(y, q, f, p) AS (VALUES (2023, NULL, '10-K', 'Acme_2023_全年_10-K.pdf'), (2023, 1, '10-Q', 'Acme_2023_Q1_10-Q.pdf'), (2023, 2, '10-Q', 'Acme_2023_Q2_10-Q.pdf'), (2022, NULL, '10-K', 'Acme_2022_全年_10-K.pdf'))
SELECT CAST(fiscal_year AS BIGINT) AS fiscal_year, CAST(fiscal_quarter AS BIGINT) AS fiscal_quarter, form, CASE WHEN p IS NULL THEN 'downloadable' ELSE 'available' END AS status, p AS source_path
FROM g LEFT JOIN l ON fiscal_year = y AND fiscal_quarter IS NOT DISTINCT FROM q AND form = f""",
)
def manifest_gaps(spark, sf_dir):
    files = spark.createDataFrame([(x, x) for x in RAW_FILES], "name string, path string")
    return ingestion.manifest(spark, ingestion.parse_file_names(files), range(2021, 2026))


HEADING_SQL = "length(line) > 0 AND length(line) < 25"
_LINES_SQL = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query(
    "section_islands",
    _LINES_SQL
    + f""", m AS (SELECT *, CAST({HEADING_SQL} AS BIGINT) AS h FROM l), s AS (SELECT *, CAST(sum(h) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_id FROM m)
SELECT doc_id, section_id, coalesce(arg_min(CASE WHEN h = 1 THEN line END, CASE WHEN h = 1 THEN line_no END), 'Preamble') AS title, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM s GROUP BY doc_id, section_id""",
)
def section_islands(spark, sf_dir):
    """Short lines are headings here."""
    lines = ingestion.lines_of(src.read_table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return ingestion.sections(lines, "doc_id", (F.length("line") > 0) & (F.length("line") < 25))


@query(
    "section_carry_forward",
    _LINES_SQL + f" SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, last_value(CASE WHEN {HEADING_SQL} THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section_title FROM l",
)
def section_carry_forward(spark, sf_dir):
    lines = ingestion.lines_of(src.read_table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumn("title", F.when((F.length("line") > 0) & (F.length("line") < 25), F.col("line")))
    return ingestion.carry_forward(lines, "doc_id", "line_no", "title").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "section_title")


@query(
    "hard_split_segments",
    """WITH d AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 180) / 2220e0) AS BIGINT)) AS n FROM documents WHERE length(text) > 0), k AS (SELECT *, unnest(range(0, n)) AS segment_index FROM d)
SELECT doc_id, segment_index, length(substr(text, segment_index * 2220 + 1, 2400)) AS n_chars, md5(substr(text, segment_index * 2220 + 1, 2400)) AS digest FROM k""",
)
def hard_split_segments(spark, sf_dir):
    parts = chunking.hard_split(F.col("text"), chunking.SEGMENT_CHARS, chunking.SEGMENT_OVERLAP)
    exploded = src.read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("segment_index", "part"))
    return exploded.select("doc_id", F.col("segment_index").cast("bigint").alias("segment_index"), F.length("part").cast("bigint").alias("n_chars"), F.md5(F.col("part").cast("binary")).alias("digest"))


@query("sliding_chunks")
def sliding_chunks(spark, sf_dir):
    return chunking.sliding_chunks(src.read_table(spark, sf_dir, "documents"), "doc_id", "text")


@query("index_segments")
def index_segments(spark, sf_dir):
    return chunking.index_segments(src.read_table(spark, sf_dir, "documents"), "doc_id", "text")


_PAGE = r"trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')"


def page_text(html):
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\n\r]+", " "))


@query("page_diagnostics", f"SELECT page_id, length({_PAGE}) AS n_chars, CASE WHEN length({_PAGE}) = 0 THEN 'empty_text' WHEN length({_PAGE}) < 20 THEN 'insufficient_text' END AS fallback_reason FROM pages")
def page_diagnostics(spark, sf_dir):
    p = src.read_table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("bigint").alias("n_chars"), ingestion.page_fallback(F.col("t"), F.lit(0)).alias("fallback_reason"))


@query(
    "ingestion_diagnostics",
    _PARSED + _TABLE_STATUS + f" SELECT (SELECT count(*) FROM pages WHERE length({_PAGE}) < 20) AS fallback_pages, (SELECT count(*) FROM pages WHERE length({_PAGE}) = 0) AS failed_pages, (SELECT count(*) FROM st WHERE s = 2) AS validation_failed_tables, (SELECT count(*) FROM st WHERE s = 1) AS validation_suspect_tables",
)
def ingestion_diagnostics(spark, sf_dir):
    """Pages without any text count as failed here."""
    pages = page_diagnostics(spark, sf_dir).withColumn("failed", F.col("n_chars") == 0)
    return ingestion.diagnostics(pages, table_status_rollup(spark, sf_dir))


@query("page_toc", r"SELECT page_id, len(list_filter(string_split(replace(html, '<li>', chr(10) || 'Item 1 '), chr(10)), lambda x: regexp_matches(x, '(?i)^\s*item\s+\d+[a-z]?\b'))) >= 5 AS is_toc FROM pages")
def page_toc(spark, sf_dir):
    """Menu entries stand for the items of a table of contents."""
    return src.read_table(spark, sf_dir, "pages").select("page_id", ingestion.is_toc(F.regexp_replace("html", "<li>", "\nItem 1 ")).alias("is_toc"))


_STATE = "WITH cur AS (SELECT doc_id, sha256(text) AS fingerprint, source AS source_path FROM documents), st AS (SELECT CASE WHEN doc_id % 17 = 3 THEN doc_id + 10000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(text) END AS fingerprint, CASE WHEN doc_id % 7 = 0 THEN 'moved' ELSE source END AS source_path FROM documents)"


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = src.read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"), F.col("source").alias("source_path"))
    old = d.select(
        F.when(F.col("doc_id") % 17 == 3, F.col("doc_id") + 10000000).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(F.col("doc_id") % 7 == 0, "moved").otherwise(F.col("source_path")).alias("source_path"),
    )
    return d, old


@query(
    "state_reuse_plan",
    _STATE + " SELECT c.doc_id, CASE WHEN s.doc_id IS NULL THEN 'missing_state' WHEN c.source_path <> s.source_path THEN 'source_path_changed' WHEN c.fingerprint <> s.fingerprint THEN 'source_changed' ELSE 'unchanged' END AS reason FROM cur c LEFT JOIN st s USING (doc_id)",
)
def state_reuse_plan(spark, sf_dir):
    return ingestion.reuse_plan(*_states(spark, sf_dir))


@query("stale_docs", _STATE + " SELECT doc_id FROM st WHERE doc_id NOT IN (SELECT doc_id FROM cur)")
def stale_docs(spark, sf_dir):
    return ingestion.stale(*_states(spark, sf_dir))


# --- agent and evaluation -----------------------------------------------------------------------


@query(
    "agent_trace_summary",
    "WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS p FROM conversations) SELECT conv_id, count(*) AS iterations, string_agg(role, ',' ORDER BY turn, role) AS actions, coalesce(bool_or(role = p), false) AS no_progress FROM t GROUP BY conv_id",
)
def agent_trace_summary(spark, sf_dir):
    return evaluation.trace_summary(src.read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


_ACTIONS = [("swap_concept", 1), ("relax_period", 2), ("widen_tables", 3), ("extract", 4)]


@query("agent_actions")
def agent_actions(spark, sf_dir):
    turns = src.read_table(spark, sf_dir, "conversations")
    options = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(p).alias("priority")) for a, p in _ACTIONS])
    tried = turns.select("conv_id", F.when(F.col("role") == "user", "swap_concept").when(F.col("role") == "assistant", "relax_period").otherwise("none").alias("action"))
    return evaluation.next_action(turns.select("conv_id").distinct().select("conv_id", F.inline(options)), tried, "conv_id")


ORACLE["agent_actions"] = f"""WITH a(action, priority) AS (VALUES {_values(_ACTIONS)}), c AS (SELECT DISTINCT conv_id FROM conversations),
tried AS (SELECT DISTINCT conv_id, CASE role WHEN 'user' THEN 'swap_concept' WHEN 'assistant' THEN 'relax_period' ELSE 'none' END AS action FROM conversations)
SELECT c.conv_id, a.action FROM c, a WHERE NOT EXISTS (SELECT 1 FROM tried t WHERE t.conv_id = c.conv_id AND t.action = a.action) QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY priority, action) = 1"""


@query("judge_legacy", "SELECT doc_id, quality = 1 AND contains(lower(text), 'tion') AND contains(lower(text), 'the') AS passed FROM documents JOIN labels USING (doc_id)")
def judge_legacy(spark, sf_dir):
    d = src.read_table(spark, sf_dir, "documents").join(src.read_table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", evaluation.legacy_check(F.col("quality") == 1, F.col("text"), F.array(F.lit("tion"), F.lit("The")), F.lit(True)).alias("passed"))


@query(
    "judge_structured",
    r"""WITH n AS (SELECT doc_id, toxic, n_chars, list_filter(list_transform(regexp_extract_all(text || ' ' || n_chars, '-?[\d,]+\.?\d*'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL) AS nums FROM documents JOIN labels USING (doc_id)),
e AS (SELECT *, list_min(list_transform(nums, lambda x: abs(x - n_chars * 1.005e0) / greatest(abs(n_chars * 1.005e0), 1e-9))) AS err FROM n)
SELECT doc_id, round(err, 6) AS rel_error, err IS NOT NULL AND err <= 0.01e0 AND toxic = 0 AS passed FROM e""",
)
def judge_structured(spark, sf_dir):
    d = src.read_table(spark, sf_dir, "documents").join(src.read_table(spark, sf_dir, "labels"), "doc_id")
    error = evaluation.closest_error(evaluation.numbers_in(F.concat_ws(" ", "text", F.col("n_chars").cast("string"))), F.col("n_chars") * 1.005)
    periods, got = F.array(F.lit("2023")), F.when(F.col("toxic") == 0, F.array(F.lit("2023"), F.lit("2022"))).otherwise(F.array(F.lit("2022")))
    judged = d.withColumn("err", error)
    return judged.select("doc_id", F.round("err", 6).alias("rel_error"), evaluation.structured_check(periods, got, F.col("err"), F.lit(0.01), F.lit("lookup"), F.lit("step_trace")).alias("passed"))


_RESULTS = "WITH r AS (SELECT d.source AS category, d.lang AS difficulty, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS outcome, CAST(n_chars AS DOUBLE) AS latency_ms FROM documents d JOIN labels USING (doc_id))"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.read_table(spark, sf_dir, "documents").join(src.read_table(spark, sf_dir, "labels"), "doc_id")
    outcome = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "pass").otherwise("fail")
    return d.select(F.col("source").alias("category"), F.col("lang").alias("difficulty"), outcome.alias("outcome"), F.col("n_chars").cast("double").alias("latency_ms"))


@query("run_summary", _RESULTS + " SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(outcome = 'pass') AS BIGINT) AS n_pass, CAST(count_if(outcome = 'fail') AS BIGINT) AS n_fail, CAST(count_if(outcome = 'error') AS BIGINT) AS n_error, round(avg(CASE WHEN outcome = 'error' THEN 0e0 ELSE latency_ms END), 2) AS avg_latency_ms, round(count_if(outcome = 'pass') / count(*), 4) AS pass_rate FROM r")
def run_summary(spark, sf_dir):
    return evaluation.run_summary(_results(spark, sf_dir), [])


@query("report_rollup", _RESULTS + " SELECT category, difficulty, count(*) AS total, CAST(count_if(outcome = 'pass') AS BIGINT) AS n_pass, round(count_if(outcome = 'pass') / count(*), 4) AS pass_rate FROM r GROUP BY ROLLUP (category, difficulty)")
def report_rollup(spark, sf_dir):
    return evaluation.report(_results(spark, sf_dir), "category", "difficulty")


_WINDOWED = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"


@query("events_windowed", _WINDOWED)
def events_windowed(spark, sf_dir):
    from ..streaming.events import windowed

    return windowed(src.read_table(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("events_stream", _WINDOWED)
def events_stream(spark, sf_dir):
    """The same by Structured Streaming, from the file as it arrives to the last state of each window."""
    from ..streaming.events import run_once

    counted = run_once(spark, sf_dir, f"{work_dir(spark)}/events-{uuid.uuid4().hex}", "windows", "events.parquet")
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "events_sliding",
    "SELECT window_start, event_type, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, value FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, event_type, value FROM events) GROUP BY 1, 2",
)
def events_sliding(spark, sf_dir):
    """Two hours wide, one hour apart."""
    from ..streaming.events import windowed

    return windowed(src.read_table(spark, sf_dir, "events"), "2 hours", "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "events_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM n GROUP BY user_id, k""",
)
def events_sessions(spark, sf_dir):
    from ..streaming.events import sessions

    found = sessions(src.read_table(spark, sf_dir, "events"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
