"""Ingestion: manifest, incremental state, sections, tables, reconciliation, page checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import numeric_cells, suspicious_cell

#: File names of the raw reports: year, whole year or quarter, form.
FILE_NAME = r"^[A-Za-z]+_(\d{4})_(全年|Q[1-3])_(10-K|10-Q)\.pdf$"
ITEM = r"(?i)^\s*item\s+\d+[a-z]?\b"
TOC_ITEMS = 5
TOLERANCE = 0.01


def scan_raw_directory(spark: SparkSession, path: str) -> DataFrame:
    """fiscal_year, fiscal_quarter, form, path of each report file below ``path`` (names only are read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path")
    return parse_file_names(files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("name", F.url_decode("name")))


def parse_file_names(files: DataFrame) -> DataFrame:
    part = F.regexp_extract("name", FILE_NAME, 2)
    return files.filter(F.col("name").rlike(FILE_NAME)).select(
        F.regexp_extract("name", FILE_NAME, 1).cast("bigint").alias("fiscal_year"),
        F.when(part.startswith("Q"), F.substring(part, 2, 1).cast("bigint")).alias("fiscal_quarter"),
        F.regexp_extract("name", FILE_NAME, 3).alias("form"),
        F.col("path"),
    )


def manifest(spark: SparkSession, local: DataFrame, years: range) -> DataFrame:
    """The target grid with what is there: available or downloadable."""
    grid = spark.range(years.start, years.stop).select(F.col("id").alias("fiscal_year"), F.explode(F.array(F.lit(None).cast("bigint"), *[F.lit(q).cast("bigint") for q in (1, 2, 3)])).alias("fiscal_quarter"))
    grid = grid.withColumn("form", F.when(F.col("fiscal_quarter").isNull(), "10-K").otherwise("10-Q"))
    found = local.groupBy(F.col("fiscal_year").alias("y"), F.col("fiscal_quarter").alias("q"), F.col("form").alias("f")).agg(F.min("path").alias("source_path"))
    on = (F.col("fiscal_year") == F.col("y")) & F.col("fiscal_quarter").eqNullSafe(F.col("q")) & (F.col("form") == F.col("f"))
    return grid.join(found, on, "left").select("fiscal_year", "fiscal_quarter", "form", F.when(F.col("source_path").isNotNull(), "available").otherwise("downloadable").alias("status"), "source_path")


def reuse_plan(current: DataFrame, state: DataFrame) -> DataFrame:
    """doc_id, reason: unchanged documents are reused, the others are parsed again."""
    old = state.select(F.col("doc_id").alias("d"), F.col("fingerprint").alias("old_print"), F.col("source_path").alias("old_path"))
    reason = (
        F.when(F.col("d").isNull(), "missing_state")
        .when(~F.col("source_path").eqNullSafe(F.col("old_path")), "source_path_changed")
        .when(~F.col("fingerprint").eqNullSafe(F.col("old_print")), "source_changed")
        .otherwise("unchanged")
    )
    return current.join(old, F.col("doc_id") == F.col("d"), "left").select("doc_id", reason.alias("reason"))


def stale(current: DataFrame, state: DataFrame) -> DataFrame:
    return state.select("doc_id").join(current.select("doc_id"), "doc_id", "left_anti")


def lines_of(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    return pages.select(*key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def sections(lines: DataFrame, doc: str, heading: Column) -> DataFrame:
    """Gaps and islands: lines (doc, line_no, line) into sections at headings; before the first, Preamble."""
    w = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("is_heading", heading.cast("bigint")).withColumn("section_id", F.sum("is_heading").over(w))
    return marked.groupBy(doc, "section_id").agg(
        F.coalesce(F.min_by(F.when(F.col("is_heading") == 1, F.col("line")), "line_no"), F.lit("Preamble")).alias("title"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.length("line")).alias("n_chars"),
    )


def carry_forward(pages: DataFrame, doc: str, order: str, title: str) -> DataFrame:
    """Each page's section title, or that of the last page that had one."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pages.withColumn("section_title", F.last(title, ignorenulls=True).over(w))


def is_toc(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(ITEM))) >= TOC_ITEMS


def page_fallback(text: Column, n_tables: Column) -> Column:
    """Why a page needs the fallback parser, else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) == 0, "empty_text").when((F.length(t) < 20) & (n_tables == 0), "insufficient_text")


def clean_table(raw: Column) -> Column:
    """Rows of cells: white space collapsed, empty rows dropped."""
    rows = F.transform(raw, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def dedupe_headers(headers: DataFrame) -> DataFrame:
    """headers (table_id, col, name): repeated names of a table get their number."""
    k = F.row_number().over(Window.partitionBy("table_id", "name").orderBy("col"))
    numbered = headers.withColumn("k", k)
    return numbered.select("table_id", "col", F.when(F.col("k") > 1, F.concat("name", F.lit(" ("), "k", F.lit(")"))).otherwise(F.col("name")).alias("name"))


def validate_cells(cells: DataFrame) -> DataFrame:
    """cells (.., raw_value): value, detail and status of each."""
    digits = F.regexp_count("raw_value", F.lit(r"\d")) >= 2
    suspect = (F.col("detail") == "non_numeric") & digits & suspicious_cell(F.col("raw_value")).isNotNull()
    return numeric_cells(cells, "raw_value").withColumn("status", F.when(F.col("detail").startswith("parse_failed"), "failed").when(suspect, "suspect").otherwise("valid"))


def table_status(validated: DataFrame, key: list[str]) -> DataFrame:
    """The worst status of each table."""
    severity = F.when(F.col("status") == "failed", 2).when(F.col("status") == "suspect", 1).otherwise(0)
    worst = validated.groupBy(*key).agg(F.max(severity).alias("s"), F.count(F.lit(1)).alias("n_cells"))
    return worst.select(*key, "n_cells", F.when(F.col("s") == 2, "failed").when(F.col("s") == 1, "suspect").otherwise("valid").alias("table_status"))


def diagnostics(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """One row of counters: pages (fallback_reason, failed) and tables (table_status) of an ingestion."""
    counted = pages.agg(F.count_if(F.col("fallback_reason").isNotNull()).alias("fallback_pages"), F.count_if("failed").alias("failed_pages"))
    judged = tables.agg(*[F.count_if(F.col("table_status") == s).alias(f"validation_{s}_tables") for s in ("failed", "suspect")])
    return counted.crossJoin(judged)  # one row each


def reconcile(cells: DataFrame, facts: DataFrame, labels: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Table values against facts whose label the header contains, for the same entity and period.

    cells (table_id, entity, period_end, header, value), labels (concept, label). The label table is
    a fixed vocabulary, so the substring join broadcasts it; the join with facts is an equi-join.
    """
    named = cells.join(F.broadcast(labels), F.lower("header").contains(F.lower("label")))
    both = named.join(facts.select("entity", "period_end", "concept", F.col("value").cast("double").alias("fact_value")), ["entity", "period_end", "concept"])
    gap = F.abs(F.col("value") - F.col("fact_value")) / F.greatest(F.abs("fact_value"), F.lit(1e-9))
    return both.select("table_id", "entity", "period_end", "concept", F.round("value", 4).alias("table_value"), F.round("fact_value", 4).alias("fact_value"), (gap <= tolerance).alias("matched"))


def companyfacts(spark: SparkSession, path: str, min_fy: int = 2021, namespaces: tuple[str, ...] = ("us-gaap", "dei")) -> DataFrame:
    """Facts of a company-facts JSON file: namespace, concept, unit and entries flattened and filtered."""
    entry = "array<struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>>"
    schema = f"cik long, entityName string, facts map<string,map<string,struct<label:string,description:string,units:map<string,{entry}>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    flat = (
        raw.select("entityName", F.explode("facts").alias("namespace", "concepts"))
        .filter(F.col("namespace").isin(list(namespaces)))
        .select("entityName", "namespace", F.explode("concepts").alias("name", "body"))
        .select("entityName", "namespace", "name", F.col("body.label").alias("label"), F.explode("body.units").alias("unit", "entries"))
        .select("entityName", "namespace", "name", "label", "unit", F.posexplode("entries").alias("pos", "e"))
    )
    kept = flat.filter(
        F.col("e.form").isin("10-K", "10-Q") & (F.col("e.fy") >= min_fy) & F.col("e.fp").isin("FY", "Q1", "Q2", "Q3", "Q4") & F.col("e.val").isNotNull() & F.col("e.end").isNotNull()
    )
    return kept.select(
        F.col("entityName").alias("entity"),
        F.concat_ws(":", "namespace", "name").alias("concept"),
        "label",
        "unit",
        F.col("e.val").alias("value"),
        F.try_to_date("e.start", "yyyy-MM-dd").alias("period_start"),
        F.try_to_date("e.end", "yyyy-MM-dd").alias("period_end"),
        F.col("e.start").isNull().alias("is_instant"),
        F.col("e.fy").alias("fiscal_year"),
        F.when(F.col("e.fp").isin("Q1", "Q2", "Q3"), F.substring("e.fp", 2, 1).cast("int")).alias("fiscal_quarter"),
        "pos",
    )
