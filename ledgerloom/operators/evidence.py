"""Evidence: citations, confidence, narrative order and excerpts, values from tables and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CITATIONS, EXCERPT, WINDOW_CHARS, LEAD_IN = 8, 200, 300, 80


def citations(hits: DataFrame, key: str) -> DataFrame:
    """hits (key, chunk_id, rank, text, section_title, page_number) as at most eight citations.

    Repeated excerpts count once; those with page and section come first, then section, then page.
    """
    cut = hits.withColumn("excerpt", F.substring("text", 1, EXCERPT))
    once = cut.groupBy(key, "excerpt").agg(F.min_by(F.struct("chunk_id", "rank", "section_title", "page_number"), F.struct("rank", "chunk_id")).alias("h")).select(key, "excerpt", "h.*")
    page, section = F.col("page_number").isNotNull(), F.col("section_title").isNotNull()
    priority = F.when(page & section, 0).when(section, 1).when(page, 2).otherwise(3)
    w = Window.partitionBy(key).orderBy("priority", "rank", "chunk_id")
    return once.withColumn("priority", priority.cast("bigint")).withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= CITATIONS).select(key, "chunk_id", "priority", "place")


def confidence(n: Column, matched: Column, narrative: Column, has_sections: Column) -> Column:
    base = F.least(n / F.lit(5.0), F.lit(1.0))
    base = F.when(matched, F.least(base + 0.2, F.lit(1.0))).otherwise(base * 0.5)
    return F.round(F.when(narrative & ~has_sections, base * 0.3).otherwise(base), 2)


def status(n: Column, confident: Column) -> Column:
    return F.when(n == 0, "insufficient_evidence").when(confident < 0.5, "partial").otherwise("ok")


def cue_rerank(hits: DataFrame, key: str, cues: list[str], limit: int) -> DataFrame:
    """Order by the number of cues in the text, then by rank."""
    low = F.lower("text")
    n = sum((low.contains(c).cast("bigint") for c in cues), F.lit(0).cast("bigint"))
    w = Window.partitionBy(key).orderBy(F.col("n_cues").desc(), "rank", "chunk_id")
    return hits.withColumn("n_cues", n).withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= limit).select(key, "chunk_id", "n_cues", "place")


def excerpt(text: Column, cues: list[str]) -> Column:
    """300 characters from 80 before the first cue that occurs, in order of the cues."""
    at = F.coalesce(*[F.when(F.lower(text).contains(c), F.instr(F.lower(text), c)) for c in cues], F.lit(1))
    return F.substr(text, F.greatest(F.lit(1), at - LEAD_IN), F.lit(WINDOW_CHARS))


CELL_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"


def cell_value(cell: Column) -> Column:
    """A table cell's number; one in parentheses or after a minus is negative. Numbers without commas are read whole."""
    found = F.replace(F.regexp_extract(cell, f"({CELL_NUMBER})", 1), F.lit(","), F.lit("")).try_cast("double")
    return F.when(F.trim(cell).rlike(r"^\(.*\)$|^-"), -found).otherwise(found)


def table_values(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """First row of each table that names a concept: rows (table_id, row_index, label, cell, scale)
    against aliases (concept, alias); the alias table is a fixed vocabulary and so broadcast."""
    hit = rows.join(F.broadcast(aliases), F.lower("label").contains(F.col("alias")))
    best = hit.groupBy("table_id", "concept").agg(F.min_by(F.struct("row_index", "cell", "scale"), F.struct("row_index", "alias")).alias("h"))
    return best.select("table_id", "concept", F.col("h.row_index").alias("row_index"), (cell_value(F.col("h.cell")) * F.col("h.scale")).alias("value"))
