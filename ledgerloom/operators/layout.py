"""Tables of a page: headers and rows, layout artifacts, captions and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingestion import clean_table

MIN_ROWS, MIN_COLS = 2, 2

#: Titles that lines above financial tables carry.
CAPTIONS = (
    r"Consolidated\s+Balance\s+Sheets?",
    r"Consolidated\s+Statements?\s+of\s+Operations?",
    r"Consolidated\s+Statements?\s+of\s+Comprehensive\s+(?:Income|Loss)",
    r"Consolidated\s+Statements?\s+of\s+(?:Cash\s+Flows?|Stockholders)",
    r"Consolidated\s+Statements?\s+of\s+(?:Redeemable|Equity)",
    r"Notes?\s+to\s+(?:Consolidated\s+)?Financial\s+Statements?",
    r"Schedule\s+of\s+",
    r"Summary\s+of\s+",
)


def caption(page_text: Column, table_index: Column) -> Column:
    """The n-th line of a page that holds a title, the last one for further tables, else empty."""
    lines = F.filter(F.transform(F.split(page_text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("(?i)" + "|".join(CAPTIONS)))
    return F.coalesce(F.get(lines, F.least(table_index, F.size(lines) - 1)), F.lit(""))


def split_table(tables: DataFrame, raw: str) -> DataFrame:
    """``tables`` with headers (the first row left after cleaning) and rows (the others)."""
    cleaned = tables.withColumn("__rows", clean_table(F.coalesce(raw, F.array().cast("array<array<string>>"))))
    return cleaned.withColumn("headers", F.coalesce(F.get("__rows", F.lit(0)), F.array().cast("array<string>"))).withColumn("rows", F.slice("__rows", 2, F.greatest(F.size("__rows"), F.lit(1)))).drop("__rows")


def is_table(headers: Column, rows: Column, min_rows: int = MIN_ROWS) -> Column:
    """Enough rows, and some row or the header with two cells that are not empty."""
    filled = F.transform(F.concat(F.array(headers), rows), lambda r: F.size(F.filter(r, lambda c: c != "")))
    return (F.size(rows) >= min_rows) & (F.array_max(filled) >= MIN_COLS)


def table_text(headers: Column, rows: Column) -> Column:
    return F.array_join(F.transform(F.concat(F.array(headers), rows), lambda r: F.array_join(r, " | ")), "\n")
