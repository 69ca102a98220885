"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATIN = "[a-z0-9]+(?:[-'][a-z0-9]+)*"
CJK = "[一-鿿]+"


def tokens(text: Column) -> Column:
    """Lower-case ASCII words; then each run of CJK characters and its overlapping pairs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    pairs = F.transform(
        runs,
        lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.concat(F.array(r), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))),
    )
    return F.concat(F.regexp_extract_all(low, F.lit(LATIN), F.lit(0)), F.flatten(pairs))


#: What may surround a number, its magnitude marks, and what OCR gets wrong.
STRIP = r"^[\s$€£¥]+|[\s$€£¥]+$"
CANDIDATE = r"^[\s$€£¥()\-−–—+,.\d%kKmMbBnNtT]+$"
SCALES = {"k": 1e3, "m": 1e6, "mm": 1e6, "b": 1e9, "bn": 1e9, "t": 1e12}
SUSPICIOUS = (r"[Il][0-9]", r"[0-9][Oo][0-9]", r"[0-9][Ss][0-9]", r"\b[A-Za-z]+\d+[A-Za-z]+\b")
DASHES = ("-", "−", "–", "—")


def numeric_cells(rows: DataFrame, raw: str, value: str = "value", detail: str = "detail") -> DataFrame:
    """``rows`` plus a table cell's number and how it was read.

    Built in named steps: one nested expression would repeat its parts beyond what compiles.
    """
    c = F.col
    scale = F.lit(1.0)
    for suffix, factor in SCALES.items():
        scale = F.when(c("__mark") == suffix, F.lit(factor)).otherwise(scale)
    name = F.lit("ok")
    for factor, label in ((1e3, "scaled_1000"), (1e6, "scaled_1e+06"), (1e9, "scaled_1e+09"), (1e12, "scaled_1e+12")):
        name = F.when(c("__scale") == factor, label).otherwise(name)
    steps: list[tuple[str, Column]] = [
        ("__text", F.trim(F.coalesce(c(raw), F.lit("")))),
        ("__bare", F.regexp_replace(F.replace("__text", F.lit("%"), F.lit("")), STRIP, "")),
        ("__paren", c("__bare").rlike(r"^\(.*\)$")),
        ("__inner", F.when(c("__paren"), F.regexp_replace(F.regexp_replace("__bare", r"^\(|\)$", ""), STRIP, "")).otherwise(c("__bare"))),
        ("__minus", c("__inner").rlike("^[-−–]")),
        ("__body", F.trim(F.when(c("__minus"), F.regexp_replace("__inner", "^.", "")).otherwise(c("__inner")))),
        ("__mark", F.lower(F.regexp_extract("__body", r"^[\d,.]+\s*(?i)(mm|bn|[kmbt])\s*$", 1))),
        ("__scale", scale),
        ("__digits", F.replace(F.when(c("__mark") != "", F.regexp_extract("__body", r"^([\d,.]+)", 1)).otherwise(c("__body")), F.lit(","), F.lit(""))),
        ("__number", F.when(c("__digits").rlike(r"^[+]?(\d+\.?\d*|\.\d+)$"), c("__digits")).try_cast("double")),
        ("__signed", F.when(c("__paren") | c("__minus"), -c("__number")).otherwise(c("__number")) * c("__scale")),
        (
            detail,
            F.when(c("__text") == "", "empty")
            .when(~c("__text").rlike(CANDIDATE), "non_numeric")
            .when(c("__bare") == "", "empty_after_strip")
            .when(c("__bare").isin(*DASHES), "dash_zero")
            .when(c("__digits") == "", "empty_after_clean")
            .when(c("__number").isNull(), F.concat(F.lit("parse_failed: '"), c(raw), F.lit("'")))
            .when(c("__text").contains("%"), "percent")
            .otherwise(name),
        ),
        (
            value,
            F.when(c(detail) == "dash_zero", F.lit(0.0)).when(c(detail) == "percent", c("__signed") / 100.0).when((c(detail) == "ok") | c(detail).startswith("scaled_"), c("__signed")),
        ),
    ]
    out = rows
    for step, made in steps:
        out = out.withColumn(step, made)
    return out.drop(*[n for n, _ in steps if n.startswith("__")])


def suspicious_cell(raw: Column) -> Column:
    """Number (from 1) of the first OCR pattern that a cell shows, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for k, p in enumerate(SUSPICIOUS, 1):
        out = out.when(raw.rlike(p), F.lit(k))
    return out.cast("bigint")


def table_scale(text: Column) -> Column:
    """1e6, 1e3 or 1e9 for 'in millions', 'in thousands', 'in billions', in that precedence, else 1."""
    low = F.lower(text)
    return F.when(low.contains("in millions"), 1_000_000).when(low.contains("in thousands"), 1_000).when(low.contains("in billions"), 1_000_000_000).otherwise(1).cast("bigint")
