"""Evidence linking: facts and tables of the periods in question, and values read from tables or text
where a fact is missing.

Works on many questions or entities at once. Vocabularies of concepts are fixed and small, so they are
broadcast; everything else meets by equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.concepts import spaced
from ..functions.text import table_scale
from .evidence import CELL_NUMBER, cell_value

#: How reports write concepts that are often missing from tagged facts.
TABLE_ALIASES = {
    "us-gaap:CostOfGoodsAndServicesSold": ["cost of automotive revenue", "cost of revenue", "cost of goods sold", "cost of automotive sales", "cost of revenues"],
    "us-gaap:ResearchAndDevelopmentExpense": ["research and development", "r&d"],
    "us-gaap:SellingGeneralAndAdministrativeExpense": ["selling, general and administrative", "selling general and administrative", "sg&a"],
}
COST_OF_GOODS, COST_OF_REVENUE = "us-gaap:CostOfGoodsAndServicesSold", "us-gaap:CostOfRevenue"
#: A text names its periods in one of its first lines.
HEADER_LINES = 12
YEAR = r"(?:19|20)\d{2}"


def vocabulary(spark: SparkSession, concepts: list[str], more: dict[str, list[str]] | None = None, automotive: bool = False) -> DataFrame:
    """concept, aliases (in order of preference), words (the concept's own name).

    A concept without aliases is known by its name. Within the automotive scope the cost of goods goes
    by its automotive aliases only.
    """
    known = TABLE_ALIASES | (more or {})
    rows = []
    for c in concepts:
        found = known.get(c, [])
        if automotive and c == COST_OF_GOODS:
            found = [a for a in found if "automotive" in a] or found
        rows.append((c, [a.lower() for a in found]))
    words = spaced(F.element_at(F.split("concept", ":"), -1))
    named = spark.createDataFrame(rows, "concept string, aliases array<string>").withColumn("words", words)
    return named.withColumn("aliases", F.when(F.size("aliases") == 0, F.array("words")).otherwise(F.col("aliases")))


def relevant_periods(hits: DataFrame, filings: DataFrame, required: DataFrame) -> DataFrame:
    """query_id, period_end: the periods of the retrieved chunks (query_id, doc_id) and the required ones."""
    of_hits = hits.join(filings.select("doc_id", "period_end"), "doc_id").select("query_id", "period_end")
    return of_hits.unionByName(required.select("query_id", "period_end")).distinct()


def linked_facts(periods: DataFrame, facts: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """The facts of each question's periods; with concepts (query_id, concept) only those, once each."""
    asked = periods if concepts is None else periods.join(concepts, "query_id")
    return asked.join(facts, ["period_end"] if concepts is None else ["period_end", "concept"])


def mentions(searchable: Column) -> Column:
    """Whether lower-case text names the concept of a vocabulary row, by alias or name, singular or plural."""
    single = F.col("words").endswith("s") & searchable.contains(F.regexp_replace("words", "s$", ""))
    return F.exists("aliases", lambda a: searchable.contains(a)) | searchable.contains(F.col("words")) | single


def linked_tables(tables: DataFrame, periods: DataFrame, concepts: DataFrame, words: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, table_id, score 0.0: tables of the periods that name a wanted concept and were not retrieved."""
    text = F.lower(F.concat_ws(" ", "caption", F.array_join("headers", " "), F.flatten("rows")))
    named = tables.join(F.broadcast(words), mentions(text)).select("table_id", "period_end", "concept")
    wanted = periods.join(concepts, "query_id")
    found = named.join(wanted, ["period_end", "concept"]).select("query_id", "table_id").distinct()
    return found.join(hits.select("query_id", "table_id"), ["query_id", "table_id"], "left_anti").withColumn("score", F.lit(0.0))


def first_alias(text: Column) -> Column:
    return F.get(F.filter("aliases", lambda a: text.contains(a)), F.lit(0))


def alias_rows(tables: DataFrame, words: DataFrame) -> DataFrame:
    """Each table row that names a concept, by its label before its whole text, with the alias found."""
    rows = tables.select("table_id", "entity", F.col("period_end").alias("table_end"), "ord", table_scale(F.concat_ws(" ", "caption", F.array_join("headers", " "))).alias("scale"), "headers", F.get("rows", F.lit(0)).alias("top"), F.posexplode_outer("rows").alias("row_index", "cells"))
    low = rows.withColumn("label", F.lower(F.trim(F.get("cells", F.lit(0))))).withColumn("line", F.lower(F.array_join(F.transform("cells", lambda x: F.trim(x)), " ")))
    named = low.join(F.broadcast(words), F.exists("aliases", lambda a: F.col("line").contains(a)))
    return named.withColumn("alias", F.coalesce(first_alias(F.col("label")), first_alias(F.col("line")))).drop("label", "line", "aliases", "words")


def column_for_year(headers: Column, top: Column, year: Column) -> Column:
    """Index of a row's cell for a year: headers leave out the label's column, a first row has it."""
    in_headers = F.array_position(F.transform(headers, lambda h: h.contains(year)), F.lit(True))
    in_top = F.array_position(F.transform(top, lambda h: h.contains(year)), F.lit(True))
    return F.when(in_headers > 0, in_headers).when(in_top > 0, in_top - 1).cast("int")


def table_fallback(missing: DataFrame, tables: DataFrame, words: DataFrame) -> DataFrame:
    """missing (entity, period_end, concept) from tables (table_id, entity, period_end, ord, caption,
    headers, rows): the year's column of the first row that names the concept, or that row's only number.

    Tables of the period come first, then all others in order. Missing facts without a value have no row.
    """
    rows = alias_rows(tables, words)
    both = missing.select("entity", "period_end", "concept").distinct().withColumn("year", F.year("period_end").cast("string")).join(rows, ["entity", "concept"])
    numbers = F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("column_index"), cell_value(c).alias("raw_value"))), lambda x: (x["column_index"] > 0) & x["raw_value"].isNotNull())
    both = both.withColumn("at", column_for_year(F.col("headers"), F.col("top"), F.col("year"))).withColumn("numbers", numbers)
    aimed = F.struct(F.col("at").alias("column_index"), cell_value(F.get("cells", F.col("at"))).alias("raw_value"))
    both = both.withColumn("aimed", aimed).withColumn("found", F.when(F.col("aimed.raw_value").isNotNull(), F.col("aimed")).when(F.size("numbers") == 1, F.get("numbers", F.lit(0))))
    place = F.struct((F.col("table_end") != F.col("period_end")).alias("other"), "ord", "table_id", "row_index")
    best = both.filter("found IS NOT NULL").groupBy("entity", "period_end", "concept").agg(F.min_by(F.struct("table_id", "row_index", "alias", "scale", "found.column_index", "found.raw_value"), place).alias("b"))
    return best.select("entity", "period_end", "concept", "b.*").withColumn("value", F.col("raw_value") * F.col("scale"))


def text_fallback(missing: DataFrame, sections: DataFrame, words: DataFrame) -> DataFrame:
    """The same from section texts (chunk_id, entity, ord, text) in order: the number in a line with an
    alias that stands where the year stands in one of the first lines, or the line's only number."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cut = sections.select("chunk_id", "entity", "ord", table_scale(F.col("text")).alias("scale"), lines.alias("lines"))
    years = F.filter(F.transform(F.slice("lines", 1, HEADER_LINES), lambda x: F.regexp_extract_all(x, F.lit(YEAR), F.lit(0))), lambda y: F.size(y) > 0)
    rows = cut.withColumn("years", years).select("chunk_id", "entity", "ord", "scale", "years", F.posexplode_outer("lines").alias("line_no", "line"))
    named = rows.join(F.broadcast(words), F.exists("aliases", lambda a: F.lower("line").contains(a)))
    numbers = F.transform(F.regexp_extract_all("line", F.lit(f"({CELL_NUMBER})"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    named = named.withColumn("alias", first_alias(F.lower("line"))).withColumn("numbers", numbers).drop("aliases", "words", "line")
    both = missing.select("entity", "period_end", "concept").distinct().withColumn("year", F.year("period_end").cast("string")).join(named, ["entity", "concept"])
    at = F.array_position(F.get(F.filter("years", lambda y: F.array_contains(y, F.col("year"))), F.lit(0)), F.col("year")) - 1
    both = both.withColumn("at", at.cast("int"))
    only = F.size("numbers") == 1
    index = F.when(F.col("at") < F.size("numbers"), F.col("at")).when(only, F.lit(0))
    both = both.withColumn("column_index", index).filter("column_index IS NOT NULL").withColumn("raw_value", F.get("numbers", F.col("column_index")))
    best = both.groupBy("entity", "period_end", "concept").agg(F.min_by(F.struct("chunk_id", "line_no", "alias", "scale", "column_index", "raw_value"), F.struct("ord", "chunk_id", "line_no")).alias("b"))
    return best.select("entity", "period_end", "concept", "b.*").withColumn("value", F.col("raw_value") * F.col("scale"))


def fill(missing: DataFrame, tables: DataFrame, sections: DataFrame, words: DataFrame) -> DataFrame:
    """Values for missing facts: from tables, else from text; source_kind says which."""
    kept = ("entity", "period_end", "concept", "alias", "scale", "raw_value", "value")
    by_table = table_fallback(missing, tables, words).select(*kept, F.lit("table").alias("source_kind"), F.lit(0).alias("turn"))
    by_text = text_fallback(missing, sections, words).select(*kept, F.lit("section_text").alias("source_kind"), F.lit(1).alias("turn"))
    best = by_table.unionByName(by_text).groupBy("entity", "period_end", "concept").agg(F.min_by(F.struct(*kept[3:], "source_kind"), "turn").alias("b"))
    return best.select("entity", "period_end", "concept", "b.*")


def period_coverage(required: DataFrame, facts: DataFrame, automotive: bool = False) -> DataFrame:
    """required (entity, period_end, concept) against facts: what each entity and period has and lacks.

    The cost of revenue stands in for the cost of goods, but not within the automotive scope.
    """
    have = facts.select("entity", "period_end", "concept")
    counts = have.groupBy("entity", "period_end").agg(F.count(F.lit(1)).alias("fact_count"))
    if not automotive:
        have = have.unionByName(have.filter(F.col("concept") == COST_OF_REVENUE).withColumn("concept", F.lit(COST_OF_GOODS)))
    found = required.distinct().join(have.distinct().withColumn("found", F.lit(1)), ["entity", "period_end", "concept"], "left")

    def listed(c: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("concept")))), ",")

    per = found.groupBy("entity", "period_end").agg(F.count("found").alias("concept_count"), listed(F.col("found").isNotNull()).alias("matched_concepts"), listed(F.col("found").isNull()).alias("missing_concepts"))
    return per.join(counts, ["entity", "period_end"], "left").withColumn("fact_count", F.coalesce("fact_count", F.lit(0))).withColumn("has_required", F.col("missing_concepts") == "")
