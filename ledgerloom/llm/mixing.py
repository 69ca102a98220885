"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies (its source's target over its source's size).
Within a source, documents in order of (size, id) prefix-sum these expectations; with one random
offset, a document is emitted once for each integer boundary that its interval crosses. The order
by size makes what a source yields differ from its target by about one document at most.

Defined results: a null text has size 0, as has an empty one, and may be taken at no cost; null
sources are a source of their own, last in order; rows equal in (source, size, id) are
interchangeable, so reruns agree; a corpus without words has targets 0; extra columns are kept by
``emit_mix`` and ignored by ``mix_plan``; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, n_words, running_totals

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
#: Expected copies are counted in units of 2**-24, so that sums are exact integers.
UNIT_BITS = 24
SEED = "mix-1"


def _offset(source: Column, seed: str) -> Column:
    """One pseudo-random offset below a unit for each source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit(""))).cast("binary")), 1, 6), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, n_docs, source_size, target: ``share`` of all sizes dealt by cyclic weights.

    No target is above ``max_repeat`` times its source's size; the excess is dealt again by weight.
    The fixed point of that is min(cap, level * weight) for one level, found from running sums over
    sources in order of cap / weight. Sources are never collected.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_totals(per, [F.col("source").asc_nulls_last()], ["one"], "sources")
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int")).cast("long")
    capped = (
        ranked.withColumn("weight", cycle)
        .withColumn("cap", F.col("source_size") * max_repeat)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .select("source", "n_docs", "source_size", "weight", "cap", "ratio")
    )
    filled = running_totals(capped, [F.col("ratio"), F.col("source").asc_nulls_last()], ["cap", "weight"], "levels")
    whole = filled.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = (F.col("all_size") * F.lit(float(share)) - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    levels = filled.crossJoin(F.broadcast(whole)).withColumn("level", level)
    # Beyond the first source whose level fits below its ratio, every source has that level.
    first = levels.filter("level <= ratio").agg(F.min_by("level", F.struct("ratio", F.col("source").isNull(), "source")).alias("at"))
    return (
        filled.crossJoin(F.broadcast(first))
        .withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight")), F.col("cap").cast("double")))
        .select("source", "n_docs", "source_size", "target")
    )


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_repeat: int = MAX_REPEAT,
    seed: str = SEED,
    row_col: str | None = None,
) -> DataFrame:
    """doc_id, size, source, source_size, target, copies for every row of ``docs``.

    ``row_col`` names a column that tells equal rows apart, if the caller needs it back.
    """
    keep = [F.col(row_col).alias("row")] if row_col else []
    slim = docs.select(F.col(id_col).alias("doc_id"), n_words(text_col).alias("size"), F.col(source_col).alias("source"), *keep)
    sizes = materialize(slim, "sizes")
    targets = materialize(source_targets(sizes, weights, share, max_repeat), "targets")
    unit = float(1 << UNIT_BITS)
    rates = targets.withColumn(
        "e", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(unit))).otherwise(F.lit(0)).cast("long")
    ).withColumnRenamed("source", "source_key")
    with_e = sizes.join(rates, F.col("source").eqNullSafe(F.col("source_key"))).drop("source_key")
    ran = running_totals(with_e, [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")], ["e"], "copies")
    starts = ran.groupBy("source").agg(F.min("e_before").alias("start")).withColumnRenamed("source", "start_key")
    at = F.col("e_before") - F.col("start") + _offset(F.col("source"), seed)
    crossed = F.shiftright(at + F.col("e"), UNIT_BITS) - F.shiftright(at, UNIT_BITS)
    return ran.join(starts, F.col("source").eqNullSafe(F.col("start_key"))).select(
        "doc_id", "size", "source", "source_size", "target", crossed.cast("long").alias("copies"), *(["row"] if row_col else [])
    )


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (all columns kept)."""
    row, copies, copy = (fresh(docs, c) for c in ("__mix_row", "__mix_copies", "__mix_copy"))
    marked = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix")
    plan = mix_plan(marked, row_col=row, **options).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    return marked.join(plan, row).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


#: The same plan for DuckDB over a relation ``src`` (doc_id, text, source).
MIX_SQL = r"""
sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM src),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sizes GROUP BY source),
capped AS (SELECT source, source_size, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM per),
filled AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM capped),
levels AS (SELECT *, row_number() OVER o AS pos,
  (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 - CAST(sum(cap) OVER o - cap AS DOUBLE)) / CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS DOUBLE) AS level
  FROM filled WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
first_level AS (SELECT arg_min(level, pos) AS lev FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), lev * weight), CAST(cap AS DOUBLE)) AS target FROM levels, first_level),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216e0) AS BIGINT) ELSE 0 END AS e,
  CAST(('0x' || substr(md5('mix-1' || coalesce(source, '')), 1, 6)) AS BIGINT) AS u FROM targets),
ranked AS (SELECT s.doc_id, s.size, r.source_size, r.target, r.e, r.u,
  row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS k
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
mixed AS (SELECT doc_id, size, source_size, target, ((u + (k + 1) * e) >> 24) - ((u + k * e) >> 24) AS copies FROM ranked)
"""
