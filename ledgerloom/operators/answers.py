"""From plans and facts to answers, for all questions and entities in one job.

``needs`` holds one row for each operand of a plan (question, entity, concept, period); repairs
rewrite its ``use_concept`` and ``use_period``; composing aggregates the operands of a plan, which are
a few, into its result, status and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.concepts import equivalent

MAX_ITERATIONS = 3


def needs(plans: DataFrame, entities: DataFrame) -> DataFrame:
    """question_id, entity, c_ord, concept, p_ord, period_end; a plan without periods or concepts has none."""
    rows = plans.select("question_id", F.posexplode("required_concepts").alias("c_ord", "concept"), "periods").select("question_id", "c_ord", "concept", F.posexplode("periods").alias("p_ord", "period_end"))
    # The stated questions meet all entities block by block: an equi-join on the block's number.
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = entities.withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int"))
    return dealt.join(asked, "block").drop("block").withColumn("use_concept", F.col("concept")).withColumn("use_period", F.col("period_end"))


def _found(rows: DataFrame, facts: DataFrame) -> DataFrame:
    have = facts.groupBy("entity", F.col("concept").alias("use_concept"), F.col("period_end").alias("use_period")).agg(F.min_by("value", "ord").cast("double").alias("value"))
    return rows.join(have, ["entity", "use_concept", "use_period"], "left")


def repair(rows: DataFrame, facts: DataFrame, iterations: int = MAX_ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """Fill missing operands: first an equivalent concept, then the nearest period of the same year.

    Gives the operands with values and a trace (question_id, entity, iteration, action, n_missing).
    An action is tried once; the loop is bounded and only builds the plan.
    """
    current = _found(rows, facts)
    traces = []
    for k, action in enumerate(("none", "swap_concept", "relax_period")[:iterations]):
        bare = F.col("value").isNull()
        if action == "swap_concept":
            current = current.withColumn("use_concept", F.when(bare, F.coalesce(equivalent(F.col("use_concept")), F.col("use_concept"))).otherwise(F.col("use_concept")))
        elif action == "relax_period":
            near = facts.select("entity", F.col("concept").alias("use_concept"), F.col("period_end").alias("near"), F.year("period_end").alias("y")).distinct()
            gone = current.filter(bare).select("entity", "use_concept", "use_period").distinct().withColumn("y", F.year("use_period"))
            best = gone.join(near, ["entity", "use_concept", "y"]).groupBy("entity", "use_concept", "use_period").agg(F.min_by("near", F.struct(F.abs(F.date_diff("near", "use_period")), "near")).alias("near"))
            current = current.join(best, ["entity", "use_concept", "use_period"], "left").withColumn("use_period", F.coalesce("near", "use_period")).drop("near")
        if action != "none":
            current = _found(current.drop("value"), facts)
        traces.append(current.groupBy("question_id", "entity").agg(F.count_if(F.col("value").isNull()).alias("n_missing")).select("question_id", "entity", F.lit(k + 1).alias("iteration"), F.lit(action).alias("action"), "n_missing"))
    trace = traces[0]
    for t in traces[1:]:
        trace = trace.unionByName(t)
    return current, trace


def _value(items: Column, concept: Column, period: Column) -> Column:
    hit = F.filter(items, lambda x: (x["concept"] == concept) & (x["period_end"] == period))
    return F.get(hit, F.lit(0))["value"]


def compose(plans: DataFrame, operands: DataFrame) -> DataFrame:
    """question_id, entity, intent, result, result_period, n_missing, status, text."""
    item = F.struct("c_ord", "p_ord", "concept", "period_end", "value")
    per = operands.groupBy("question_id", "entity").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_items"))
    joined = per.join(plans.select("question_id", "intent", "shape", "periods", "required_concepts", "numerator", "question"), "question_id")
    c = F.col
    first_concept, base, target = F.get("required_concepts", F.lit(0)), F.get("periods", F.lit(0)), F.get("periods", F.size("periods") - 1)
    top, bottom = F.coalesce("numerator", first_concept), F.when(c("numerator").isNotNull(), F.lit("us-gaap:Revenues")).otherwise(F.get("required_concepts", F.lit(1)))
    a, b = _value(c("items"), first_concept, base), _value(c("items"), first_concept, target)
    ranked = F.array_sort(
        F.filter(
            F.transform(
                "periods",
                lambda p: F.struct(
                    (-F.when(c("numerator").isNotNull(), F.try_divide(_value(c("items"), top, p), _value(c("items"), bottom, p))).otherwise(_value(c("items"), first_concept, p))).alias("v"), p.alias("p")
                ),
            ),
            lambda x: x["v"].isNotNull(),
        )
    )
    ratio_first = F.try_divide(_value(c("items"), top, base), _value(c("items"), bottom, base))
    ratio_last = F.try_divide(_value(c("items"), top, target), _value(c("items"), bottom, target))
    minus = _value(c("items"), F.lit("us-gaap:NetCashProvidedByUsedInOperatingActivities"), base) - F.abs(_value(c("items"), F.lit("custom:CapitalExpenditure"), base))
    staged = joined.withColumn("ranked", ranked)
    result = (
        F.when(c("intent") == "pct_change", F.try_divide(b - a, F.abs(a)) * 100)
        .when(c("intent") == "difference", b - a)
        .when((c("intent") == "ratio") & (c("shape") == "comparison"), (ratio_last - ratio_first) * 100)
        .when(c("intent") == "ratio", ratio_first)
        .when(c("intent") == "rank", -F.get("ranked", F.lit(0))["v"])
        .when(c("intent") == "step_trace", minus)
        .otherwise(F.get(F.filter("items", lambda x: x["value"].isNotNull()), F.lit(0))["value"])
    )
    done = staged.withColumn("result", F.round(result, 6)).withColumn("result_period", F.when(c("intent") == "rank", F.get("ranked", F.lit(0))["p"]).otherwise(target))
    status = F.when(c("n_missing") == c("n_items"), "insufficient_evidence").when(c("result").isNull(), "calculation_error").when(c("n_missing") > 0, "partial").otherwise("ok")
    chinese = c("question").rlike("[一-鿿]")
    text = F.when(c("result").isNull(), F.when(chinese, F.lit("证据不足。")).otherwise(F.lit("Insufficient evidence."))).otherwise(
        F.concat(F.when(chinese, F.lit("结果：")).otherwise(F.lit("Result: ")), F.format_number("result", 2))
    )
    return done.withColumn("status", status).select("question_id", "entity", "intent", "result", "result_period", "n_missing", "status", text.alias("text"))
