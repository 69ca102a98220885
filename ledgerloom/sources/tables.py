"""The data model as DataFrames: filings, facts, chunks, vectors and questions.

Facts are long-format (entity, concept, period) rows with decimal values, so sums do not depend on
the order of rows. ``ord`` is the order in which facts were filed; whoever comes first wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVENUE = "us-gaap:Revenues"
COST = "us-gaap:CostOfRevenue"
GROSS = "us-gaap:GrossProfit"
OPERATING = "us-gaap:OperatingIncomeLoss"
CASH_FLOW = "us-gaap:NetCashProvidedByOperatingActivities"
PPE = "us-gaap:PaymentsToAcquirePropertyPlantAndEquipment"
CASH = "us-gaap:CashAndCashEquivalentsAtCarryingValue"
#: In the order in which a filing lists them.
CONCEPTS = (REVENUE, COST, GROSS, OPERATING, CASH_FLOW, PPE, CASH)


#: Tables whose rows are long texts: reading them is cheap, working on them is not.
TEXT_TABLES = ("documents", "pages", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a few large row groups to all cores.

    A file with one row group is one task, however many cores there are. Only inputs of fewer files
    than cores are looked at (their footers tell); larger ones are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def quarter_end(year: Column, quarter: Column) -> Column:
    """Last day of a fiscal quarter (calendar years)."""
    return F.last_day(F.make_date(year.cast("int"), (quarter * 3).cast("int"), F.lit(1)))


def filing_period(doc_id: Column) -> tuple[Column, Column, Column]:
    """fiscal year, fiscal quarter (null for the annual report) and period end of a document's filing."""
    year, q = (F.lit(2021) + F.floor(doc_id / 4) % 5).cast("int"), (doc_id % 4).cast("int")
    return year, F.when(q > 0, q), quarter_end(year, F.when(q == 0, F.lit(4)).otherwise(q))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filing for each document: quarter 0 is the annual report."""
    year, quarter, period_end = filing_period(F.col("doc_id"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.when(quarter.isNull(), "10-K").otherwise("10-Q").alias("filing_type"), year.alias("fiscal_year"), quarter.alias("fiscal_quarter"), period_end.alias("period_end"), "source"
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section chunks: the text of each filing under its source as title."""
    docs = read_table(spark, sf_dir, "documents")
    year, _, period_end = filing_period(F.col("doc_id"))
    return docs.select(
        F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("section_title"), "text", period_end.alias("period_end"), year.alias("fiscal_year"),
        F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("bigint").alias("token_count"),
    )


def quarter_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, year, quarter and one decimal column for each concept, in one aggregation."""
    whole = [F.round(F.col(c) * 100).cast("bigint").alias(n) for c, n in (("l_extendedprice", "cents"), ("l_discount", "disc"), ("l_tax", "tax"))]
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *whole)
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("entity"))
    sold = F.col("cents") * (100 - F.col("disc"))

    def money(ten_thousandths: Column) -> Column:
        """Sums run on whole numbers inside generated code and become decimals at the end."""
        return (F.sum(ten_thousandths).cast("decimal(24,0)") / F.lit(10000).cast("decimal(5,0)")).cast("decimal(28,4)")

    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("entity", F.year("day").alias("fiscal_year"), F.quarter("day").alias("q"))
        .agg(
            money(sold).alias("revenue"),
            money(F.col("cents") * F.col("disc")).alias("cost"),
            money(F.when(F.col("l_returnflag") == "N", sold).otherwise(0)).alias("operating"),
            money(F.when(F.col("l_returnflag") != "R", sold).otherwise(0)).alias("cash_flow"),
            money(F.col("cents") * F.col("tax")).alias("tax"),
        )
    )


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filed facts, comparatives of the next annual report (revenue, restated by 1 %) included.

    Quarterly reports cover the first three quarters; the annual report exists only for a year with
    four quarters. Cash is an instant, reported at each quarter's end.
    """
    money = "decimal(28,4)"
    names = ("revenue", "cost", "gross", "operating", "cash_flow", "ppe", "cash")
    wide = quarter_sums(spark, sf_dir).select(
        "entity", "fiscal_year", F.col("q").cast("int").alias("q"), "revenue", "cost", (F.col("revenue") - F.col("cost")).cast(money).alias("gross"), "operating", "cash_flow",
        (-F.col("tax")).cast(money).alias("ppe"), F.col("tax").alias("cash"),
    )
    # A year has four quarters at most, so its reports are built from one row: the join above runs once.
    sums = [F.sum(n).cast(money).alias(n) if n != "cash" else F.sum(F.when(F.col("q") == 4, F.col(n))).cast(money).alias(n) for n in names]
    years = wide.groupBy("entity", "fiscal_year").agg(F.collect_list(F.struct("q", *[F.col(n).cast(money).alias(n) for n in names])).alias("quarters"), *sums)
    annual = F.array(F.struct(F.lit(None).cast("int").alias("q"), *names))
    filed = F.concat(F.filter("quarters", lambda r: r["q"] <= 3), F.when(F.size("quarters") == 4, annual).otherwise(F.slice(annual, 1, 0)))
    reports = years.select("entity", "fiscal_year", F.inline(filed))

    def item(concept: str, k: int, value: Column, again: bool = False) -> Column:
        order = ((F.col("fiscal_year") * 10 + F.coalesce("q", F.lit(4))) * 10 + k + (100 if again else 0)).cast("bigint")
        return F.struct(F.lit(concept).alias("concept"), F.lit(concept == CASH).alias("is_instant"), value.cast(money).alias("value"), order.alias("ord"))

    items = F.array(*[item(c, k, F.col(n)) for k, (c, n) in enumerate(zip(CONCEPTS, names))])
    restated = item(REVENUE, 0, F.col("revenue") * F.lit(101).cast("decimal(4,0)") / F.lit(100).cast("decimal(4,0)"), again=True)
    end = quarter_end(F.col("fiscal_year"), F.coalesce("q", F.lit(4)))
    begin = F.when(F.col("q").isNull(), F.make_date("fiscal_year", F.lit(1), F.lit(1))).otherwise(F.trunc(end, "quarter"))
    rows = F.when(F.col("q").isNull(), F.concat(items, F.array(restated))).otherwise(items)
    return reports.select("entity", "fiscal_year", F.col("q").alias("fiscal_quarter"), begin.alias("begin"), end.alias("period_end"), F.inline(rows)).select(
        "entity", "concept", "fiscal_year", "fiscal_quarter", "is_instant", "value", F.when(~F.col("is_instant"), F.col("begin")).alias("period_start"), "period_end", "ord"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded segments: four consecutive vectors are the segments of one source chunk."""
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 4).cast("bigint").alias("source_chunk_id"), (F.col("vec_id") % 4).cast("bigint").alias("segment_index"),
        F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"),
    )
