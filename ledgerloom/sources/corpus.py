"""The processed corpus on shared storage: writers, replacement by filing, readers and checks.

Tables are Parquet, partitioned by fiscal year; replacing filings overwrites only the partitions they
are in. Paths may be in any store that Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

TABLES = ("manifest", "filings", "chunks", "tables", "facts", "vectors", "state")
PARTITION = "fiscal_year"
FACT_SCHEMA = "entity string, concept string, label string, value double, unit string, scale int, period_start date, period_end date, is_instant boolean, doc_id string"


class CorpusError(RuntimeError):
    """A missing, malformed or inconsistent corpus, with what to do about it."""


def write(df: DataFrame, root: str, name: str) -> None:
    """Overwrite one table of the corpus."""
    w = df.write.mode("overwrite")
    (w.partitionBy(PARTITION) if PARTITION in df.columns else w).parquet(f"{root}/{name}")


def replace_filings(df: DataFrame, root: str, name: str) -> None:
    """Replace the rows of the documents in ``df``; other documents of their partitions stay."""
    spark, path = df.sparkSession, f"{root}/{name}"
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        return write(df, root, name)
    years = df.select(PARTITION).distinct()
    rest = old.join(years, PARTITION, "left_semi").join(df.select("doc_id").distinct(), "doc_id", "left_anti").select(*df.columns)
    # The rest is read from where it will be overwritten, so all is written beside it first. A job lost
    # while it overwrites leaves that copy, and running it again from there completes the table.
    staged = f"{root}/.{name}-{uuid.uuid4().hex}"
    rest.unionByName(df).write.parquet(staged)
    spark.read.schema(old.select(*df.columns).schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def remove_filings(spark: SparkSession, doc_ids: DataFrame, root: str, name: str, target: str) -> None:
    """Write the table without some documents to a new root."""
    write(spark.read.parquet(f"{root}/{name}").join(doc_ids.select("doc_id"), "doc_id", "left_anti"), target, name)


def write_facts_lines(facts: DataFrame, path: str) -> None:
    facts.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_facts_lines(spark: SparkSession, path: str) -> DataFrame:
    """Facts as JSON lines; a malformed line fails the read."""
    return spark.read.schema(FACT_SCHEMA).option("mode", "FAILFAST").json(path)


def present(spark: SparkSession, root: str, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read(spark: SparkSession, root: str, names: tuple[str, ...] = ("filings", "chunks", "facts")) -> dict[str, DataFrame]:
    """The named tables; the first that is missing raises."""
    for name in names:
        if not present(spark, root, name):
            raise CorpusError(f"{name} is missing below {root}: run the ingestion first")
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints of the last run; none yet is an empty state."""
    schema = "doc_id long, fingerprint string, source_path string"
    return spark.read.schema(schema).parquet(f"{root}/state") if present(spark, root, "state") else spark.createDataFrame([], schema)


def vector_rows(segments: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Segments (chunk_id, segment_index, segment_count, text) with their embeddings, one row each; a
    segment without an embedding fails the job."""
    lost = F.raise_error(F.concat(F.lit("no embedding of segment "), F.concat_ws(":", "chunk_id", "segment_index"))).cast("array<double>")
    return segments.join(embeddings, ["chunk_id", "segment_index"], "left").select(
        F.concat_ws(":", "chunk_id", "segment_index").alias("segment_id"), F.col("chunk_id").alias("source_chunk_id"), "segment_index", "segment_count", F.col("text").alias("display_text"),
        F.coalesce("embedding", lost).alias("embedding"),
    )


def check_index(vectors: DataFrame, declared_rows: int, declared_dimensions: int) -> None:
    """An index must have the rows and dimensions that its metadata names."""
    r = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if r["n"] != declared_rows or r["n"] and not r["low"] == r["high"] == declared_dimensions:
        raise CorpusError(f"the index has {r['n']} rows of {r['low']} to {r['high']} dimensions; declared are {declared_rows} of {declared_dimensions}: build it again")


def period_key(fiscal_year: Column, fiscal_quarter: Column) -> Column:
    return F.when(fiscal_quarter.isNull(), F.concat(F.lit("FY"), fiscal_year)).otherwise(F.concat(F.lit("Q"), fiscal_quarter, F.lit("-"), fiscal_year))


def estimated_filing_date(fiscal_year: Column, fiscal_quarter: Column) -> Column:
    """Annual reports on 1 February of the next year, quarterly ones on the 25th of the month after."""
    return F.when(fiscal_quarter.isNull(), F.make_date(fiscal_year + 1, F.lit(2), F.lit(1))).otherwise(F.make_date(fiscal_year, fiscal_quarter * 3 + 1, F.lit(25)))


def stable_id(*parts: Column) -> Column:
    """A deterministic id of what identifies a record."""
    return F.sha2(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
