"""The vector index on shared storage: append, upsert, delete, clear, metadata and refresh.

Rows lie in partitions by a hash of their document, so a change rewrites only the partitions of the
documents it touches. A job lost while it rewrites leaves the staged copy beside the table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import CorpusError, present

SCHEMA_VERSION = 2
PARTS = 64
NAME, METADATA, PART = "vectors", "vectors_metadata", "part"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = _fs(spark, path)
    fs.delete(hadoop, True)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.withColumn(PART, F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(parts)).cast("int"))


def metadata(spark: SparkSession, root: str) -> dict | None:
    if not present(spark, root, METADATA):
        return None
    return json.loads(spark.read.text(f"{root}/{METADATA}").first()["value"])


def _parts(spark: SparkSession, root: str) -> int:
    return (metadata(spark, root) or {}).get("parts", PARTS)


def save_metadata(spark: SparkSession, root: str, model: str, source_chunks: int) -> dict:
    """Model, layout and size of the index as it is now; one aggregation over the rows."""
    rows, width = 0, 0
    if present(spark, root, NAME):
        r = read(spark, root).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("w")).first()
        rows, width = r["n"], r["w"] or 0
    known = {"index_schema_version": SCHEMA_VERSION, "embedding_model": model, "embedding_dimensions": width, "source_chunk_count": source_chunks, "vector_row_count": rows, "parts": _parts(spark, root)}
    spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{METADATA}")
    return known


def read(spark: SparkSession, root: str) -> DataFrame:
    if not present(spark, root, NAME):
        raise CorpusError(f"{NAME} is missing below {root}: build the index first")
    return spark.read.parquet(f"{root}/{NAME}").drop(PART)


def append(rows: DataFrame, root: str) -> None:
    """Add rows (doc_id, source_chunk_id, segment_index, embedding, ..) without looking for old ones."""
    _dealt(rows, _parts(rows.sparkSession, root)).write.mode("append").partitionBy(PART).parquet(f"{root}/{NAME}")


def clear(spark: SparkSession, root: str) -> None:
    _delete(spark, f"{root}/{NAME}")


def _rewrite(spark: SparkSession, root: str, gone: DataFrame, key: str, new: DataFrame | None) -> None:
    """Drop the rows whose ``key`` is in ``gone`` (key, doc_id) and add ``new``."""
    path, parts = f"{root}/{NAME}", _parts(spark, root)
    old = spark.read.parquet(path)
    touched = _dealt(gone, parts).select(PART).distinct()
    kept = old.join(touched, PART, "left_semi").join(gone.select(key).distinct(), key, "left_anti")
    staged = f"{root}/.{NAME}-{uuid.uuid4().hex}"
    (kept if new is None else kept.unionByName(_dealt(new, parts))).write.parquet(staged)
    ready = spark.read.schema(old.schema).parquet(staged)
    emptied = touched.join(ready.select(PART).distinct(), PART, "left_anti").collect()  # partitions, not rows
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    for r in emptied:
        _delete(spark, f"{path}/{PART}={r[PART]}")
    _delete(spark, staged)


def delete_docs(docs: DataFrame, root: str) -> None:
    """Remove all rows of the documents ``docs`` (doc_id)."""
    if present(docs.sparkSession, root, NAME):
        _rewrite(docs.sparkSession, root, docs.select("doc_id"), "doc_id", None)


def upsert(rows: DataFrame, root: str) -> None:
    """Replace the rows of the source chunks in ``rows``; a chunk keeps its document."""
    if not present(rows.sparkSession, root, NAME):
        return append(rows, root)
    _rewrite(rows.sparkSession, root, rows.select("source_chunk_id", "doc_id").distinct(), "source_chunk_id", rows)


def must_rebuild(known: dict | None, has_table: bool, model: str) -> bool:
    """An index of another model or layout, or none, is built from all documents."""
    return known is None or not has_table or known.get("embedding_model") != model or known.get("index_schema_version") != SCHEMA_VERSION


def refresh(spark: SparkSession, root: str, rows: DataFrame, refreshed: DataFrame, removed: DataFrame, model: str, source_chunks: int) -> dict:
    """Bring the index up to date and return its metadata.

    ``rows`` are those of all current documents (only what is needed of it is computed), ``refreshed``
    and ``removed`` are documents (doc_id). Without source chunks the index becomes empty.
    """
    has_table = present(spark, root, NAME)
    if source_chunks == 0:
        clear(spark, root)
        return save_metadata(spark, root, "", 0)
    if must_rebuild(metadata(spark, root), has_table, model):
        clear(spark, root)
        append(rows, root)
    else:
        gone = refreshed.select("doc_id").unionByName(removed.select("doc_id")).distinct()
        _rewrite(spark, root, gone, "doc_id", rows.join(refreshed.select("doc_id").distinct(), "doc_id", "left_semi"))
    return save_metadata(spark, root, model, source_chunks)
