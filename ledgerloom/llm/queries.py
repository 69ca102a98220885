"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gam import fit_quality, score_quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.filter(F.pmod(crc_of_id("doc_id"), F.lit(4)) != 2))
    held_out = docs.withColumn("held_out", F.coalesce(F.pmod(crc_of_id("doc_id"), F.lit(4)) == 2, F.lit(False)))
    return score_quality(held_out, model, keep=("held_out",)).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import fit_rules, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict_language, train_prototypes

    docs = table(spark, sf_dir, "documents").withColumn("fold", F.pmod(crc_of_id("doc_id"), F.lit(5)))
    prototypes = train_prototypes(docs.filter("fold <> 0"), "text", "lang", "doc_id")
    held_out = docs.withColumn("held_out", F.coalesce(F.col("fold") == 0, F.lit(False)))
    return predict_language(held_out, prototypes, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dac import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrappers import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_media_features

    return text_media_features(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_templates import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_quality_gam,
        op2_quality_rules,
        op3_mix_sources,
        op4_bpe_encode_decode,
        op5_language_id,
        op6_token_files,
        op7_simhash_neardup,
        op8_html_main_text,
        op9_media_columns,
        op10_url_filters,
    )}


def oracle_sql() -> dict[str, str]:
    from .mixing import MIX_SQL

    return {
        "op3_mix_sources": "WITH src AS (SELECT doc_id, text, source FROM documents)," + MIX_SQL
        + "SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed",
    }
