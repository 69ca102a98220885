"""The corpus pipeline: language, quality rules, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All stages but the last keep the columns of ``documents``.

Defined results, as in the operators: null and empty texts have no language and go in the first
stage; rows whose id is null are judged by their own text; repeated rows are near-duplicates; extra
columns are kept by all stages but the last; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, langid, mixing, rules, simhash
from ledgerloom.llm.common import fresh, materialize, table

#: Documents whose language is that unsure go.
LEAST_SCORE = 0.4


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, so that judgements come back to their row; the number's column."""
    row = fresh(docs, "__row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "stage"), row


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters or without a clear language go."""
    marked, row = _marked(docs)
    prototypes = langid.train_prototypes(docs, "text", "lang", "doc_id")
    found = langid.predict_language(marked, prototypes, id_col=row)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return marked.join(kept.select(row), row, "left_semi").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rule or a learned rule rejects go."""
    marked, row = _marked(docs)
    learned = rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    kept = rules.judge(marked, learned, id_col=row).filter("kept")
    return marked.join(kept.select(row), row, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its source's target weight takes it."""
    return mixing.emit_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: tokens of every document, and what they decode to, as digests."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("mix_sources", mix),
    ("bpe_encode", encode),
]

#: The stages learn from data and encode by vocabulary files; SQL expresses none of that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
