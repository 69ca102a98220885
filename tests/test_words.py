"""Tokens over bytes: the same as the column expression, whatever the text."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import words
from ledgerloom.functions.text import tokens
from ledgerloom.operators import lexical
from ledgerloom.plans import text_queries

#: Joints at ends and in rows, letters that lower to ASCII, and characters around the Chinese ones.
PARTS = ["a", "b7", "Z", "-", "'", " ", "\n", "_", "ä", "İ", "K", "ſ", "一", "鿿", "年", "中文", "㐀", "䷿", "ꀀ", "가", "😀", "–", "a-b", "c--d"]
TEXTS = [None, "", " ", "a", "-", "a-", "-b", "'a'", "a-b-c", "a--b", "a-'b", "x'y-z", "年", "一年", "一年中", "a年b", "年-年", "年 中", "q" * 300, "", ""]


@pytest.fixture
def texts():
    rnd = random.Random(4)
    return TEXTS + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(400)]


@pytest.mark.parametrize("block", [1 << 22, 64, 1])
def test_words_over_bytes_are_the_expressions_tokens(spark, monkeypatch, texts, block):
    monkeypatch.setattr(words, "BLOCK_BYTES", block)
    made = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", tokens(F.col("t")).alias("tokens"), F.lower(F.coalesce("t", F.lit(""))).alias("low")).orderBy("k").collect()
    asked = sorted({t for r in made for t in r["tokens"]})[::2] + ["zzz"]
    low = pa.array([None, "skipped", *[r["low"] for r in made]], pa.string()).slice(2)
    for column in (low, low.cast(pa.large_string())):
        dl, row, code = words.word_codes(column, pa.array(asked))
        assert dl.tolist() == [len(r["tokens"]) for r in made]
        got = Counter(zip(row.tolist(), [asked[c] for c in code]))
        assert got == Counter((k, t) for k, r in enumerate(made) for t in r["tokens"] if t in set(asked))


def test_words_of_nothing():
    for column in (pa.array([], pa.string()), pa.array(["", ""]), pa.array(["a"])):
        dl, row, code = words.word_codes(column, pa.array([], pa.string()))
        assert dl.tolist() == [min(1, len(x.as_py())) for x in column] and len(row) == len(code) == 0


def test_bm25_of_texts_is_bm25_of_their_tokens(spark, texts):
    chunks = spark.createDataFrame([(k, k % 3, t) for k, t in enumerate(texts)], "k long, kind long, t string").repartition(3)
    asked = spark.createDataFrame([(1, "a a-b 年 中文"), (2, "K b7 c"), (3, "zzz"), (4, None)], "query_id long, t string").select("query_id", tokens(F.col("t")).alias("tokens"))
    for group in (None, "kind"):
        got, want = (lexical.bm25_top(make(chunks, "k", F.col("t"), F.col("kind")), asked, 5, group).collect() for make in (lexical.lowered, lexical.tokenized))
        assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_per_period", "citations_ranked", "confidence_status", "hybrid_single_pass", "hybrid_per_period"])
def test_no_token_of_the_corpus_becomes_a_string(spark, monkeypatch, name):
    """Before, each text went through regular expressions and its tokens to Python as a list of strings."""
    plans, write = [], lexical.materialize
    monkeypatch.setattr(lexical, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a))
    text_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert plans and not any("regexp_extract_all" in p for p in plans)
