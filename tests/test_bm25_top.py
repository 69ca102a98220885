"""BM25 by chunk: the same as brute force; neither scores of pairs nor texts are shuffled."""

import math
import random
from collections import Counter, defaultdict

import pytest

from ledgerloom.operators import best, lexical
from ledgerloom.plans import text_queries
from test_top_lists import rounded, shuffled


@pytest.fixture
def corpus():
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, k % 3 if k % 10 else None, [rnd.choice(words) for _ in range(rnd.randint(0, 30))]) for k in range(150)]
    docs += [(200 + k, 1, ["w1", "w2", "w2"]) for k in range(40)] + [(300, 0, []), (301, 0, ["w1"] * 5000)]
    return docs, [(7, ["w1", "w2", "w1"]), (8, ["none"]), (9, []), (10, words[:20]), (11, ["w2", "w39"])]


@pytest.mark.parametrize("cells,held,questions", [(4_000_000, 500_000, 2048), (60, 20, 2), (60, 500_000, 2048)])
@pytest.mark.parametrize("group", [None, "kind"])
def test_bm25_is_brute_force(spark, monkeypatch, corpus, cells, held, questions, group):
    docs, asked = corpus
    monkeypatch.setattr(best, "CELLS", cells)
    monkeypatch.setattr(lexical, "HELD", held)
    monkeypatch.setattr(lexical, "QUESTIONS", questions)
    chunks = spark.createDataFrame([(k, g, t, len(t)) for k, g, t in docs], "chunk_id long, kind long, tokens array<string>, dl long").repartition(3)
    got = lexical.bm25_top(chunks, spark.createDataFrame(asked, "query_id long, tokens array<string>"), 4, group, "chunk_id <> 205")
    n, avg, df = len(docs), sum(len(t) for _, _, t in docs) / len(docs), Counter(w for _, _, t in docs for w in set(t))
    lists = defaultdict(list)
    for q, tokens in asked:
        for k, g, t in docs:
            tf = Counter(t)
            s = sum(c * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w, c in sorted(Counter(tokens).items()) if tf[w])
            if k != 205 and rounded(s) > 0:
                lists[q, g if group else None].append((-rounded(s), k))
    want = [(q, *([g] if group else []), k, -s, rank) for (q, g), found in lists.items() for rank, (s, k) in enumerate(sorted(found)[:4], 1)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.fixture
def store(spark, tmp_path):
    """2,000 documents in 8 files, 50 questions with a word that all documents have."""
    rnd = random.Random(3)
    docs = [(k, "common " + " ".join(f"{rnd.getrandbits(40):x}" for _ in range(60)), "en", "s", 600) for k in range(2000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"common word {k}") for k in range(50)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, [1.0, float(k)], 0) for k in range(400)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name,lists", [("bm25_topk", 15), ("bm25_per_period", 15), ("hybrid_single_pass", 30), ("hybrid_per_period", 150)])
def test_pairs_of_questions_and_chunks_stay_in_their_task(spark, store, name, lists):
    """100,000 pairs have a score. Before, each was shuffled."""
    records, _ = shuffled(spark, lambda: text_queries.QUERIES[name](spark, store).collect())
    assert records < 8 * 50 * lists + 10_000


@pytest.mark.parametrize("name", ["citations_ranked", "confidence_status", "narrative_cue_rerank"])
def test_texts_of_hits_are_not_shuffled(spark, store, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")
    try:
        _, size = shuffled(spark, lambda: text_queries.QUERIES[name](spark, store).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert size < 400_000  # the texts have 1.3 MB


def test_questions_without_words_or_hits(spark):
    chunks = spark.createDataFrame([(1, ["a"], 1), (2, [], 0)], "chunk_id long, tokens array<string>, dl long")
    for asked in ([(1, [])], [(1, ["zzz"])], []):
        assert lexical.bm25_top(chunks, spark.createDataFrame(asked, "query_id long, tokens array<string>"), 3).collect() == []
    assert lexical.bm25_top(chunks.limit(0), spark.createDataFrame([(1, ["a"])], "query_id long, tokens array<string>"), 3).collect() == []
