"""Top lists made inside tasks: the same as brute force, and only what can win is shuffled."""

import math
import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import best, vectors
from ledgerloom.plans import text_queries


def rounded(x):
    return float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) + 0.0


def shuffled(spark, run):
    """Records and bytes that all jobs of ``run`` wrote to shuffles."""
    sc = spark.sparkContext
    group = f"g{random.random()}"
    sc.setJobGroup(group, group)
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    stages = [sc._jsc.sc().statusStore().lastStageAttempt(s) for s in {s for j in jobs for s in j.stageIds}]
    return sum(s.shuffleWriteRecords() for s in stages), sum(s.shuffleWriteBytes() for s in stages)


def test_half_up_is_spark_round(spark):
    values = [0.1234565, 0.1234575, -0.1234565, 2.5e-6, 5e-7, -4e-7, 0.0, -0.0, 1.0, 123456.7890125, 1e12 + 0.25, 1e300, math.inf, math.nan]
    values += [k / 1e6 + 5e-7 for k in range(2000)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6)).collect()]
    assert [repr(v) for v in best.half_up(np.array(values)).tolist()] == [repr(v) for v in want]


@pytest.fixture
def odd_vectors():
    """Copies, near copies, null, empty, zero and shorter vectors, gaps, and a NaN."""
    rnd = random.Random(5)
    made = [[rnd.uniform(-1, 1) for _ in range(5)] for _ in range(60)] + [[1.0, 0.0, 0.0, 0.0, 0.0]] * 25
    made += [[1.0, 1e-9 * k, 0.0, 0.0, 0.0] for k in range(10)] + [None, [], [0.0] * 5, [1.0, 0.0], [3.0, 4.0], [1.0, None, 0.0, 0.0, 0.0], [math.nan, 0.0, 0.0, 0.0, 0.0]]
    rnd.shuffle(made)
    return [(k, k // 4, e, None if k % 11 == 0 else k % 3, k // 4 % 2) for k, e in enumerate(made)]


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not a or None in a or None in b:
        return 0.0
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return 0.0 if norms == 0 else rounded(sum(x * y for x, y in zip(a, b)) / norms) if norms == norms else math.nan


@pytest.mark.parametrize("block,cells", [(8192, 4_000_000), (7, 100)])
@pytest.mark.parametrize("match,group,collapse", [(None, None, False), (("label", "query_label"), None, False), (None, "kind", True), (None, None, True), (("label", "query_label"), "kind", True)])
def test_vector_search_is_brute_force(spark, monkeypatch, odd_vectors, block, cells, match, group, collapse):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(best, "CELLS", cells)
    v = spark.createDataFrame(odd_vectors, "vec_id long, source_chunk_id long, embedding array<double>, label long, kind long")
    q = v.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.col("label").alias("query_label"))
    got = vectors.search(v, q, 6, len(odd_vectors), 21, match, group, collapse)
    want = []
    for qid, _, qe, ql, _ in odd_vectors[::5]:
        lists = defaultdict(dict)
        for vid, chunk, e, label, kind in odd_vectors:
            if match and (label is None or label != ql):
                continue
            s = cosine(e, qe)
            row = (-math.inf if s != s else -s, vid, chunk, s)
            unit = chunk if collapse else vid
            lists[kind if group else None][unit] = min(row, lists[kind if group else None].get(unit, (math.inf,)))
        for kind, units in lists.items():
            for rank, (unit, (_, vid, chunk, s)) in enumerate(sorted(units.items(), key=lambda x: (x[1][0], x[0]))[:6], 1):
                want.append((qid, vid, chunk, s, *([kind] if group else []), rank))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_expression_runs_for_each_pair_of_vectors(spark):
    for name in ("vector_topk", "vector_segment_collapse", "vector_filtered_topk"):
        plan = text_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "lambdafunction" not in plan and "Join" not in plan
