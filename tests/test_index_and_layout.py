"""Index upkeep, table layout, fact lines and merged plans."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import factlines, layout, linker
from ledgerloom.plans import merge
from ledgerloom.sources import corpus, index

ROW = "doc_id long, source_chunk_id long, segment_index int, embedding array<double>"


def rows_of(spark, root):
    return sorted((r.doc_id, r.source_chunk_id, r.segment_index, r.embedding[0]) for r in index.read(spark, root).collect())


def test_index_upkeep(spark, tmp_path):
    root = str(tmp_path / "i")
    rows = lambda *x: spark.createDataFrame([(d, c, s, [v, 0.0]) for d, c, s, v in x], ROW)
    docs = lambda *x: spark.createDataFrame([(d,) for d in x], "doc_id long")
    with pytest.raises(corpus.CorpusError):
        index.read(spark, root)
    everything = rows((1, 10, 0, 1.0), (1, 10, 1, 2.0), (2, 20, 0, 3.0), (3, 30, 0, 4.0))
    known = index.refresh(spark, root, everything, docs(), docs(), "m", 3)
    assert known["vector_row_count"] == 4 and known["embedding_dimensions"] == 2
    index.upsert(rows((1, 10, 0, 9.0), (4, 40, 0, 5.0)), root)
    assert rows_of(spark, root) == [(1, 10, 0, 9.0), (2, 20, 0, 3.0), (3, 30, 0, 4.0), (4, 40, 0, 5.0)]
    index.delete_docs(docs(3, 4, 77), root)
    assert rows_of(spark, root) == [(1, 10, 0, 9.0), (2, 20, 0, 3.0)]
    known = index.refresh(spark, root, rows((1, 10, 0, 9.0), (5, 50, 0, 6.0)), docs(5), docs(2), "m", 2)
    assert rows_of(spark, root) == [(1, 10, 0, 9.0), (5, 50, 0, 6.0)] and known["vector_row_count"] == 2
    index.refresh(spark, root, rows((7, 70, 0, 1.5)), docs(), docs(), "other", 1)
    assert rows_of(spark, root) == [(7, 70, 0, 1.5)]
    assert index.refresh(spark, root, everything, docs(), docs(), "other", 0)["vector_row_count"] == 0
    assert not corpus.present(spark, root, index.NAME)


def test_lost_embedding_fails(spark):
    segments = spark.createDataFrame([(1, 0, 1, "t")], "chunk_id long, segment_index int, segment_count int, text string")
    with pytest.raises(Exception, match="no embedding of segment 1:0"):
        corpus.vector_rows(segments, spark.createDataFrame([], "chunk_id long, segment_index int, embedding array<double>")).collect()


def test_layout(spark):
    page = "Intro\n Consolidated Balance Sheets \nx\nSummary of leases"
    t = spark.createDataFrame([(page, 0), (page, 1), (page, 5), ("none", 0)], "page string, i int")
    assert [r.c for r in t.select(layout.caption(F.col("page"), F.col("i")).alias("c")).collect()] == ["Consolidated Balance Sheets", "Summary of leases", "Summary of leases", ""]
    raw = [(1, [["A ", "B"], ["", None], ["x", "1"], ["y", "2"]]), (2, [["A"], ["x"], ["y"]]), (3, [["A", "B"], ["x", "1"]]), (4, None), (5, [[""]])]
    got = layout.split_table(spark.createDataFrame(raw, "id int, raw array<array<string>>"), "raw")
    got = got.select("id", layout.is_table(F.col("headers"), F.col("rows")).alias("ok"), layout.table_text(F.col("headers"), F.col("rows")).alias("text")).orderBy("id").collect()
    assert [r.ok for r in got] == [True, False, False, False, False]
    assert got[0].text == "A | B\nx | 1\ny | 2"


def test_fact_lines(spark):
    day = date(2023, 12, 31)
    facts = spark.createDataFrame([("e", "c", day, 1234.5, "Total", "USD", 2), ("e", "c", day, 1.0, "Total", "USD", 3), ("e", "d", date(2023, 3, 31), 2.0, "D", "USD", 1)], "entity string, concept string, period_end date, value double, label string, unit string, ord int")
    got = factlines.fact_lines(facts, ["entity"], spark.createDataFrame([(day,)], "period_end date")).collect()
    assert [r.line for r in got] == ["Total (FY2023): 1,234.50 USD"]
    assert sorted((r.period_end, r.concepts) for r in factlines.concepts_by_period(facts, ["entity"]).collect()) == [(date(2023, 3, 31), ["d"]), (day, ["c"])]
    key = "query_id int, period_end date"
    gaps = factlines.narrative_gaps(*[spark.createDataFrame(x, key) for x in ([(1, day), (2, day), (3, day)], [(1, day)], [(2, day)])])
    assert [tuple(r) for r in gaps.collect()] == [(3, day)]


def test_merged_plans(spark):
    t = spark.createDataFrame([([" Revenue", "2023-12-31", "", "Revenue", None, "net"], {"gross_margin": "margin"})], "a array<string>, m map<string,string>")
    r = t.select(merge.mentions(F.col("a")).alias("a"), merge.mentions_of_map(F.col("m")).alias("m")).first()
    assert r.a == ["Revenue", "net"] and r.m == ["gross margin", "margin"]
    cogs, cost = linker.COST_OF_GOODS, linker.COST_OF_REVENUE
    cases = [([], ["a"], False, ["a"]), (["b", "b"], [], False, ["b"]), (["b"], ["a"], True, ["a"]), (["b"], ["a"], False, ["a", "b"]), ([cost], [cogs], True, [cogs, cost])]
    t = spark.createDataFrame([c[:3] + (i,) for i, c in enumerate(cases)], "r array<string>, f array<string>, c boolean, i int")
    got = t.select("i", merge.required_concepts(F.col("r"), F.col("f"), F.col("c")).alias("x")).orderBy("i").collect()
    assert [g.x for g in got] == [c[3] for c in cases]


def test_linker_words(spark):
    words = {r.concept: r.aliases for r in linker.vocabulary(spark, [linker.COST_OF_GOODS, "x:LeaseCosts"], automotive=True).collect()}
    assert words == {linker.COST_OF_GOODS: ["cost of automotive revenue", "cost of automotive sales"], "x:LeaseCosts": ["lease costs"]}
    end = date(2022, 12, 31)
    missing = spark.createDataFrame([("e", end, "x:LeaseCosts")], "entity string, period_end date, concept string")
    tables = spark.createDataFrame([("t", "e", end, 1, "in millions", [], [["", "2023", "2022"], ["Lease costs", "7", "(1,250)"]])], "table_id string, entity string, period_end date, ord int, caption string, headers array<string>, rows array<array<string>>")
    got = linker.table_fallback(missing, tables, linker.vocabulary(spark, ["x:LeaseCosts"])).first()
    assert (got.column_index, got.raw_value, got.value) == (2, -1250.0, -1.25e9)
    facts = spark.createDataFrame([("e", end, linker.COST_OF_REVENUE)], missing.schema)
    need = spark.createDataFrame([("e", end, linker.COST_OF_GOODS)], missing.schema)
    assert linker.period_coverage(need, facts).first().has_required and not linker.period_coverage(need, facts, automotive=True).first().has_required
