"""Golden values of the financial fixture, the planner, cells and chunkers."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.periods import classify_period, compatibility_matrix
from ledgerloom.functions.text import numeric_cells, tokens
from ledgerloom.operators import calculators as calc
from ledgerloom.operators import chunking, evaluation, evidence, facts, fusion, ingestion, vectors
from ledgerloom.plans import planner

ENDS = [date(2022, 3, 31), date(2022, 6, 30), date(2022, 9, 30), date(2022, 12, 31), date(2023, 3, 31), date(2023, 6, 30), date(2023, 9, 30), date(2023, 12, 31)]
VALUES = {
    "us-gaap:Revenues": [18756, 16934, 21454, 81462, 23329, 24927, 23350, 96773],
    "us-gaap:GrossProfit": [5539, 4234, 5382, 20853, 4511, 4533, 4178, 17660],
    "us-gaap:OperatingIncomeLoss": [3600, 2464, 3688, 13656, 2664, 2399, 1764, 8891],
}


@pytest.fixture(scope="module")
def fixture(spark):
    rows = [
        ("acme", c, e.year, None if e.month == 12 else e.month // 3, False, Decimal(v), None, e, e.year * 100 + e.month)
        for c, vs in VALUES.items()
        for e, v in zip(ENDS, vs)
    ]
    schema = "entity string, concept string, fiscal_year int, fiscal_quarter int, is_instant boolean, value decimal(28,4), period_start date, period_end date, ord long"
    return spark.createDataFrame(rows, schema).cache()


def test_percent_change(fixture):
    r = calc.period_over_period(fixture, "2022-12-31", "2023-12-31", percent=True).filter("concept = 'us-gaap:Revenues'").first()
    assert r["result"] == pytest.approx(18.80, abs=0.01) and r["status"] == "ok"


def test_missing_operand_is_zero(fixture):
    r = calc.period_over_period(fixture, "2022-12-31", "2030-12-31").first()
    assert r["result"] == 0.0 and r["status"] == "missing"


def test_gross_margin(fixture):
    r = calc.ratio(fixture, "us-gaap:GrossProfit", "us-gaap:Revenues").filter("period_end = '2023-12-31'").first()
    assert r["ratio"] == pytest.approx(0.1825, abs=1e-4)


def test_fourth_quarter(fixture):
    got = {(r["concept"], r["fiscal_year"]): r["q4_value"] for r in calc.derive_fourth_quarter(fixture).collect()}
    assert got["us-gaap:Revenues", 2022] == 24318


def test_best_quarterly_margin(fixture):
    r = calc.ratio(fixture.filter("fiscal_quarter IS NOT NULL AND fiscal_year = 2023"), "us-gaap:OperatingIncomeLoss", "us-gaap:Revenues")
    top = calc.rank_values(r, ["entity"], F.col("ratio"), F.col("period_end")).filter("rank = 1").first()
    assert top["period_end"] == date(2023, 3, 31) and top["ratio"] == pytest.approx(0.1142, abs=1e-4)


@pytest.mark.parametrize(
    "expression, expected",
    [
        ("sum(us-gaap:Revenues)", 306985.0),
        ("max(us-gaap:Revenues)", 96773.0),
        ("change(us-gaap:Revenues, 2022-12-31, 2023-12-31)", 15311.0),
        ("change(us-gaap:Revenues, 2022-12-31)", 0.0),
        ("pct_change(us-gaap:Revenues, bad, 2023-12-31)", 0.0),
        ("ratio(us-gaap:GrossProfit, us-gaap:Revenues, 2023-12-31)", 17660 / 96773),
        ("us-gaap:Revenues - us-gaap:GrossProfit", 18756.0 - 5539.0),
        ("us-gaap:Nothing", 0.0),
    ],
)
def test_expressions(fixture, expression, expected):
    assert calc.calculate(expression, fixture).first()["result"] == pytest.approx(expected)


def test_first_wins_and_keep_last(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 3, 1)], "k string, v int, ord int")
    assert {(r["k"], r["v"]) for r in facts.first_wins(rows, ("k",)).collect()} == {("a", 2), ("b", 3)}
    assert {(r["k"], r["v"]) for r in facts.keep_last(rows, ["k"]).collect()} == {("a", 1), ("b", 3)}


def test_period_semantics(spark):
    df = spark.createDataFrame(
        [(False, date(2022, 1, 1), date(2022, 12, 31)), (False, date(2022, 10, 1), date(2022, 12, 31)), (False, None, date(2022, 6, 30)), (True, None, date(2022, 6, 30)), (False, None, date(2022, 5, 31))],
        "i boolean, s date, e date",
    )
    assert [r[0] for r in df.select(classify_period(F.col("i"), F.col("s"), F.col("e"))).collect()] == ["annual_cumulative", "derived_standalone", "quarterly_standalone", "instant", "unknown"]
    ok = {(r["a"], r["b"]) for r in compatibility_matrix(spark).filter("compatible").collect()}
    assert ("quarterly_standalone", "derived_standalone") in ok and ("unknown", "unknown") not in ok and len(ok) == 6


@pytest.mark.parametrize(
    "raw, value, detail",
    [
        ("1,234", 1234.0, "ok"), ("(1,234)", -1234.0, "ok"), ("$ 12.5", 12.5, "ok"), ("12.5%", 0.125, "percent"), ("1.5M", 1.5e6, "scaled_1e+06"), ("2 bn", 2e9, "scaled_1e+09"),
        ("3k", 3e3, "scaled_1000"), ("—", 0.0, "dash_zero"), ("–7", -7.0, "ok"), ("", None, "empty"), ("  ", None, "empty"), ("Total", None, "non_numeric"), ("51,6I8", None, "non_numeric"),
        ("1.2.3", None, "parse_failed: '1.2.3'"), ("$", None, "empty_after_strip"), (None, None, "empty"),
    ],
)
def test_numeric_cells(spark, raw, value, detail):
    r = numeric_cells(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert r["detail"] == detail and (r["value"] is None if value is None else r["value"] == pytest.approx(value))


def test_suspect_cells(spark):
    cells = spark.createDataFrame([(1, "51,6I8"), (1, "12"), (2, "1.2.3"), (2, "x")], "table_id int, raw_value string")
    got = {r["table_id"]: r["table_status"] for r in ingestion.table_status(ingestion.validate_cells(cells), ["table_id"]).collect()}
    assert got == {1: "suspect", 2: "failed"} or got == {1: "valid", 2: "failed"}


def test_tokens_cjk(spark):
    df = spark.createDataFrame([("Year-end 营收增长 it's É",)], "t string")
    assert df.select(tokens(F.col("t"))).first()[0] == ["year-end", "it's", "营收增长", "营收", "收增", "增长"]


def test_planner_periods_and_metrics():
    assert planner.periods("Q3 2022 and 2023Q1") == [date(2022, 9, 30), date(2023, 3, 31)]
    assert planner.periods("from 2019 to 2021") == [date(y, 12, 31) for y in (2019, 2020, 2021)]
    assert planner.periods("2022年第三季度") == [date(2022, 9, 30)]
    assert planner.periods("as of 2023-06-30") == [date(2023, 6, 30)]
    assert planner.metrics("free cash flow and cash position") == ["custom:FreeCashFlow", "us-gaap:CashAndCashEquivalentsAtCarryingValue"]
    assert planner.metrics("毛利率") == ["us-gaap:GrossProfit"]


def test_planner_reads_mixed_periods():
    def ends(*years):
        return [date(y, 12, 31) for y in years]

    assert planner.periods("FY2021 Q3") == [date(2021, 9, 30), *ends(2021)]
    assert planner.periods("从FY2019到FY2021") == planner.periods("2019 – 2021") == ends(2019, 2020, 2021)
    assert planner.periods("2010 through 2024") == ends(2010, 2024)  # too long for a range
    assert planner.periods("2022年末 and 2023/12/31") == ends(2022, 2023)
    assert planner.periods("2022年第一季度和第二季度") == [date(2022, 3, 31), date(2022, 6, 30)]
    assert planner.periods("Q1-2022 vs Q2") == [date(2022, 3, 31), date(2022, 6, 30)]
    assert planner.periods("第三季度") == [] and planner.periods("2023-13-45") == ends(2023)
    assert planner.semantics(date(2022, 12, 31), "2022 Q4") == planner.semantics(date(2022, 12, 31), "第四季度") == "quarterly_standalone"
    assert planner.semantics(date(2022, 12, 31), "2022 annual") == "annual_cumulative" and planner.semantics(date(2022, 5, 1), "") == "unknown"


def test_planner_terms_are_added_in_order():
    r = planner.read_question("2022年年报提到的宏观背景、竞争和物流挑战")
    assert r["search_text"].startswith("macro environment challenge discuss describe mention competition logistics 10-k annual")


def test_planner_intents(spark):
    from ledgerloom.plans.planner_queries import planned

    got = {r["question_id"]: (r["intent"], r["shape"]) for r in planned(spark).collect()}
    assert got[1] == ("lookup", "single_value")
    assert got[2] == ("pct_change", "comparison")
    assert got[3] == ("rank", "ranking")
    assert got[4][0] == "ratio"
    assert got[5][0] == "step_trace"
    assert got[6][1] == "composite"
    assert got[8][0] == "ratio"
    assert got[9][0] == "difference"
    assert got[10][1] == "time_series"
    assert got[11] == (None, "single_value")


def test_sliding_windows():
    text = "a" * 2900 + ". " + "b" * 3000
    spans = chunking.sliding_spans(text, 3200, 400)
    assert spans[0] == (0, 2901) and spans[1][0] == 2501 and spans[-1][1] == len(text)
    assert chunking.sliding_spans("", 3200, 400) == [(0, 0)]


def test_segment_packing():
    text = "\n\n".join(["x" * 1000, "y" * 1000, "z" * 1000])
    parts = chunking.pack_segments(text)
    assert len(parts) == 2 and parts[1].startswith("y" * 180 + "\n") and parts[1].endswith("z" * 1000)
    assert chunking.pack_segments("") == [""]
    table = "\n".join(["h1", "h2"] + [f"row {k} " + "v" * 90 for k in range(60)])
    assert all(p.startswith("h1\nh2\n") and len(p) <= 2400 for p in chunking.pack_table(table))


def test_hard_split(spark):
    df = spark.createDataFrame([("abcdefghij",), ("",)], "t string")
    assert [r[0] for r in df.select(chunking.hard_split(F.col("t"), 4, 1)).collect()] == [["abcd", "defg", "ghij"], []]


def test_rank_fusion_prefers_lexical_on_ties(spark):
    lane = "query_id long, chunk_id long, rank long"
    out = fusion.fuse(spark.createDataFrame([(1, 10, 1)], lane), spark.createDataFrame([(1, 20, 1), (1, 30, 2)], lane), ["query_id"]).orderBy("final_rank").collect()
    assert [r["chunk_id"] for r in out] == [10, 20, 30]


def test_vector_blocks_and_collapse(spark, monkeypatch):
    rows = [(k, k // 4, [1.0, float(k)]) for k in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, source_chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [0.0, 1.0])], "query_id long, query_embedding array<double>")
    whole = sorted(map(tuple, vectors.search(v, q, 5, 40, 1).collect()))
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, vectors.search(v, q, 5, 40, 1).collect())) == whole
    assert vectors.collapse_segments(vectors.search(v, q, 8, 40, 1)).count() == 2


def test_company_facts(spark, tmp_path):
    import json

    entry = {"start": "2022-01-01", "end": "2022-12-31", "val": 81462.0, "accn": "a", "fy": 2022, "fp": "FY", "form": "10-K", "filed": "2023-01-31"}
    bad = entry | {"form": "8-K"}
    body = {"cik": 1, "entityName": "Acme", "facts": {"us-gaap": {"Revenues": {"label": "Revenues", "description": None, "units": {"USD": [entry, bad]}}}, "other": {}}}
    (tmp_path / "f.json").write_text(json.dumps(body))
    out = ingestion.companyfacts(spark, str(tmp_path / "f.json")).collect()
    assert len(out) == 1 and out[0]["concept"] == "us-gaap:Revenues" and out[0]["value"] == 81462.0 and not out[0]["is_instant"]


def test_manifest_from_folder(spark, tmp_path):
    for name in ("Acme_2023_全年_10-K.pdf", "Acme_2023_Q1_10-Q.pdf", "notes.pdf"):
        (tmp_path / name).write_bytes(b"x")
    m = ingestion.manifest(spark, ingestion.scan_raw_directory(spark, str(tmp_path)), range(2023, 2024)).collect()
    assert sorted((r["fiscal_quarter"] or 0, r["status"]) for r in m) == [(0, "available"), (1, "available"), (2, "downloadable"), (3, "downloadable")]


def test_cell_values(spark):
    df = spark.createDataFrame([("(1,994)",), ("$ 19963",), ("-7.5",), ("none",)], "c string")
    assert [r[0] for r in df.select(evidence.cell_value(F.col("c"))).collect()] == [-1994.0, 19963.0, -7.5, None]


def test_judges(spark):
    df = spark.createDataFrame([("grew 18.8% to 96,773",)], "t string")
    assert df.select(evaluation.numbers_in(F.col("t"))).first()[0] == [18.8, 96773.0]


def test_stream_equals_batch(spark, tmp_path):
    from ledgerloom.streaming import events

    src = "/root/testdata/sf0.001/events.parquet"
    folder = tmp_path / "in"
    spark.read.parquet(src).write.parquet(str(folder))
    got = events.run_once(spark, str(folder), str(tmp_path / "cp"), "events_out")
    want = events.windowed(spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_goes_on_and_drops_late_events(spark, tmp_path):
    from datetime import datetime

    from ledgerloom.streaming import events

    def add(part, rows):
        frame = spark.createDataFrame([(datetime(2024, 1, 1, h, m), "view", v) for h, m, v in rows], "ts timestamp, event_type string, value double")
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / part))

    def run():
        got = events.run_once(spark, str(tmp_path / "in" / "*"), str(tmp_path / "cp"), "out").collect()
        return sorted((r["window_start"].hour, r["n_events"], r["total"]) for r in got)

    add("a", [(1, 5, 1.0), (1, 50, 2.0), (5, 0, 4.0)])
    assert run() == [(1, 2, 3.0), (5, 1, 4.0)]
    add("b", [(1, 30, 8.0), (5, 30, 16.0)])  # the first is later than the watermark allows
    assert run() == [(1, 2, 3.0), (5, 2, 20.0)]
    assert run() == [(1, 2, 3.0), (5, 2, 20.0)]


def test_question_reading():
    r = planner.read_question("What was the gross margin in Q4 2022?")
    assert r["period_semantics"] == ["quarterly_standalone"] and "Q4 2022" in r["search_text"] and r["keywords"][:2] == ["gross", "margin"]
    assert planner.read_question("2022年毛利率")["search_text"] == "gross margin gross profit FY2022"
