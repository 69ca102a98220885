"""Corpus operators on small fixtures: nulls, empty and long texts, repeated rows, clashing columns."""

import hashlib
import random
import time
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, dac, gam, langid, media, mixing, pretokens, rules, url_templates, wrappers

CLASH = ["1 AS id", "2 AS words", "3 AS n", "'x' AS label", "4 AS `size`", "5 AS copies", "6 AS host", "7 AS `__row`", "8 AS fp", "9 AS score"]


def good(rng, n=90):
    return " ".join(rng.choice(["river", "stone", "walks", "evening", "the", "of", "light", "garden", "seven", "quiet", "and"]) + str(rng.randrange(40)) for _ in range(n)) + "."


def bad(rng, n=90):
    return " ".join("BUY" + rng.choice("#*$%") * 4 for _ in range(n))


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    rows = [(k, bad(rng) if k % 4 == 0 else good(rng, rng.randrange(60, 200)), "en" if k % 2 else "de", f"s{k % 3}") for k in range(n)]
    rows += [(n, None, None, None), (n + 1, "", "en", "s0"), (n + 2, "\n \t", None, "s1"), (None, good(rng), "en", None), (5, rows[5][1], "en", "s2"), (5, rows[5][1], "en", "s2"), (n + 3, good(rng, 30_000), "en", "s0")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).selectExpr("*", *CLASH).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, 0 if k % 4 == 0 else 1) for k in range(120)] + [(7, 1), (8, 1), (8, 0), (8, None), (None, 1), (9999, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int").selectExpr("*", "1 AS id", "2 AS mean", "3 AS label")


def test_gam(docs, none, labels):
    model = gam.fit_quality(docs, labels)
    got = gam.score_quality(docs, model, keep=("lang",)).collect()
    assert len(got) == len(corpus()) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 120)
    assert gam.score_quality(none, model).count() == 0
    empty = gam.fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in gam.score_quality(docs, empty).collect()} == {0.5}


def test_gam_bound_takes_repeated_rows_once(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(k, bad(rng, 20 + k) if k % 2 == 0 else good(rng, 20 + k)) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = []
    monkeypatch.setattr(gam, "train_gam", lambda x, y: got.append((x, y)))
    for copies in (1, 3):
        gam.fit_quality(spark.createDataFrame(texts * copies, "doc_id long, text string"), labels, max_rows=40)
    assert got[1][1].mean() == 0.5 and (got[0][0] == got[1][0]).all() and (got[0][1] == got[1][1]).all()


def score_by_hand(model, row):
    """One row, entry by entry, with bins found by counting cuts."""
    def place(cuts, v):
        return sum(1 for c in cuts if c <= v)

    total = model.base + sum(table[place(cuts, v)] for table, cuts, v in zip(model.tables, model.edges, row))
    total += sum(t[place(model.pair_edges[i], row[i])][place(model.pair_edges[j], row[j])] for i, j, t in model.pairs)
    return 1 / (1 + np.exp(-total))


def test_gam_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((500, len(gam.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 4] > 0.8).astype(float)
    model = gam.train_gam(x, y)
    got = model.score(x[:40])
    for row, score in zip(x[:40], got):
        assert score == pytest.approx(score_by_hand(model, row), abs=1e-9)


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.train_gam(x[:3000], y[:3000], pairs=1)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def brute_counts(text):
    text = text or ""
    w = text.encode().split()
    triples = list(zip(w, w[1:], w[2:]))
    seen = Counter(triples)
    covered = {p for i, t in enumerate(triples) if seen[t] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, docs, none, labels):
    learned = rules.fit_rules(docs, labels)
    assert learned
    got = rules.judge(docs, learned).collect()
    assert len(got) == len(corpus())
    texts = {(d, t) for d, t, _, _ in corpus()}
    by = {d: t for d, t in texts}
    for r in got:
        assert tuple(r[c] for c in rules.BASE) == brute_counts(by[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 120)
    assert rules.judge(none, learned).count() == 0
    assert rules.fit_rules(docs, labels.limit(0)) == []


def test_rule_statistics_on_odd_texts(spark):
    texts = ["a b c a b c", "a\n\na\nb\n a", "x", "", None, "é É  é", "a b a b a b", "a b c d\x0ba b c", "r " * 500, "# $|<\n#"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.judge(df, []).filter("n_words >= 0").collect():
        assert tuple(r[c] for c in rules.BASE) == brute_counts(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_rules_run_no_python(docs, labels):
    plan = rules.judge(docs, rules.fit_rules(docs, labels))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mix(docs, none):
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(corpus())
    again = mixing.mix_plan(docs.repartition(3)).collect()
    assert sorted(map(repr, plan)) == sorted(map(repr, again))
    sources = {}
    for r in plan:
        assert r["copies"] in (0, 1, 2)
        s = sources.setdefault(r["source"], [r["target"], 0, r["source_size"], 0])
        s[1] += r["size"] * r["copies"]
        s[3] = max(s[3], r["size"])
    assert sum(s[0] for s in sources.values()) == pytest.approx(1.5 * sum(s[2] for s in sources.values()))
    for target, taken, size, largest in sources.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= largest
    out = mixing.emit_mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in plan)
    assert mixing.mix_plan(none).count() == 0 and mixing.emit_mix(none).count() == 0


def test_mix_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r["target"] for r in mixing.mix_plan(df).collect()} == {0.0}


SPACES = ["a  b", " a", "a ", "  ", " \n", "a \n b\n\n c", "a\n  b", "a \u3000 b", "x\x1c \x1cy", "\u180e z \u200b", "a \t", "end.\nNext one,\n two", "<|endoftext|>  <|endoftext|> a", "a <|endoftext|>"]
#: Zero-width and soft hyphens, symbols, letters beyond the basic plane, combining marks, code points without a character.
WIDE = ["a\u200bb \u200d\ufeff c\u00ad", "\U0001F680\U0001F914 go\U0001F468\u200d\U0001F469", "\u20bf\U0001D400\U0001D7D8x \U00020BB7", "e\u0301 \u0301x \u1e9b\u0323 ﬁ", "\u0378 \U000E0001 \uE000", "İIı ŉ ΑΣ ǅ \u1c89\ua7da", "日本語 テスト ١٢٣ Ⅻ ²³", "re've RE'VE o'll 'S"]
ODD = [*SPACES, *WIDE, "", "It's we'll 'tis !!'s", "É Σ ς İ ß", "<|endoftext|>a<|startoftext|>", "a  b\n\tc \u00a0d", "zq qz \U0001F600 \U00020000 ١٢", "x" * 3000, "naïve café 42nd", "\x1c\x85 x"]


def test_bpe_equals_the_library(spark, none):
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    df = spark.createDataFrame([*enumerate(ODD), (None, None), (3, ODD[3])], "doc_id long, text string").selectExpr("*", *CLASH)
    rows = bpe.encode_documents(df, with_ids=True).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = ODD[r["doc_id"]] if r["doc_id"] is not None else ""
        ids = lib.encode(text, add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == decoded
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(none).count() == 0


def test_certain_cuts():
    b = bpe.word_bpe(bpe.default_vocabulary(), pretokens.classes())
    for word in (b"zqxjv", b"hello", b"qqzz", "日本".encode()):
        assert b"".join(b.cuts(word)) == word
    assert len(b.cuts(b"ab\xf0\x9f")) >= 1


def test_merges_against_brute_force():
    b = bpe.word_bpe(bpe.default_vocabulary(), pretokens.classes())

    def brute(ids):
        while True:
            best = min(((b.pairs.get(x << bpe.BITS | y, bpe.NEVER), k) for k, (x, y) in enumerate(zip(ids, ids[1:]))), default=(bpe.NEVER, 0))
            if best[0] == bpe.NEVER:
                return ids
            k = best[1]
            ids = [*ids[:k], best[0] & bpe.MASK, *ids[k + 2 :]]

    rng = random.Random(2)
    for n in (1, 2, 3, 9, 40, 150):
        for letters in ("a", "ab", "etaoinshr"):
            ids = [b.inner[ord(rng.choice(letters))] for _ in range(n)]
            want = brute(ids)
            assert b.merge(list(ids)) == b._merge_long(list(ids)) == want


def test_very_long_words():
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    b = bpe.word_bpe(bpe.default_vocabulary(), pretokens.classes())
    rng = random.Random(3)
    for word in ("a" * 50_000, "".join(rng.choices("etaoinshr", k=50_000))):
        assert b.encode(word) == lib.encode(word, add_special_tokens=False).ids
    began = time.time()
    b.encode("".join(rng.choices("etaoinshr", k=1_000_000)))
    assert time.time() - began < 60


library = lru_cache(Tokenizer.from_file)


@settings(max_examples=150, deadline=None)
@given(strategies.text(strategies.sampled_from(" \n\t\u00a0\u3000'sSaé1.,<|>\u0301\u200b\U0001F600Σ日"), max_size=30))
def test_any_text_is_encoded_like_the_library(text):
    sets = pretokens.classes()
    words, tokens = library(bpe.default_vocabulary()), library(dac.default_vocabulary())
    ids = bpe.word_bpe(bpe.default_vocabulary(), sets).encode(text)
    assert ids == words.encode(text, add_special_tokens=False).ids
    assert bpe.word_bpe(bpe.default_vocabulary(), sets).decode(ids) == words.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(dac.byte_bpe(dac.default_vocabulary(), sets).encode_all([text])[0], "<u2").tolist() == tokens.encode(text, add_special_tokens=False).ids


def test_language(spark, none):
    rng = random.Random(4)
    alphabets = {"aa": "abcdef ", "bb": "uvwxyzé ", "cc": "бвгджз "}
    rows = [(k, "".join(rng.choices(alphabets[x], k=80)), x) for k, x in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(200, None, "aa"), (201, "12 34 !", "bb"), (202, "", None), (None, "abc def abc", None), (0, rows[0][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", *CLASH)
    prototypes = langid.train_prototypes(df, "text", "lang", "doc_id")
    assert sorted(prototypes) == ["aa", "bb", "cc"]
    got = langid.predict_language(df, prototypes).collect()
    want = {k: x for k, _, x in rows}
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 90)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (200, 201, 202)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    assert langid.predict_language(none, prototypes).count() == 0
    assert {r["lang_pred"] for r in langid.predict_language(df, {}).collect()} == {"und"}


def test_language_sample_is_bounded_whatever_the_ids(spark):
    rng = random.Random(7)
    texts = [("".join(rng.choices("abcdef ", k=60)), "aa") for _ in range(400)] + [("".join(rng.choices("uvwxyz ", k=60)), "bb") for _ in range(400)]
    got = []
    for ids in ([None] * 800, [5] * 800):
        df = spark.createDataFrame([(i, t, x) for i, (t, x) in zip(ids, texts)], "doc_id long, text string, lang string")
        prototypes = langid.train_prototypes(df, "text", "lang", "doc_id", max_docs=40)
        # Normalised vectors are summed, so the sum's length is at most their number.
        got.append({x: np.linalg.norm(v) for x, v in prototypes.items()})
    assert all(set(g) == {"aa", "bb"} and all(5 < n < 80 for n in g.values()) for g in got)


def test_predictions_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(k, "".join(rng.choices("abcdefgh " if k % 2 else "efghijkl ", k=40)), "xy"[k % 2]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = langid.train_prototypes(df, "text", "lang", "doc_id")
    unit = {k: v / np.linalg.norm(v) for k, v in ((k, langid.bundle([t])[0].astype(float)) for k, t, _ in rows)}
    want = {x: sum(unit[k] for k, _, lang in rows if lang == x) for x in "xy"}
    assert all(np.allclose(prototypes[x], want[x], atol=1e-3) for x in "xy")
    mean = sum(v / np.linalg.norm(v) for v in want.values()) / 2
    centred = {x: v / np.linalg.norm(v) - mean for x, v in want.items()}
    for r in langid.predict_language(df, prototypes).collect():
        v = unit[r["doc_id"]] - mean
        cosine = {x: v @ c / np.linalg.norm(v) / np.linalg.norm(c) for x, c in centred.items()}
        assert r["lang_pred"] == max(cosine, key=cosine.get)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-langid.SHARPNESS * abs(cosine["x"] - cosine["y"]))), abs=1e-3)


def test_bundles_are_sums_of_bound_letters():
    text = "abca"
    letters = [0, *map(ord, text), 0]
    want = np.zeros(langid.DIM)
    for n in langid.GRAMS:
        for i in range(len(letters) - n + 1):
            v = np.ones(langid.DIM)
            for k in range(n):
                v *= np.roll(langid.letter_vector(letters[i + n - 1 - k]), k)
            want += v
    assert np.allclose(langid.bundle([text])[0], want)


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65536, 2**32 - 1], list(range(0, 3000, 7)), [5] * 600 + [50000] * 600])
def test_dac_round_trip(ids):
    block = dac.DacBlock(dac.dac_encode(np.array(ids, np.uint32)))
    assert block.all().tolist() == ids and [block[k] for k in range(len(block))] == ids
    with pytest.raises(IndexError):
        block[len(ids)]


def test_token_files(spark, none):
    lib = Tokenizer.from_file(dac.default_vocabulary())
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (3, ODD[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *CLASH).repartition(3)
    start = 0
    got = dac.round_trip(df).orderBy("start").collect()
    for r, (k, t) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (k, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert dac.round_trip(none).count() == 0


def test_token_files_with_equal_and_null_ids(spark, monkeypatch):
    lib = Tokenizer.from_file(dac.default_vocabulary())
    monkeypatch.setattr(dac, "BLOCK_TOKENS", 40)
    rows = [(7, f"text {k % 5} of one id") for k in range(60)] + [(None, "no id"), (None, None), (1, "first")]
    got = dac.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, *[7] * 60, None, None]
    sums = sorted(zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in rows)
    assert sorted(r["ids_crc32"] for r in got) == sums
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()


def test_tokens_are_read_by_position(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(dac, "BLOCK_TOKENS", 300)
    rows = [(k, good(rng, rng.randrange(1, 900))) for k in range(40)] + [(50, "")]
    path = str(tmp_path / "tokens")
    dac.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path)
    lib = Tokenizer.from_file(dac.default_vocabulary())
    want = [i for _, t in rows for i in [*lib.encode(t, add_special_tokens=False).ids, 0]]
    asked = [0, 1, len(want) - 1, len(want), len(want) + 10_000, -1, 5, 5, *rng.sample(range(len(want)), 200)]
    positions = spark.createDataFrame([(k,) for k in asked], "position long")
    got = {r["position"]: r["token"] for r in dac.tokens_at(spark, path, positions).collect()}
    assert got == {k: want[k] for k in asked if 0 <= k < len(want)}


@pytest.mark.parametrize("kind", ["pgm", "ppm", "bmp"])
def test_media_round_trip(kind):
    image = np.random.default_rng(1).integers(0, 256, (7, 5, 3), np.uint8)
    image = image[:, :, 0] if kind == "pgm" else image
    assert (media.decode_media(media.encode_media(image, kind)) == image).all()


def bmp(bits, w, h, rows, table=b"", masks=b""):
    at = 54 + len(table) + len(masks)
    head = b"BM" + np.array([at + len(rows), 0, at, 40], "<u4").tobytes() + np.array([w, h], "<i4").tobytes() + np.array([1, bits], "<u2").tobytes()
    return head + np.array([3 if masks else 0, len(rows), 0, 0, len(table) // 4, 0], "<u4").tobytes() + masks + table + rows


PALETTE = bytes([0, 0, 0, 0, 255, 0, 0, 0, 3, 2, 1, 0])  # black, blue, (1, 2, 3)


@pytest.mark.parametrize(
    "data, want",
    [
        (b"P1\n# c\n3 2\n1 0 1\n011", [[0, 255, 0], [255, 0, 0]]),
        (b"P4\n3 2\n" + bytes([0b10100000, 0b01100000]), [[0, 255, 0], [255, 0, 0]]),
        (b"P2\n2 1\n15\n15 3", [[255, 51]]),
        (b"P3 1 1 255 1 2 3", [[[1, 2, 3]]]),
        (b"P5 2 1 65535\n" + bytes([1, 2, 255, 255]), [[258, 65535]]),
        (b"P6 1 1 1023\n" + bytes([3, 255, 0, 0, 0, 0]), [[[65535, 0, 0]]]),
        (bmp(1, 2, 1, bytes([0b01000000, 0, 0, 0]), PALETTE[:8]), [[[0, 0, 0], [0, 0, 255]]]),
        (bmp(4, 3, 1, bytes([0x12, 0x00, 0, 0]), PALETTE), [[[0, 0, 255], [1, 2, 3], [0, 0, 0]]]),
        (bmp(8, 1, 2, bytes([2, 0, 0, 0, 1, 0, 0, 0]), PALETTE), [[[0, 0, 255]], [[1, 2, 3]]]),
        (bmp(16, 1, -1, np.array([0x7C1F, 0], "<u2").tobytes()), [[[255, 0, 255]]]),
        (bmp(32, 1, 1, bytes([3, 2, 1, 9])), [[[1, 2, 3]]]),
        (bmp(32, 1, 1, bytes([1, 2, 3, 9]), masks=np.array([0xFF, 0xFF00, 0xFF0000], "<u4").tobytes()), [[[1, 2, 3]]]),
    ],
)
def test_media_depths(data, want):
    assert media.decode_media(data).tolist() == want


def test_media_without_image(spark):
    rows = [(1, 3, None), (2, 3, b"GIF89a"), (3, 3, b""), (4, 3, b"P5 9 9 255\nx"), (5, 3, b"P5\n1 1\n255\n\x07")]
    got = {r["doc_id"]: r for r in media.media_features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(got) == 5 and all(got[k]["payload_sha256"] is None and got[k]["tile_npy"] is None for k in range(1, 5))
    assert got[1]["media_bytes"] is None and got[2]["media_sha256"] == hashlib.sha256(b"GIF89a").hexdigest() and got[5]["payload_bytes"] == 1


def test_area_resize_against_brute_force():
    image = np.random.default_rng(2).integers(0, 256, (6, 8)).astype(float)
    fine = np.repeat(np.repeat(image, 5, 0), 3, 1)  # 30 x 24, divisible by 5 x 6
    assert np.allclose(media.area_resize(image, 5, 6), fine.reshape(5, 6, 6, 4).mean(axis=(1, 3)))


def test_media_columns(spark, none):
    texts = ["", None, "abc", "é" * 64, "abc", "long " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", *CLASH)
    rows = {r["doc_id"]: r for r in media.text_media_features(df).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert np.load(__import__("io").BytesIO(r["tile_npy"])).shape == (16, 16)
    assert rows[2][2:] == rows[4][2:] and rows[0]["feature"] == rows[1]["feature"]
    assert media.text_media_features(none).count() == 0


def page(title, body, notice="Accept all cookies now"):
    return (
        f"<html><head><title>{title}</title><script>var a='<p>';</script></head><body><nav><a href='/'>Home</a></nav><div class=ad>Buy</div>"
        f"<div><p>{notice}</p><p>{body}</p></div><div id='comments'><p>nice</p></div><footer>(c)</footer><aside>s</aside><form>f</form></body></html>"
    )


def test_wrappers(spark):
    rows = [(k, f"http://H.example/{k}", page(f"t{k}", f"Body &amp; text {k}  of\npage")) for k in range(12)]
    rows += [(100, "http://other.example/", "<article><h1>T</h1><p>one<p>two <b>bold</b><br>x</article><p>out</p>"), (101, None, None), (102, "x", ""), (103, "http://few.example/", page("t", "b"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *CLASH)
    got = {r["page_id"]: r for r in wrappers.extract_main_text(df).collect()}
    assert all(got[k]["text"] == f"Body & text {k} of page" for k in range(12))  # the notice is template
    assert got[100]["text"] == "T\none\ntwo bold x" and got[101]["text"] == got[102]["text"] == ""
    assert got[103]["text"] == "Accept all cookies now\nb"  # too few pages for a template
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert wrappers.extract_main_text(df.limit(0)).count() == 0


def test_copies_are_no_template(spark):
    rows = [(k, "http://h.example/", page("t", "same body")) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.extract_main_text(df).collect()} == {"Accept all cookies now\nsame body"}


def test_tree_match():
    assert wrappers.tree_match("#(a(b,c*),d)", "#(a(x,c),d)") == [0, 1, -1, 3, 4]
    assert wrappers.tree_match("#(a)", "#(a)") == [0, 1]
    deep = "<div>" * 5000 + "x"
    assert wrappers.parse_page(deep)[1][0][1] == "x"
    assert wrappers.parse_page("<a '" * 3000)[1] == []


def read_tree(skeleton):
    """(label, kids, node) of a skeleton's root, nodes numbered in preorder."""
    labels, parents = wrappers.read_skeleton(skeleton)
    trees = [(label, [], k) for k, label in enumerate(labels)]
    for k, p in enumerate(parents):
        if p >= 0:
            trees[p][1].append(trees[k])
    return trees[0]


def most_matched(a, b):
    """Simple tree matching by its definition."""
    if a[0] != b[0]:
        return 0
    table = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, c in enumerate(a[1], 1):
        for j, d in enumerate(b[1], 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + most_matched(c, d))
    return 1 + table[-1][-1]


def test_tree_match_against_brute_force():
    rng = random.Random(3)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randrange(5))] if depth else []
        return rng.choice("abc") + ("(" + ",".join(kids) + ")" if kids else "")

    for _ in range(80):
        a, b = "#(" + tree(3) + "," + tree(3) + ")", "#(" + tree(3) + "," + tree(3) + ")"
        got = wrappers.tree_match(a, b)
        (la, pa), (lb, pb) = wrappers.read_skeleton(a), wrappers.read_skeleton(b)
        found = [(x, y) for x, y in enumerate(got) if y >= 0]
        assert len(found) == most_matched(read_tree(a), read_tree(b))
        assert all(la[x] == lb[y] for x, y in found) and [y for _, y in found] == sorted({y for _, y in found})
        assert all(got[pa[x]] == pb[y] for x, y in found if x)
    items = ",".join(f"p.{'ab'[k % 2]}" for k in range(2500))
    large = wrappers.tree_match(f"#(p.b,{items},p.notice)", f"#({items},p.notice)")
    # The extra sibling stays alone; all later ones keep their nodes.
    assert large[1] == -1 and large[2:] == list(range(1, 2502))
    deep = [wrappers.parse_page("<div>" * 3000 + tail)[0] for tail in ("<p>x", "<ul>x")]
    assert wrappers.tree_match(*deep)[:3001] == list(range(3001))


def test_induction_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for h, n in (("a.x", 1), ("b.x", 2), ("c.x", 3), ("d.x", 12), ("e.x", 30)):
        for k in range(n):
            body = "".join(f"<p>{good(rng, rng.randrange(5, 30))}</p>" for _ in range(rng.randrange(2, 6)))
            extra = "<blockquote><p>now and then</p></blockquote>" if rng.random() < 0.4 else ""
            rows.append((len(rows), f"http://{h}/{k}", f"<body><div><p>Notice of {h}</p>{extra}<section>{body}</section><p>All rights of {h}</p></div></body>"))
        rows.append((len(rows), f"http://{h}/copy", rows[-1][2]))  # an exact copy counts once
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    parsed = {k: wrappers.parse_page(html) for k, _, html in rows}
    for host in ("a.x", "b.x", "c.x", "d.x", "e.x"):
        own = [k for k, url, _ in rows if f"//{host}/" in url]
        shapes = Counter(parsed[k][0] for k in own)
        pages = {tuple(t for _, t, _ in parsed[k][1]): k for k in own}
        template = set()
        if len(pages) >= 3:
            tops = [s for s, n in shapes.items() if n == max(shapes.values())]
            for base in tops[:1] if len(tops) == 1 else tops:
                seen = Counter(x for k in pages.values() for x in {(wrappers.tree_match(parsed[k][0], base)[n], t) for n, t, _ in parsed[k][1]})
                template = {t for (node, t), n in seen.items() if node >= 0 and n >= 0.9 * len(pages)}
        assert len(pages) < 3 or template == {f"Notice of {host}", f"All rights of {host}"}
        for k in own:
            assert got[k] == "\n".join(t for _, t, _ in parsed[k][1] if t not in template)


def test_marks_drop_no_article_text(spark):
    body = "<p>" + "main text " * 20 + "</p>"
    pages = [
        f'<article>{body}<p>see <a href="/x?id=reply" data-id="share">this link</a></p></article>',
        f'<article>{body}<h2 id="social-impact">Impact</h2><section id="search-results" class="ad-hoc">Found</section><div class="share">no</div></article>',
        f'<div><div id="cookie-box">no</div>{body}</div><article class=card>teaser</article>',
        f'<div id="related-links"><p>no</p></div><article>{body}</article><p>out</p>',
    ]
    df = spark.createDataFrame([(k, f"http://h{k}.x/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = [r["text"] for r in wrappers.extract_main_text(df).orderBy("page_id").collect()]
    text = ("main text " * 20).strip()
    assert got == [text + "\nsee this link", text + "\nImpact\nFound", text + "\nteaser", text]


def test_names_around_or_inside_the_article_lose_nothing(spark):
    body = "<p>" + "main text " * 20 + "</p>"
    inside = (
        '<h2 class="comment">A comment</h2><p>Costs <span class="share-price">12</span> at <a class="hidden-link">this shop</a>, if <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p>'
        '<section class="promotion-history"><p>Promoted in 1990.</p></section>'
    )
    want = ("main text " * 20).strip() + "\nA comment\nCosts 12 at this shop, if x=1.\nPromoted in 1990."
    pages = [
        f'<div class="layout with-sidebar"><article>{body}{inside}</article></div>',
        f'<div class="content no-sidebar">{body}{inside}</div>',
        f'<div class="sidebar"><h1>T</h1>{body}{inside}</div>',
        f'{body}{inside}<div class="entry">teaser</div>',
        f'<article>{body}{inside}<div class="comments"><p>{"nice " * 200}</p></div><p class="ad">Buy</p></article>',
        f'<div><div>{body}{inside}</div><div class="user-comments"><p>{"nice " * 200}</p></div></div>',
    ]
    rows = [(k, f"http://h{k}.x/", p) for k, p in enumerate(pages)] + [(9, None, pages[0]), (9, None, pages[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *CLASH)
    got = [(r["page_id"], r["text"]) for r in wrappers.extract_main_text(df).orderBy("page_id").collect()]
    texts = [want, want, "T\n" + want, want + "\nteaser", want, want]
    assert got == [*enumerate(texts), (9, want), (9, want)]


def test_a_notice_goes_from_three_pages_on_and_near_copies_stay_whole(spark):
    rng = random.Random(6)
    rows = [(k, f"http://few.x/{k}", page("t", good(rng, 40))) for k in range(3)]
    long_body = "".join(f"<p>{good(rng, 30)}</p>" for _ in range(9))
    rows += [(10 + k, f"http://near.x/{k}", f"<article>{long_body}<p>edition {k}</p></article>") for k in range(5)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("cookies" not in got[k] and len(got[k]) > 100 for k in range(3))
    assert all(got[10 + k].count("\n") == 9 and got[10 + k].endswith(f"edition {k}") for k in range(5))


def test_url_rules_and_parts(spark):
    cases = [
        ("http://A.b.NET/x?q", "a.b.net", "/x", "net/", "block"),
        ("https://example.net/en/1#t", "example.net", "/en/1", "example.net/en/", "allow"),
        ("https://w.example.com/de/1", "w.example.com", "/de/1", "example.com/de/", "block"),
        ("http://x.org/fr/9", "x.org", "/fr/9", "org/fr/", "allow"),
        ("http://notnet/en/", "notnet", "/en/", None, "allow"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)] + [(0, cases[0][0])], "page_id long, url string").selectExpr("*", *CLASH)
    rows = url_templates.judge_urls(df).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        _, host, path, rule, verdict = cases[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
    assert url_templates.judge_urls(df.limit(0)).count() == 0


def test_url_templates_reject_by_purity(spark):
    rows = [(k, f"http://h.x/spam/{k}/a", 1) for k in range(40)] + [(k + 100, f"http://h.x/news/{k}/a", 0) for k in range(40)]
    rows += [(k + 200, f"http://h.x/{s}/9{k}/a", None) for k, s in enumerate(["spam", "news", "spam"])]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r["page_id"]: r for r in url_templates.judge_urls(df, rules=(), label_col="bad").collect()}
    assert [got[200 + k]["verdict"] for k in range(3)] == ["block", "allow", "block"]
    assert got[200]["template"] == "/spam/*/a" and got[201]["template"] == "/news/*/a"


def test_small_sections_are_judged_by_their_own_labels(spark):
    urls = [(f"/en/{k}", 0) for k in range(900)] + [(f"/spam/{k}", 1 if k < 30 else None) for k in range(40)]
    urls += [(f"/s{j}/{k}", 0 if k < 10 else None) for j in range(4) for k in range(15)] + [(f"/plain/{k}", None) for k in range(20)]
    rows = [(k, f"http://hot.x{path}", bad) for k, (path, bad) in enumerate(urls)]
    # /de/ has under 5 % of the urls and all labels; /fr/ and /it/ have none.
    other = [(f"/en/{k}", None) for k in range(200)] + [(f"/de/{k}", 1) for k in range(6)] + [(f"/fr/{k}", None) for k in range(6)] + [("/it/1", None)]
    rows += [(k + 5000, f"http://w.y{path}", bad) for k, (path, bad) in enumerate(other)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = url_templates.judge_urls(df, rules=(), label_col="bad").collect()
    blocked = {(r["host"], r["path"]) for r in got if r["verdict"] == "block"}
    assert blocked == {("hot.x", f"/spam/{k}") for k in range(40)} | {("w.y", f"/de/{k}") for k in range(6)}


def test_many_sections_keep_their_own_verdicts(spark):
    rows = [(100 * j + k, f"http://h.x/s{j}/{k}", j % 2) for j in range(60) for k in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = url_templates.judge_urls(df, rules=(), label_col="bad").collect()
    assert len(got) == 600 and all((r["verdict"] == "block") == (r["page_id"] // 100 % 2 == 1) for r in got)


def test_deep_paths_are_told_apart(spark):
    rows = [(100 * j + k, f"http://h.x/a/b/c/d/e/f/{s}/{k}", None if k == 29 else j) for j, s in enumerate(("news", "spam")) for k in range(30)]
    rows += [(300 + k, f"http://clean.x/a/b/c/d/e/f/g/{k}", 0) for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r["page_id"]: r for r in url_templates.judge_urls(df, rules=(), label_col="bad").collect()}
    assert all((r["verdict"] == "block") == (100 <= k < 200) for k, r in got.items()) and len(got) == 65
    assert got[129]["template"] == "/a/b/c/d/e/f/spam/**" and got[300]["template"] == "/a/b/c/d/e/**"


def test_pipeline_keeps_clean_and_drops_bad(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    sf = tmp_path / "sf"
    rows = corpus()[:120] + [(500, None, None, "s0"), (501, corpus()[1][1], "de", "s1")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text"))
    frame.write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(k, 0 if k % 4 == 0 else 1, 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
    docs = spark.read.parquet(str(sf / "documents.parquet"))
    kept = corpus_pipeline.quality(spark, corpus_pipeline.language(spark, docs, str(sf)), str(sf))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k in range(120) if k % 4} | {501}
    once = corpus_pipeline.near_duplicates(spark, kept, str(sf))
    assert {r["doc_id"] for r in once.collect()} == {k for k in range(120) if k % 4}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mix_sources", "bpe_encode"]
    out = corpus_pipeline.run(spark, str(sf))
    assert set(out.columns) >= {"doc_id", "n_tokens"} and out.count() > 0
