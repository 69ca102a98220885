"""SimHash components against brute force."""

import random

import xxhash

from ledgerloom.llm.simhash import near_duplicate_groups


def brute(rows):
    fps = {}
    for i, (d, t) in enumerate(rows):
        words = (t or "").encode().lower().split()
        sh = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    comp = {i: i for i in fps}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in fps:
        for j in fps:
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    least = {}
    for i in fps:
        d = rows[i][0]
        r = root(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return sorted(((rows[i][0], fps[i], least[root(i)]) for i in fps), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    rows = []
    for d in range(60):
        words = rng.choices(vocab, k=rng.choice([1, 3, 5, 40, 300]))
        rows.append((d, " ".join(words)))
        for k in range(rng.choice([0, 0, 2, 4])):
            w = list(words)
            if len(w) > 40:
                w[rng.randrange(len(w))] = "x"
            rows.append((100 + len(rows), "\n".join(w).upper() if k == 0 else " ".join(w)))
    rows += [(None, ""), (500, None), (501, "  \t"), (7, rows[0][1]), (7, rows[0][1]), (502, "é È long " * 5000)]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS id", "3 AS root")
    out = near_duplicate_groups(df, **options).collect()
    return sorted(((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in out), key=str)


def test_matches_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_more_matched_blocks_lose_nothing(spark):
    rows = corpus(2)
    assert run(spark, rows, match=2) == brute(rows)


def test_split_groups_lose_nothing(spark, monkeypatch):
    from ledgerloom.llm import simhash

    fps = [(k * 0x9E3779B97F4A7C15) % (1 << 62) for k in range(40)]
    fps += [f ^ (1 << 63 - 1) ^ 3 for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = simhash.components(simhash.link_forest(df)).groupBy("root").count().count()
    split = simhash.components(simhash.link_forest(df, tile_rows=2)).groupBy("root").count().count()
    assert whole == split == 40


def test_empty_table(spark):
    assert run(spark, []) == []


def test_keep_one(spark):
    from ledgerloom.llm.simhash import keep_one

    df = spark.createDataFrame([(3, "a b c d e"), (1, "A b c d e"), (1, "A b c d e"), (None, "z")], "doc_id long, text string")
    assert sorted(map(str, (r[0] for r in keep_one(df).collect()))) == ["1", "None"]


def test_number_of_blocks():
    from ledgerloom.llm import simhash

    assert [simhash.blocks_to_match(n, 4) for n in (0, 10**6, 3 * 10**7, 10**9, 10**11, 10**13)] == [1, 1, 1, 2, 3, 4]


def test_hot_fingerprints_and_groups(spark):
    rows = [(k, "" if k % 3 else f"one text {k % 7} of many words and so on") for k in range(300)] + [(None, "alone with no number at all"), (None, None)]
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 302
    by = {}
    for r in got:
        by.setdefault(r["fp"], set()).add((r["group_id"], r["component_id"]))
    assert all(len(v) == 1 for v in by.values())
    assert {r["component_id"] for r in got if r["fp"] == 0} == {1}
    assert [r["component_id"] for r in got if r["id"] is None and r["fp"] != 0] == [None]
