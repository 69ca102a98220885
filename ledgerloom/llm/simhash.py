"""SimHash near-duplicates: 64-bit fingerprints, tiled exact comparison, connected components.

Fingerprints within ``radius`` bits of each other are linked. Candidate groups come from an exact
pigeonhole split: of ``radius + match`` bit blocks, two linked fingerprints agree on at least
``match``, so a group per choice of blocks and their values misses no link. Inside a group, sorted
by population count, tiles are compared by numpy exclusive-or and bit counts, and tile pairs whose
population counts differ by more than the radius are skipped. Groups beyond ``TILE_ROWS`` are cut
into tiles whose pairs are separate tasks' work, so no task holds an unbounded group. A task emits
a spanning forest of its links, never all pairs.

``match`` is the least number whose groups would, of evenly spread fingerprints, be below one tile;
any number finds the same links. Joins by a fingerprint, component or node that many rows share are
salted: what it is joined with is repeated for each salt where more than one row asks for it.

Defined results: null or empty texts have fingerprint zero and are linked like any other; equal
texts have equal fingerprints and so one component; repeated rows keep their own output rows; a
component whose ids are all null has a null component_id; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from .common import arrow_map, fresh, materialize

RADIUS = 4
#: Rows of one tile of a large group; a task compares two tiles.
TILE_ROWS = 8192
#: Tasks over which the rows of one key are spread in joins.
SALTS = 16
#: Rows of the inner tiles that numpy compares at once.
INNER = 512


def shingle_hashes(text: bytes | None, width: int = 4) -> list[int]:
    """XXH64 (seed 42) of every word shingle of a text, repeats included."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    h = xxhash.xxh64_intdigest
    return [h(joined[s : e - 1], 42) for s, e in zip(starts, starts[width:])]


def majority_bits(hashes: list[int]) -> int:
    """The fingerprint: bits set in over half of the hashes."""
    if not hashes:
        return 0
    a = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(a), 1 << 15):
        part = a[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id, fp (the fingerprint as a signed 64-bit integer) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [majority_bits(shingle_hashes(t, width)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(slim, run, f"id {dict(slim.dtypes)['id']}, fp long")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect exactly the fingerprints linked within ``fps`` (uint64)."""
    n = len(fps)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pops = np.bitwise_count(fps)
    order = np.argsort(pops, kind="stable")
    a, p = fps[order], pops[order].astype(np.int64)
    for i in range(0, n, INNER):
        x = a[i : i + INNER]
        for j in range(i, n, INNER):
            if p[j] - p[min(i + INNER, n) - 1] > radius:
                break
            near = np.bitwise_count(x[:, None] ^ a[None, j : j + INNER]) <= radius
            if i == j:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            left, right = np.arange(i, i + len(x)), np.arange(j, j + near.shape[1])
            while True:  # smallest linked index, until nothing changes
                new_right = np.minimum(right, np.where(near, left[:, None], n).min(axis=0))
                new_left = np.minimum(left, np.where(near, new_right[None, :], n).min(axis=1))
                if i == j:
                    new_left = new_right = np.minimum(new_left, new_right)
                if (new_left == left).all() and (new_right == right).all():
                    break
                left, right = new_left, new_right
            for base, labels in ((i, left), (j, right)):
                for k in np.flatnonzero(labels != np.arange(base, base + len(labels))):
                    u, v = root(int(base + k)), root(int(labels[k]))
                    if u != v:
                        parent[max(u, v)] = min(u, v)
    return [(int(order[k]), int(order[r])) for k in range(n) if (r := root(k)) != k]


def block_keys(fp: Column, radius: int, match: int) -> Column:
    """Array of (choice, value): the bits of ``match`` of the blocks, for every choice of blocks."""
    count = radius + match
    edges = [64 * k // count for k in range(count + 1)]
    keys = []
    for c, chosen in enumerate(combinations(range(count), match)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(c).alias("choice"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("value")))
    return F.array(*keys)


def blocks_to_match(count: int, radius: int, tile_rows: int = TILE_ROWS) -> int:
    """The least ``match`` of which a group of ``count`` evenly spread fingerprints has no more than ``tile_rows``."""
    return next((m for m in range(1, 4) if count <= tile_rows << 64 * m // (radius + m)), 4)


def salt(c: Column | str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")


def salts(rows: Column, only: Column) -> Column:
    """Every salt for a key that more than one row asks for, else the salt of the one that does."""
    return F.explode(F.when(rows > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(salt(only))))


def link_forest(distinct: DataFrame, radius: int = RADIUS, match: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """a, b: pairs of the distinct fingerprints ``fp`` that span every linked component."""
    spark = distinct.sparkSession
    ship_package(spark)
    if match is None:
        match = blocks_to_match(distinct.count(), radius, tile_rows)
    keyed = distinct.select("fp", F.inline(block_keys(F.col("fp"), radius, match)))
    large = keyed.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile_rows)
    tiles = F.coalesce(F.ceil(F.col("n") / tile_rows), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    spread = (
        keyed.join(large, ["choice", "value"], "left")
        .withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("choice", "value", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "fp")
    )
    key = ["choice", "value", "t1", "t2"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(groups: np.ndarray) -> pa.RecordBatch:
            """groups: columns choice, value, t1, t2, fp; whole groups in order."""
            cuts = np.flatnonzero((groups[1:, :4] != groups[:-1, :4]).any(axis=1)) + 1
            pairs: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(groups)]):
                if hi - lo > 1:
                    fps = groups[lo:hi, 4]
                    pairs += [(int(fps[i]), int(fps[j])) for i, j in forest(fps.view(np.uint64), radius)]
            flat = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])

        for b in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or (held[-1][-1, :4] != rows[0, :4]).any()):
                yield edges(np.ascontiguousarray(np.concatenate([*held, rows[:cut]])))
                held = []
            elif cut:
                yield edges(np.ascontiguousarray(rows[:cut]))
            held.append(rows[cut:])
        if held:
            yield edges(np.ascontiguousarray(np.concatenate(held)))

    return spread.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): rounds of contraction into the smallest neighbour.

    Ids are mixed by a bijective hash first, so that a chain shrinks by a constant factor each round
    whatever its order. Only minima are aggregated; neighbours are never collected.
    """
    mixed = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    live = materialize(_tidy(mixed), "edges")
    parents: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
        parent = materialize(least.select("a", F.least("least", "a").alias("p"), "least", "n"), "parents")
        parents.append(parent)
        # Of an edge each end looks up its parent; the other end salts the key.
        pa_ = parent.select("a", F.col("p").alias("pa"), salts(F.col("n"), F.col("least")).alias("s"))
        pb_ = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"), salts(F.col("n"), F.col("least")).alias("s"))
        first = live.withColumn("s", salt("b")).join(pa_, ["a", "s"]).drop("s")
        moved = first.withColumn("s", salt("a")).join(pb_, ["b", "s"]).select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        live = materialize(_tidy(moved), "edges")
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    roots = parents[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for parent in parents[1:]:
        step = parent.select(F.col("a").alias("root"), F.col("p").alias("next"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        roots = roots.withColumn("s", salt("node")).join(step, ["root", "s"], "left").select("node", F.coalesce("next", "root").alias("root"))
    return roots


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS, match: int | None = None
) -> DataFrame:
    """id, fp, group_id (equal for one component), component_id (its smallest id) for every row."""
    marked = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = materialize(components(link_forest(distinct.select("fp"), radius, match)), "roots")
    placed = distinct.withColumn("node", F.xxhash64("fp")).join(roots, "node", "left").withColumn("group_id", F.coalesce("root", "node"))
    placed = materialize(placed.select("fp", "first_id", "n", "group_id"), "placed")
    # A fingerprint without links is its own component and needs no lookup.
    least = placed.groupBy("group_id").agg(F.min("first_id").alias("least_id"), F.count(F.lit(1)).alias("fps")).filter("fps > 1")
    least = least.select("group_id", "least_id", F.lit(True).alias("many"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    named = placed.withColumn("s", salt("fp")).join(least, ["group_id", "s"], "left").withColumn("component_id", F.when(F.col("many"), F.col("least_id")).otherwise(F.col("first_id")))
    answers = named.select("fp", "group_id", "component_id", salts(F.col("n"), F.col("first_id")).alias("s"))
    return marked.withColumn("s", salt("id")).join(answers, ["fp", "s"]).select("id", "fp", "group_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of the smallest id."""
    row, key = fresh(docs, "__row"), fresh(docs, "__key")
    marked = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    by_id = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    groups = near_duplicate_groups(marked.withColumn(key, by_id), key, text_col, **options)
    kept = groups.groupBy("group_id").agg(F.min("id").alias("first")).select(F.col("first.row").alias(row))
    return marked.join(kept, row, "left_semi").select(*docs.columns)
