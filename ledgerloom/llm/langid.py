"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. An n-gram binds its letters' vectors, each rotated by its
place, by elementwise products; a document bundles (sums) the vectors of all its n-grams; a
language's prototype sums the normalised vectors of its training documents. Prediction is the
prototype of largest cosine, after the mean of all prototypes is taken out of each.

Training takes about ``max_docs`` documents of each language (all, where there are fewer), chosen
by a hash of id and text, of which equal ones count once; the texts are read whole. What the driver
gets is one vector per language.

Defined results: a text that is null or has no letter gives ``und`` with score 0; null languages
are not learned; with nothing to learn from, every text is ``und``; ties go to the label first in
order; repeated rows and extra columns have no effect on other rows; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_chunks

DIM = 1024
GRAMS = (2, 3)
MAX_DOCS = 2000
UNKNOWN = "und"
#: How sharply cosines become the score.
SHARPNESS = 25.0
#: n-grams whose vectors are held at once.
BLOCK = 4096
#: Documents bundled at once.
GROUP = 128


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """For every code point its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=50_000)
def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    """The random signs of one letter; code 0 is the gap between words."""
    return (np.random.Generator(np.random.PCG64(code + 7)).integers(0, 2, dim, dtype=np.int8) * 2 - 1).astype(np.float32)


def _letters(text: str) -> np.ndarray:
    """Lower-case letters of a text, every run of anything else as one 0."""
    codes = _fold()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not codes.any():
        return codes[:0]
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def bundle(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """One row for each text: the sum of its n-gram vectors."""
    out = np.zeros((len(texts), dim), np.float32)
    letters = [_letters(t) if t else np.zeros(0, np.uint32) for t in texts]
    alphabet, coded = np.unique(np.concatenate([*letters, np.zeros(1, np.uint32)]), return_inverse=True)
    base = len(alphabet)
    vectors = np.stack([letter_vector(int(c), dim) for c in alphabet])
    bounds = np.cumsum([0, *map(len, letters)])
    for n in GRAMS:
        docs, grams = [], []
        for d, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if hi - lo >= n:
                code = np.zeros(hi - lo - n + 1, np.int64)
                for k in range(n):
                    code = code * base + coded[lo + k : hi - n + 1 + k]
                seen, count = np.unique(code, return_counts=True)
                docs.append((d, seen, count))
        if not docs:
            continue
        grams = np.unique(np.concatenate([s for _, s, _ in docs]))
        for at in range(0, len(grams), BLOCK):
            part = grams[at : at + BLOCK]
            bound = np.ones((len(part), dim), np.float32)
            rest = part.copy()
            for k in range(n):
                bound *= np.roll(vectors, k, axis=1)[rest % base]
                rest //= base
            counts = np.zeros((len(texts), len(part)), np.float32)
            for d, seen, count in docs:
                lo, hi = np.searchsorted(seen, [part[0], part[-1] + 1])
                counts[d, np.searchsorted(part, seen[lo:hi])] = count[lo:hi]
            out += counts @ bound
    return out


def _normal(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def _bundled(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, vectors) over a batch, with bounded memory."""
    texts = batch.column(column).to_pylist()
    ends = np.cumsum([0, *(len(t or "") for t in texts)])
    for lo, hi in text_chunks(ends):
        for at in range(lo, hi, GROUP):
            to = min(at + GROUP, hi)
            yield at, to, bundle(texts[at:to])


def train_prototypes(docs: DataFrame, text_col: str, label_col: str, id_col: str, max_docs: int = MAX_DOCS) -> dict[str, np.ndarray]:
    """The prototype of each label of ``docs``."""
    slim = docs.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    sizes = slim.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("n"))
    picked = (
        slim.join(F.broadcast(sizes.select("label", share.alias("share"))), "label")
        .filter(F.pmod(F.xxhash64(F.lit("langid"), "id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
        .select("label", "id", "text")
        .distinct()  # equal rows share a hash and would come in all together
        .select("label", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            labels = b.column(0).to_pylist()
            for lo, hi, rows in _bundled(b, 1):
                for label, row in zip(labels[lo:hi], _normal(rows)):
                    if label in sums:
                        sums[label] += row
                    else:
                        sums[label] = row.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["label", "v"]
        )

    partial = arrow_map(picked, run, "label string, v array<double>")
    total = partial.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in total.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).collect():
        out[r["label"]] = np.round([x["x"] for x in r["v"]], 6)
    return out


def predict_language(
    docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """id, lang_pred, score (and the columns ``keep``) for every row."""
    labels = sorted(prototypes)
    profile = _normal(np.stack([prototypes[x] for x in labels])) if labels else np.zeros((0, DIM))
    mean = profile.mean(axis=0) if len(labels) > 1 else np.zeros(DIM)
    centred = _normal(profile - mean).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for lo, hi, rows in _bundled(b, 1):
                known = np.abs(rows).sum(axis=1) > 0
                if not len(labels) or not known.any():
                    continue
                cosine = _normal(_normal(rows) - mean) @ centred.T
                odds = np.exp((cosine - cosine.max(axis=1, keepdims=True)) * SHARPNESS)
                odds /= odds.sum(axis=1, keepdims=True)
                for i in np.flatnonzero(known):
                    k = int(cosine[i].argmax())
                    best[lo + i], score[lo + i] = labels[k], round(float(odds[i, k]), 6)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(best, pa.string()), pa.array(score), *b.columns[2:]], names=["id", "lang_pred", "score", *b.schema.names[2:]]
            )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    kinds = dict(slim.dtypes)
    extra = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return arrow_map(slim, run, f"id {kinds['id']}, lang_pred string, score double{extra}").withColumnRenamed("id", id_col)
