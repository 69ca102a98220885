"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Cyclic boosting visits the features in turn and adds a
shallow tree over one feature's bins each time, then does the same for the most telling pairs of
features; the trees of one feature add up to a lookup table. A score is the sum of table entries,
looked up for a whole batch at once.

Training uses at most ``MAX_ROWS`` labelled rows, those of the smallest hash of the id; scoring
covers every row. Labels, language, source and id are never features.

Defined results: a null text is an empty one and is scored like any other; ids labelled more than
once are learned by their mean label if it is decided (ties and null labels are left out); without
two classes to learn from, every score is the share of label 1 (0.5 without labels); repeated rows
and extra columns have no effect (of different texts of one id one is learned, by a hash); an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

MAX_ROWS = 20_000
BINS = 24
PAIR_BINS = 6
ROUNDS = 60
PAIRS = 6
RATE = 0.15
FEATURES = (
    "log_words",
    "symbol_share",
    "upper_share",
    "digit_share",
    "punct_share",
    "letter_share",
    "mean_word",
    "distinct_words",
    "distinct_triples",
    "same_neighbours",
    "repeated_lines",
    "top_word_share",
)
_LOWER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _PUNCT, _REST = range(7)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    out = np.full(0x110000, _REST, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isupper():
            out[c] = _UPPER
        elif ch.isalpha():
            out[c] = _LOWER
        elif ch.isdigit():
            out[c] = _DIGIT
        elif ch.isspace():
            out[c] = _SPACE
    for ch in "#*$%&|<>@^~=+_\\{}[]/":
        out[ord(ch)] = _SYMBOL
    for ch in ".,;:!?'\"()-":
        out[ord(ch)] = _PUNCT
    return out


def text_features(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for one whole text."""
    text = text or ""
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=7)
    words = text.encode("utf-8", "replace").split()
    n, chars = len(words), max(1, int(kinds.sum() - kinds[_SPACE]))
    letters = int(kinds[_UPPER] + kinds[_LOWER])
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)),
        kinds[_SYMBOL] / chars,
        kinds[_UPPER] / max(1, letters),
        kinds[_DIGIT] / chars,
        kinds[_PUNCT] / chars,
        letters / chars,
        chars / max(1, n),
        len(set(words)) / max(1, n),
        len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2) if n > 2 else 1.0,
        sum(map(eq, words, words[1:])) / max(1, n - 1),
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        Counter(words).most_common(1)[0][1] / n if n else 0.0,
    ]


@dataclass
class Gam:
    """Lookup tables: one for each feature, one for each chosen pair."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts halfway between neighbouring values, near the quantiles."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return np.zeros(0)
    at = np.clip(np.searchsorted(distinct, np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])), 1, len(distinct) - 1)
    # Rare values at the ends of a lumped feature get cuts of their own.
    spread = np.clip(np.linspace(0, len(distinct), bins // 2 + 1)[1:-1].astype(int), 1, len(distinct) - 1)
    at = np.unique(np.concatenate([at, spread, [1]]))
    return (distinct[at - 1] + distinct[at]) / 2


def _steps(grad: np.ndarray, hess: np.ndarray, leaves: int = 4, least: float = 2.0) -> np.ndarray:
    """A shallow tree over ordered bins: greedy splits by gain, then a Newton step in each leaf."""
    parts = [(0, len(grad))]
    g, h = np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], hess.cumsum()])

    def gain(a: int, b: int) -> float:
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    while len(parts) < leaves:
        best = (1e-6, None, None)
        for p, (a, b) in enumerate(parts):
            for cut in range(a + 1, b):
                if min(h[cut] - h[a], h[b] - h[cut]) >= least:
                    won = gain(a, cut) + gain(cut, b) - gain(a, b)
                    if won > best[0]:
                        best = (won, p, cut)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid of bins into four, with its gain and Newton steps."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(grad)
    for i in range(grad.shape[0] - 1):
        for j in range(grad.shape[1] - 1):
            gs = [g[i, j], g[i, -1] - g[i, j], g[-1, j] - g[i, j], g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j]]
            hs = [h[i, j], h[i, -1] - h[i, j], h[-1, j] - h[i, j], h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j]]
            won = sum(a * a / (b + 1.0) for a, b in zip(gs, hs)) - g[-1, -1] ** 2 / (h[-1, -1] + 1.0)
            if won > best:
                v = [a / (b + 1.0) for a, b in zip(gs, hs)]
                best = won
                out = np.empty_like(grad)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return best, out


def train_gam(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Gam:
    """Cyclic boosting of shallow trees under logistic loss."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Gam(base=float(np.log(share / (1 - share))))
    share = y.mean()
    model = Gam(base=float(np.log(share / (1 - share))))
    total = np.full(len(y), model.base)
    count = x.shape[1]
    model.edges = [_edges(x[:, k], BINS) for k in range(count)]
    model.pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(count)]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(count):
            g, h = slopes()
            size = len(model.tables[k])
            step = rate * _steps(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size))
            model.tables[k] += step
            total += step[bins[k]]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(count), 2), key=lambda p: (-_quadrants(grid(*p, g), grid(*p, h))[0], p))
    tables = {p: np.zeros_like(grid(*p, g)) for p in ranked[:pairs]}
    for _ in range(rounds // 3):
        for (i, j), table in tables.items():
            g, h = slopes()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[coarse[i], coarse[j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        yield b, np.array([text_features(t) for t in b.column(1).to_pylist()], np.float64).reshape(-1, len(FEATURES))


def label_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """id, label: at most ``max_rows`` decided labels, of the smallest hash of the id."""
    mean = labels.groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("mean")).filter("id IS NOT NULL AND mean IS NOT NULL AND mean <> 0.5")
    return mean.select("id", (F.col("mean") > 0.5).cast("int").alias("label")).orderBy(F.xxhash64(F.lit("labels"), "id"), "id").limit(max_rows)


def fit_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """Learn from ``labels`` (id, label) of ``docs``; the rows that reach the driver are bounded by ``max_rows``."""
    sample = label_sample(labels, id_col, label_col, max_rows)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = slim.join(F.broadcast(sample), "id").select("label", "text", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _with_features(batches):
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), *[pa.array(c) for c in x.T]], names=["id", "label", *FEATURES])

    found = arrow_map(joined, run, f"id {dict(joined.dtypes)['id']}, label int, " + ", ".join(f"{f} double" for f in FEATURES))
    # One row an id, so that repeated documents neither weigh more nor lift the bound; of different texts that of the smallest hash.
    rows = found.groupBy("id").agg(F.min(F.struct(F.xxhash64(*FEATURES).alias("hash"), "label", *FEATURES)).alias("row")).select("row.label", *[f"row.{f}" for f in FEATURES])
    data = np.array([list(r) for r in rows.orderBy(*rows.columns).collect()], np.float64).reshape(-1, len(FEATURES) + 1)
    return train_gam(data[:, 1:], data[:, 0])


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score (and the columns ``keep``) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _with_features(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(model.score(x), 9)), *b.columns[2:]], names=["id", "score", *b.schema.names[2:]])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    kinds = dict(slim.dtypes)
    extra = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return arrow_map(slim, run, f"id {kinds['id']}, score double{extra}").withColumnRenamed("id", id_col)
