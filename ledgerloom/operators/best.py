"""Top lists inside a task, so that no score of a pair that cannot win leaves it."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of one dense block of scores (8 bytes each).
CELLS = 4_000_000
#: Rounding to six decimals moves a score by half of this at most; twice that is left for sums in another order.
MARGIN = 2e-6
_UNIT, _WIDE = Decimal("1e-6"), Context(prec=400)


def half_up(x: np.ndarray) -> np.ndarray:
    """``F.round(x, 6)``: half up on the decimal form of each double."""
    with np.errstate(invalid="ignore", over="ignore"):
        t = np.abs(x) * 1e6
        r = np.copysign(np.floor(t + 0.5) / 1e6, x) + 0.0
        close = np.flatnonzero(np.isfinite(x) & ((np.abs(t - np.floor(t) - 0.5) < 1e-4) | (t > 1e11)))
    if len(close):
        values, at = np.unique(x[close], return_inverse=True)
        r[close] = np.array([float(Decimal(repr(float(v))).quantize(_UNIT, ROUND_HALF_UP, _WIDE)) for v in values])[at] + 0.0
    return r


def order_of(ids: pa.Array) -> np.ndarray:
    """A number for each id, ascending as Spark sorts them (nulls first)."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def contenders(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the cells (key, item) that may be among the k best of their key once rounded; -inf never is."""
    n = scores.shape[1]
    if n <= k:
        return scores > -np.inf
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    return (scores >= (least - MARGIN)[:, None]) & (scores > -np.inf)


def cut(keys: list[np.ndarray], score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each key, in order: by score descending (NaN first), then tie."""
    n = len(score)
    order = np.lexsort((tie, -np.where(np.isnan(score), np.inf, score), *reversed(keys)))
    first = np.zeros(n, bool)
    first[:1] = True
    for key in keys:
        first[1:] |= key[order][1:] != key[order][:-1]
    rank = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return order[rank < k]
