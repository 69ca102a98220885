"""``tokens`` of :mod:`.text` for many texts at once, over their bytes: counts and the places of asked words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are looked at together; texts are not split.
BLOCK_BYTES = 1 << 22
_WORD, _JOINT, _HAN = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]], _KINDS[[*b"-'"]] = _WORD, _JOINT


def _codes(data: np.ndarray, bounds: np.ndarray, words: pa.Array) -> np.ndarray:
    """Places in ``words`` of the strings between the bounds; -1 where there is none."""
    pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
    return pc.fill_null(pc.index_in(pieces, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _block(data: np.ndarray, at: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    first = np.zeros(n + 1, bool)  # where a text begins
    first[at] = True
    kind = _KINDS[data]
    joint = np.flatnonzero(kind == _JOINT)
    kind[joint] = 0
    joint = joint[(joint > 0) & (joint < n - 1)]
    kind[joint[(kind[joint - 1] == _WORD) & (kind[joint + 1] == _WORD) & ~first[joint] & ~first[joint + 1]]] = _WORD
    han = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))  # U+4E00 to U+9FFF have three bytes
    han = han[han < n - 2]
    a, b, c = data[han], data[han + 1], data[han + 2]
    han = han[((a > 0xE4) | (b >= 0xB8)) & (b >> 6 == 2) & (c >> 6 == 2) & ~first[han + 1] & ~first[han + 2]]
    kind[(han[:, None] + np.arange(3)).ravel()] = _HAN
    edge = first[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge)
    token = kind[starts] > 0
    code, place = np.where(token, _codes(data, np.r_[starts, n], words), -1), starts
    pair = han[:-1][(np.diff(han) == 3) & ~first[han[1:]]]
    if len(pair):
        both = data[pair[:, None] + np.arange(6)].ravel()
        code, place = np.r_[code, _codes(both, np.arange(len(pair) + 1) * 6, words)], np.r_[place, pair]
    code, place = code[code >= 0], place[code >= 0]
    # A run of n characters has n tokens: itself and n - 1 pairs.
    dl = np.diff(np.searchsorted(starts[kind[starts] == _WORD], at)) + np.diff(np.searchsorted(han, at))
    return dl, np.searchsorted(at, place, "right") - 1, code


def word_codes(low: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens of each text; row and code of each token that is one of ``words``.

    ``low``: lower-cased texts, none null. ``words`` are tokens; a code is a place in it.
    """
    wide = pa.types.is_large_string(low.type)
    at = np.frombuffer(low.buffers()[1], np.int64 if wide else np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64) if len(low) else np.zeros(1, np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8) if at[-1] > at[0] else np.zeros(0, np.uint8)
    words = words.cast(pa.string())
    found, lo = [(np.zeros(0, np.int64),) * 3], 0
    while lo < len(low):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_BYTES, "right")) - 1)
        if at[hi] > at[lo]:
            dl, row, code = _block(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], words)
        else:
            dl, row, code = np.zeros(hi - lo, np.int64), *found[0][1:]
        found.append((dl, row + lo, code))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found))
