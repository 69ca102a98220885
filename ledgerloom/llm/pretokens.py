"""Splitting of texts into the pieces that byte-pair encoding works on.

Letters, numbers and white space are what the tokenizers library's own expressions match, asked of
it once on the driver, so no code point is of unsure class and no text is left to another path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

#: Planes 4 to 16 hold no letters, numbers or white space in any Unicode version.
PLANES = 0x40000
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


@lru_cache(maxsize=1)
def classes() -> tuple[str, str, str]:
    """Insides of the character classes letter, number and white space, as the library has them."""
    from tokenizers import Regex, pre_tokenizers

    points = [*range(0xD800), *range(0xE000, PLANES)]
    text = "".join(map(chr, points))
    out = []
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = pre_tokenizers.Split(Regex(name + "+"), "removed", invert=True).pre_tokenize_str(text)
        spans: list[tuple[int, int]] = []
        for _, (lo, hi) in runs:
            for a, b in ((lo, min(hi, 0xD800)), (max(lo, 0xD800), hi)):  # a run over the surrogates is two
                if a < b:
                    spans.append((points[a], points[b - 1]))
        out.append("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans))
    return out[0], out[1], out[2]


@lru_cache(maxsize=4)
def spaced_pieces(sets: tuple[str, str, str]) -> re.Pattern:
    """Pieces of which a word or run takes the one space before it."""
    letter, number, space = sets
    return re.compile(f"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


@lru_cache(maxsize=4)
def bare_pieces(sets: tuple[str, str, str]) -> re.Pattern:
    """Pieces without white space; every number is a piece of its own."""
    letter, number, space = sets
    return re.compile(f"{CONTRACTIONS}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


@lru_cache(maxsize=4)
def runs(sets: tuple[str, str, str]) -> re.Pattern:
    """Runs of anything but white space."""
    return re.compile(f"[^{sets[2]}]+")


@lru_cache(maxsize=4)
def coarse_pieces(sets: tuple[str, str, str]) -> re.Pattern:
    """A run with the one space before it, or white space: what no piece of ``spaced_pieces`` crosses."""
    return re.compile(f" ?[^{sets[2]}]+|[{sets[2]}]+(?![^{sets[2]}])|[{sets[2]}]+")


class Kept(dict):
    """What ``code`` gives for a text; that of short texts is kept while there are fewer than ``most``."""

    def __init__(self, code: Callable[[str], object], most: int, longest: int = 64):
        super().__init__()
        self.code, self.most, self.longest = code, most, longest

    def __missing__(self, text: str):
        found = self.code(text)
        if len(self) < self.most and len(text) <= self.longest:
            self[text] = found
        return found


def word_and_marks(run: str) -> str | None:
    """The word of a run that is one word and, at most, marks after it; None for any other run.

    Below U+0250 letters and their lower case are the same in every Unicode version, and nothing
    there is changed by composition.
    """
    word = run.rstrip(".,;:!?")
    return word if word.isalpha() and (run.isascii() or max(run) < "\u0250") else None


@lru_cache(maxsize=4)
def unclear(sets: tuple[str, str, str]) -> re.Pattern:
    """White space at either end, or nothing at all: the space before such a run may be no boundary."""
    return re.compile(f"[{sets[2]}]|\\Z")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(spare)
        spare += b not in plain
    return out


def text_groups(batch, column: int, limit: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of row groups of about ``limit`` bytes; a longer text is a group of its own."""
    import pyarrow.compute as pc

    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > limit:
            yield lo, [t or "" for t in texts.slice(lo, k - lo).to_pylist()]
            lo, held = k, 0
        held += int(size)
    if lo < len(sizes):
        yield lo, [t or "" for t in texts.slice(lo).to_pylist()]
