"""BPE encoding by forced-boundary splitting, and decoding.

Two neighbouring bytes that stand side by side inside no vocabulary token can never be merged, so a
cut between them is certain. Every word is cut at such places; the fragments are encoded
independently and concatenated, which gives exactly what encoding the word as a whole gives.

The vocabulary is read from a tokenizer file named by a parameter; nothing is learned here.

Defined results: a null text is an empty one (no tokens, decoded text empty); strings of special
tokens inside a text become those tokens, as the library has it; repeated rows and extra columns
have no effect; an empty table gives an empty table; texts are processed whole, whatever their size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, arrow_map
from .pretokens import Kept, bare_pieces, byte_letters, classes, runs, text_groups, word_and_marks

#: Runs, words and fragments whose ids a worker keeps, and the bytes beyond which a fragment is not kept.
CACHE = 300_000
KEPT_RUN = 64
#: Fragments of more symbols are merged by a heap.
LONG = 64
BITS = 20
MASK = (1 << BITS) - 1
NEVER = 1 << 62


class WordBpe:
    """A lower-casing BPE vocabulary with an end-of-word mark, encoded fragment by fragment."""

    def __init__(self, path: str, sets: tuple[str, str, str]):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.pairs: dict[int, int] = {}  # of two neighbouring ids, the rank of their merge and its id
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.pairs[self.vocab[left] << BITS | self.vocab[right]] = rank << BITS | self.vocab[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.written = {i: str(i) for i in self.names}
        letters = byte_letters()
        self.inner, self.final = [self.vocab[c] for c in letters], [self.vocab[c + self.suffix] for c in letters]
        place = {c: b for b, c in enumerate(letters)}
        joined = np.zeros((256, 256), bool)
        for token in self.vocab:
            body = [place[c] for c in token.removesuffix(self.suffix)] if token != self.suffix else []
            joined[body[:-1], body[1:]] = True
        #: For each byte, the bytes that follow it inside some token.
        self.follows = [frozenset(np.flatnonzero(row).tolist()) for row in joined]
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.pieces, self.between = bare_pieces(sets), runs(sets)
        self.runs = Kept(self.run, CACHE)  # ids of a run between white space
        self.words = Kept(self.word, CACHE)
        self.fragments: dict[tuple[bytes, bool], list[int]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges, the lowest rank and then the leftmost pair first."""
        if len(ids) > LONG:
            return self._merge_long(ids)
        pairs = self.pairs
        order = [pairs.get(a << BITS | b, NEVER) for a, b in zip(ids, ids[1:])]
        while order:
            best = min(order)
            if best == NEVER:
                break
            k = order.index(best)
            ids[k : k + 2] = [best & MASK]
            del order[k]
            if k:
                order[k - 1] = pairs.get(ids[k - 1] << BITS | ids[k], NEVER)
            if k < len(order):
                order[k] = pairs.get(ids[k] << BITS | ids[k + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked symbols, in n log n steps; an entry whose pair has changed is passed over."""
        pairs, n = self.pairs, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        place = n.bit_length()
        here = (1 << place) - 1
        heap = [pairs[pair] << place | k for k, (a, b) in enumerate(zip(ids, ids[1:])) if (pair := a << BITS | b) in pairs]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            k = entry & here
            j = after[k]
            if j < 0 or ids[k] < 0 or pairs.get(ids[k] << BITS | ids[j]) != entry >> place:
                continue
            ids[k] = entry >> place & MASK
            ids[j] = -1
            nxt = after[k] = after[j]
            if nxt >= 0:
                before[nxt] = k
                if (found := pairs.get(ids[k] << BITS | ids[nxt])) is not None:
                    heappush(heap, found << place | k)
            prev = before[k]
            if prev >= 0 and (found := pairs.get(ids[prev] << BITS | ids[k])) is not None:
                heappush(heap, found << place | prev)
        return [i for i in ids if i >= 0]

    def fragment(self, body: bytes, last: bool) -> list[int]:
        known = self.fragments.get((body, last))
        if known is None:
            ids = [self.inner[b] for b in body]
            if last:
                ids[-1] = self.final[body[-1]]
            known = self.merge(ids)
            if len(self.fragments) < CACHE and len(body) <= KEPT_RUN:
                self.fragments[body, last] = known
        return known

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments of a word between its certain cuts."""
        follows, out, at = self.follows, [], 0
        for k in range(1, len(word)):
            if word[k] not in follows[word[k - 1]]:
                out.append(word[at:k])
                at = k
        return [*out, word[at:]]

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one word in lower case, fragment by fragment."""
        *parts, last = self.cuts(word.encode())
        return (*chain.from_iterable(self.fragment(p, False) for p in parts), *self.fragment(last, True))

    def run(self, run: str) -> tuple[int, ...]:
        """The ids of a run without white space."""
        if run in self.special:
            return (self.special[run],)
        word = word_and_marks(run)
        if word is None or not word.lower().isalpha():  # a dotted capital I becomes a letter and a mark
            return tuple(chain.from_iterable(map(self.words.__getitem__, self.pieces.findall(self.normalizer.normalize_str(run)))))
        return self.words[word.lower()] + self.words[run[len(word) :]] if len(word) < len(run) else self.words[word.lower()]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. Runs met before are looked up."""
        out = []
        for text in texts:
            if self.split_special and "<" in text:
                row = [r for p in self.split_special.split(text) for r in ([p] if p in self.special else self.between.findall(p))]
            else:
                row = self.between.findall(text)
            out.append(list(chain.from_iterable(map(self.runs.__getitem__, row))))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """What the library decodes to: this vocabulary has no decoder, so tokens joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def word_bpe(path: str, sets: tuple[str, str, str]) -> WordBpe:
    return WordBpe(path, sets)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False
) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every text; ``with_ids`` adds ids and decoded text."""
    path, sets = vocabulary or default_vocabulary(), classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path, sets)
        for b in batches:
            for lo, texts in text_groups(b, 1, CHUNK_BYTES):
                rows = []
                for ids in bpe.encode_all(texts):
                    decoded = bpe.decode(ids)
                    written = " ".join(map(bpe.written.__getitem__, ids))
                    digests = (len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*digests, ids, decoded) if with_ids else digests)
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32()), pa.string()] * with_ids]
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(slim.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return arrow_map(slim, run, schema).withColumnRenamed("id", id_col)
