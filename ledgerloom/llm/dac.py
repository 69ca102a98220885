"""Token ids in directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level 0 holds one chunk of every id; a bitmap says
which ids go on, and level 1 holds the next chunk of just those, and so on. A rank directory (ones
before every 512 bits) finds an id's place in the next level, so any token is read without decoding
a block.

Token files are Parquet rows of one coded block each: documents in ascending id order, at most about
``BLOCK_TOKENS`` tokens a block (a longer document is a block of its own).

Block layout, little-endian: magic ``DAC1``, u32 tokens, u32 levels; for each level u32 chunks, the
chunks, and except for the last level the bitmap (u64 words) and the directory (u32 each).

Defined results: null or empty texts have the end id only; null document ids come last; rows equal
in id follow each other in any order that their texts fix; extra columns are ignored; an empty table
gives no blocks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, arrow_map, work_dir
from .pretokens import Kept, byte_letters, classes, coarse_pieces, spaced_pieces, text_groups, unclear, word_and_marks

MAGIC = b"DAC1"
SPAN = 512
BLOCK_TOKENS = 1 << 18
#: Runs whose codes a worker keeps.
CACHE = 400_000


def dac_encode(ids: np.ndarray) -> bytes:
    """One block."""
    rest = np.asarray(ids, np.uint32)
    out = []
    levels = 0
    while True:
        levels += 1
        more = rest > 255
        out += [np.uint32(len(rest)).tobytes(), (rest & 255).astype(np.uint8).tobytes()]
        if not more.any():
            break
        padded = np.zeros(-(-len(more) // SPAN) * SPAN, np.uint8)
        padded[: len(more)] = more
        ones = padded.reshape(-1, SPAN).sum(axis=1, dtype=np.int64)
        out += [np.packbits(padded, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
        rest = rest[more] >> 8
    return b"".join([MAGIC, np.array([len(np.asarray(ids)), levels], "<u4").tobytes(), *out])


class DacBlock:
    """Reads a block: all of it, or any single token."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 block")
        self.size, levels = (int(x) for x in np.frombuffer(data, "<u4", 2, 4))
        at = 12
        self.chunks, self.bits, self.ranks = [], [], []
        for level in range(levels):
            n = int(np.frombuffer(data, "<u4", 1, at)[0])
            self.chunks.append(np.frombuffer(data, np.uint8, n, at + 4))
            at += 4 + n
            if level + 1 < levels:
                spans = -(-n // SPAN)
                self.bits.append(np.frombuffer(data, "<u8", spans * SPAN // 64, at))
                at += spans * SPAN // 8
                self.ranks.append(np.frombuffer(data, "<u4", spans, at))
                at += 4 * spans

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, k: int) -> int:
        """Token ``k``, by one rank a level."""
        if not 0 <= k < self.size:
            raise IndexError(k)
        value, at = 0, k
        for level, chunks in enumerate(self.chunks):
            value |= int(chunks[at]) << 8 * level
            if level == len(self.bits) or not int(self.bits[level][at >> 6]) >> (at & 63) & 1:
                break
            first = at // SPAN * (SPAN // 64)
            words = self.bits[level][first : (at >> 6) + 1].copy()
            words[-1] &= np.uint64((1 << (at & 63)) - 1)
            at = int(self.ranks[level][at // SPAN]) + int(np.bitwise_count(words).sum())
        return value

    def all(self) -> np.ndarray:
        """Every token, level by level."""
        out = np.zeros(self.size, np.uint32)
        places = np.arange(self.size)
        for level, chunks in enumerate(self.chunks):
            out[places] |= chunks.astype(np.uint32) << np.uint32(8 * level)
            if level < len(self.bits):
                places = places[np.unpackbits(self.bits[level].view(np.uint8), bitorder="little")[: len(chunks)].astype(bool)]
        return out


class UnclearBoundary(Exception):
    """The space before a run may be inside a piece."""


class ByteBpe:
    """A byte-level vocabulary of the tokenizers library; the encodings of runs between spaces are kept.

    A space is where a piece begins unless white space stands on both sides of it, so a text is coded
    run by run; new runs are cut into pieces, and the library's model codes each.
    """

    def __init__(self, path: str, sets: tuple[str, str, str]):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        self.pieces, self.coarse, self.unclear = spaced_pieces(sets), coarse_pieces(sets), unclear(sets)
        # Bytes of one id; ids are little-endian.
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.runs = Kept(self.run, CACHE)  # codes of a run and the space before it
        self.parts = Kept(self.piece, CACHE // 4)

    def packed(self, ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def piece(self, piece: str) -> bytes:
        """The ids of one piece."""
        return self.packed([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])

    def run(self, run: str) -> bytes:
        """The ids of a run and the space before it."""
        word = word_and_marks(run)
        if word is None:
            if self.unclear.match(run):
                raise UnclearBoundary
            return self.stretch(" " + run)
        return self.piece(" " + word) if len(word) == len(run) else self.runs[word] + self.parts[run[len(word) :]]

    def special_in(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def stretch(self, text: str) -> bytes:
        """The ids of a text that begins and ends at piece boundaries."""
        if self.special_in(text):
            return self.packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.parts.__getitem__, self.pieces.findall(text)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the library gives them."""
        out = []
        for text in texts:
            head, *tail = text.split(" ")
            try:
                out.append(self.stretch(head) + b"".join(map(self.runs.__getitem__, tail)))
            except UnclearBoundary:
                out.append(self.stretch(text) if self.special_in(text) else b"".join(map(self.stretch, self.coarse.findall(text))))
        return out


@lru_cache(maxsize=2)
def byte_bpe(path: str, sets: tuple[str, str, str]) -> ByteBpe:
    return ByteBpe(path, sets)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0
) -> None:
    """Write the token files of ``docs`` to ``path``, in ascending order of the id.

    Texts are encoded where they are read; only ids are shuffled. Files are split by id and a hash of
    the text, so rows of one id need not share a task; their bounds come from a shuffle of just those.
    """
    spark = docs.sparkSession
    vocab, sets = vocabulary or default_vocabulary(), classes()
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    kind = dict(slim.dtypes)["id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_last(), F.col("tie")]
    firsts = (
        slim.select("id", "tie")
        .repartitionByRange(parts, *order)
        .groupBy(F.spark_partition_id())
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("least"))
        .collect()  # one row for each part
    )
    bounds = sorted((r["least"]["none"], () if r["least"]["none"] else (r["least"]["id"],), r["least"]["tie"]) for r in firsts)[1:]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocab, sets)
        end = bpe.packed([end_id])
        for b in batches:
            for lo, texts in text_groups(b, 1, CHUNK_BYTES):
                ids, ties = b.column(0).slice(lo, len(texts)), b.column(2).slice(lo, len(texts))
                coded = pa.array([c + end for c in bpe.encode_all(texts)], pa.binary())
                keys = ((i is None, () if i is None else (i,), t) for i, t in zip(ids.to_pylist(), ties.to_pylist()))
                part = pa.array([bisect_right(bounds, k) for k in keys], pa.int32())
                yield pa.RecordBatch.from_arrays([part, ids, ties, coded], names=["part", "id", "tie", "coded"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = f"<u{byte_bpe(vocab, sets).width}"
        width = np.dtype(kind).itemsize
        before = size = 0
        held: list[pa.RecordBatch] = []  # ids and codes of the documents of one block

        def block() -> pa.RecordBatch:
            nonlocal before, size
            names, coded = pa.concat_arrays([h.column(1) for h in held]), [c.as_py() for h in held for c in h.column(2)]
            row = [
                held[0].column(0).slice(0, 1), pa.array([before], pa.int64()), pa.array([size], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                pa.array([[len(c) // width for c in coded]], pa.list_(pa.int64())),
                pa.array([dac_encode(np.frombuffer(b"".join(coded), kind))], pa.binary()),
            ]
            before += size
            size = 0
            held.clear()
            return pa.RecordBatch.from_arrays(row, names=["part", "before", "tokens", "ids", "sizes", "block"])

        for b in batches:
            lo = 0
            for k, n in enumerate(pc.binary_length(b.column(2)).to_pylist()):
                if size and size + n // width > BLOCK_TOKENS:
                    if k > lo:
                        held.append(b.slice(lo, k - lo))
                    lo = k
                    yield block()
                size += n // width
            held.append(b.slice(lo))
        if size:
            yield block()

    encoded = arrow_map(slim, encode, f"part int, id {kind}, tie long, coded binary")
    sorted_ids = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions(*order).select("part", "id", "coded")
    # Stored as they are, so that a block's levels and directories are at their place in the file.
    arrow_map(sorted_ids, blocks, f"part int, before long, tokens long, ids array<{kind}>, sizes array<long>, block binary").write.option(
        "compression", "uncompressed"
    ).parquet(path)


def _open(spark: SparkSession, path: str, id_kind: str) -> DataFrame:
    """The blocks of token files, with ``first``, the tokens before each in all files."""
    blocks = spark.read.schema(f"part int, before long, tokens long, ids array<{id_kind}>, sizes array<long>, block binary").parquet(path)
    totals = sorted(blocks.groupBy("part").agg(F.sum("tokens").alias("n")).collect(), key=lambda r: r["part"])
    offsets, so_far = [], 0  # one row for each part
    for r in totals:
        offsets.append((r["part"], so_far))
        so_far += r["n"]
    at = spark.createDataFrame(offsets, "part int, offset long")
    return blocks.join(F.broadcast(at), "part").withColumn("first", F.col("before") + F.col("offset"))


def read_tokens(spark: SparkSession, path: str, id_kind: str = "bigint", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each document of the token files: id, start, n_tokens, ids_crc32 (and the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                data = DacBlock(row.column(3)[0].as_py()).all().astype("<u4", copy=False).tobytes()
                sizes = row.column(2).flatten().to_numpy()
                ends = np.cumsum(sizes)
                begins = ends - sizes
                parts = [data[4 * s : 4 * e] for s, e in zip(begins.tolist(), ends.tolist())]
                cols = [row.column(1).flatten(), pa.array(begins + row.column(0)[0].as_py()), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(p, "<u4").tolist() for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = f"id {id_kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return arrow_map(_open(spark, path, id_kind).select("first", "ids", "sizes", "block"), run, schema).withColumnRenamed("id", id_col)


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, position_col: str = "position", id_kind: str = "bigint") -> DataFrame:
    """position, token for each different position (tokens before it in all files) that the files hold.

    Blocks are found by their counts alone, joined by ranges of positions; of a found block each token
    is read by its directory, without decoding the block.
    """
    blocks = _open(spark, path, id_kind)

    def slot(c: Column) -> Column:
        return F.floor(c / BLOCK_TOKENS)

    spans = blocks.select("part", "before", "first", "tokens").withColumn("slot", F.explode(F.sequence(slot(F.col("first")), slot(F.col("first") + F.col("tokens") - 1))))
    wanted = positions.select(F.col(position_col).cast("long").alias("position")).distinct().withColumn("slot", slot(F.col("position")))
    placed = wanted.join(spans, "slot").filter((F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("tokens")))
    # No more positions than the block has tokens.
    per_block = placed.groupBy("part", "before", "first").agg(F.collect_list(F.col("position") - F.col("first")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, at, data in zip(*(c.to_pylist() for c in b.columns)):
                block = DacBlock(data)
                yield pa.RecordBatch.from_arrays([pa.array([first + k for k in at], pa.int64()), pa.array([block[k] for k in at], pa.int64())], names=["position", "token"])

    found = per_block.join(blocks.select("part", "before", "block"), ["part", "before"]).select("first", "at", "block")
    return arrow_map(found, run, "position long, token long")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write token files to the shared work folder and describe what is read back from them."""
    import uuid

    spark = docs.sparkSession
    path = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, id_col, text_col, **options)
    return read_tokens(spark, path, dict(docs.dtypes)[id_col], id_col)
