"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized, written as NPY tiles.

``encode_media`` turns arrays into PGM, PPM or BMP bytes and ``decode_media`` reads them back;
``area_resize`` averages exact pixel areas by an integral image, ``difference_hash`` compares
neighbours of a 9 x 8 reduction, and ``npy_tile`` writes the resized array in NPY format.

``decode_media`` reads P1 to P6 of any depth and BMP of 1, 4, 8, 16, 24 and 32 bits a pixel, with
bit fields; run-length coded BMP is not decoded. Samples are scaled to the whole range of uint8, or
of uint16 where the file has more than 8 bits a sample.

Defined results: a null or empty text is a payload of 64 zero bytes; null media gives nulls but for
its id and n_bytes, undecodable media has its media_bytes and media_sha256 besides; rows are independent, so
repeated rows, ties and extra columns have no effect; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

WIDTH = 64


def encode_media(image: np.ndarray, kind: str = "pgm") -> bytes:
    """``image`` (height x width of uint8, or height x width x 3 for ppm and bmp) as file bytes."""
    h, w = image.shape[:2]
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()
    rgb = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
    if kind == "ppm":
        return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(rgb, np.uint8).tobytes()
    if kind == "bmp":
        stride = (3 * w + 3) // 4 * 4
        rows = np.zeros((h, stride), np.uint8)
        rows[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
        head = b"BM" + np.array([54 + stride * h, 0, 54, 40], "<u4").tobytes() + np.array([w, h], "<i4").tobytes()
        return head + np.array([1, 24], "<u2").tobytes() + np.array([0, stride * h, 2835, 2835, 0, 0], "<u4").tobytes() + rows.tobytes()
    raise ValueError(f"unknown media kind {kind!r}")


def _netpbm_header(data: bytes, count: int) -> tuple[list[int], int]:
    fields: list[int] = []
    at = 2
    while len(fields) < count:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    return fields, at + 1


def _scaled(x: np.ndarray, top: int) -> np.ndarray:
    """Samples of 0 to ``top`` over the whole range of uint8 or, from 256 on, uint16."""
    full, kind = (255, np.uint8) if top < 256 else (65535, np.uint16)
    if top == full:
        return x.astype(kind)
    x = np.minimum(x.astype(np.uint64), top)
    return ((x * full * 2 + top) // (2 * top)).astype(kind)


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = int(data[1:2])
    fields, at = _netpbm_header(data, 2 if kind in (1, 4) else 3)
    w, h, top = (*fields, 1)[:3]
    if not (w and h and 0 < top < 65536):
        raise ValueError("empty image or bad depth")
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    count = int(np.prod(shape))
    if kind < 4:
        plain = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
        tokens = [bytes([c]) for c in b"".join(plain.split())] if kind == 1 else plain.split()
        if len(tokens) < count:
            raise ValueError("too few samples")
        x = np.array([int(t) for t in tokens[:count]], np.int64)
    elif kind == 4:
        stride = (w + 7) // 8
        x = np.unpackbits(np.frombuffer(data, np.uint8, stride * h, at).reshape(h, stride), axis=1)[:, :w]
    else:
        x = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at)
    x = x.reshape(shape)
    return _scaled(1 - np.minimum(x, 1) if kind in (1, 4) else x, top)  # 1 is black in a bitmap


def _decode_bmp(data: bytes) -> np.ndarray:
    at, head = (int(x) for x in np.frombuffer(data, "<u4", 2, 10))
    old = head == 12
    w, h = (int(x) for x in np.frombuffer(data, "<u2" if old else "<i4", 2, 18))
    bits = int(np.frombuffer(data, "<u2", 1, 24 if old else 28)[0])
    packed = 0 if old else int(np.frombuffer(data, "<u4", 1, 30)[0])
    if bits not in (1, 4, 8, 16, 24, 32) or packed not in ((0, 3, 6) if bits in (16, 32) else (0,)) or w <= 0 or not h:
        raise ValueError("BMP of an unknown depth or packing")
    stride = (bits * w + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)
    if bits <= 8:
        used = 0 if old else int(np.frombuffer(data, "<u4", 1, 46)[0])
        size, most = (3 if old else 4), 1 << bits
        table = np.frombuffer(data, np.uint8, min(used or most, most) * size, 14 + head).reshape(-1, size)[:, 2::-1]
        index = rows if bits == 8 else np.stack([rows >> s & most - 1 for s in range(8 - bits, -1, -bits)], 2).reshape(abs(h), -1)
        out = table[index[:, :w]]
    elif bits == 24:
        out = rows[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
    else:
        pixels = np.ascontiguousarray(rows[:, : bits // 8 * w]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
        masks = [0x7C00, 0x3E0, 0x1F] if bits == 16 else [0xFF0000, 0xFF00, 0xFF]
        if packed:
            masks = [int(x) for x in np.frombuffer(data, "<u4", 3, 54)]
        if not all(masks):
            raise ValueError("empty bit field")
        low = [m & -m for m in masks]
        out = np.stack([_scaled((pixels & m) // b, m // b) for m, b in zip(masks, low)], 2)
    return out[::-1] if h > 0 else out


def decode_media(data: bytes) -> np.ndarray:
    """Netpbm (P1 to P6) or uncompressed BMP bytes as an array of uint8 (uint16 for deeper samples)."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the exact source area below each target pixel, from one integral image."""
    gray = image.mean(axis=2) if image.ndim == 3 else image
    h, w = gray.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = gray.astype(np.float64).cumsum(0).cumsum(1)

    def at(edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum(np.floor(edges).astype(np.int64), size - 1)
        return low, edges - low

    y, fy = at(np.arange(height + 1) * (h / height), h)
    x, fx = at(np.arange(width + 1) * (w / width), w)
    rows = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    grid = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    area = (h / height) * (w / width)
    return (grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]) / area


def difference_hash(image: np.ndarray) -> str:
    """64 bits, one for each pair of neighbours in a row of the 9 x 8 reduction, as 16 hex digits."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    """The image reduced to ``side`` x ``side`` uint8 samples, in NPY format."""
    out = io.BytesIO()
    small = area_resize(image, side, side) / (257 if image.dtype == np.uint16 else 1)
    np.save(out, np.clip(np.rint(small), 0, 255).astype(np.uint8))
    return out.getvalue()


def text_payload(text: bytes | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "pgm") -> DataFrame:
    """Each text as a grey image 64 samples wide: ``id_col``, n_bytes, media (file bytes)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            media = [encode_media(np.frombuffer(text_payload(t), np.uint8).reshape(-1, WIDTH), kind) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"]
            )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(slim, encode, f"id {dict(slim.dtypes)['id']}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode stored media: payload digests, difference hash and the NPY tile of each row."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    image = decode_media(m) if m is not None else None
                except (ValueError, IndexError, OverflowError):
                    image = None
                if image is None:
                    rows.append((n, None, None, None, None if m is None else len(m), None if m is None else hashlib.sha256(m).hexdigest(), None, None))
                    continue
                payload = (image if image.ndim == 2 else image[:, :, 0]).tobytes()
                rows.append(
                    (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), difference_hash(image), npy_tile(image))
                )
            cols = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_npy"]
    slim = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    schema = f"id {dict(slim.dtypes)['id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary"
    return arrow_map(slim, features, schema).withColumnRenamed("id", id_col)


def text_media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "pgm") -> DataFrame:
    """Store every text as media in the shared work folder, read it back and compute features."""
    return media_features(materialize(text_media(docs, id_col, text_col, kind), "media"), id_col)
