"""Chunkers: fixed windows in closed form, sequential ones as Arrow maps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship_package

CHUNK_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 800, 100, 4
SEGMENT_CHARS, SEGMENT_OVERLAP, LEAST_SEGMENT = 2400, 180, 256


def hard_split(text: Column, size: int, overlap: int) -> Column:
    """Array of fixed windows; the last one ends with the text."""
    step = size - overlap
    n = F.length(text)
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(float(step)))).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * step + 1, F.lit(size))))


def sliding_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(from, to) of overlapping windows that end at a paragraph, else a sentence, if one ends in the
    second half. The walk goes on by full windows, so a long last window is followed by its own tail."""
    n = len(text)
    if n // CHARS_PER_TOKEN <= size // CHARS_PER_TOKEN:
        return [(0, n)]
    spans, at = [], 0
    while at < n:
        end = at + size
        if end < n:
            ends = [(text.rfind("\n\n", at, end), 0), (text.rfind(". ", at, end), 1)]
            end = next((cut + kept for cut, kept in ends if cut > at + size // 2), end)
        spans.append((at, min(end, n)))
        at = end - overlap if end - overlap > at else end
    return spans


def windows(text: str, size: int) -> list[str]:
    """Hard cuts, trimmed, empty ones left out."""
    return [w for k in range(0, len(text), size) if (w := text[k : k + size].strip())]


def _with_tails(parts: list[str], size: int, overlap: int) -> list[str]:
    """Each part after the first begins with the end of the one before it, if both fit."""
    out: list[str] = []
    for part in parts:
        tail = out[-1][-overlap:].strip() if out and overlap > 0 else ""
        joined = f"{tail}\n{part}" if tail else part
        out.append(joined if len(joined) <= size else part)
    return out


def pack_segments(text: str, size: int = SEGMENT_CHARS, overlap: int = SEGMENT_OVERLAP) -> list[str]:
    """Paragraphs, else sentences, else hard cuts, packed greedily."""
    size, text = max(LEAST_SEGMENT, size), text.strip()
    if len(text) <= size:
        return [text]
    packed: list[str] = []
    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        sentences = [paragraph] if len(paragraph) <= size else re.split(r"(?<=[.!?])\s+", paragraph)
        for unit in (u for sentence in sentences for u in windows(sentence, size)):
            if packed and len(packed[-1]) + len(unit) + 2 <= size:
                packed[-1] += "\n\n" + unit
            else:
                packed.append(unit)
    return _with_tails([p.strip() for p in packed], size, overlap)


def pack_table(text: str, size: int = SEGMENT_CHARS, header_lines: int = 2) -> list[str]:
    """Lines packed greedily, each segment under the repeated header lines (if those take a third at most)."""
    size, text = max(LEAST_SEGMENT, size), text.strip()
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    if len(text) <= size:
        return [text]
    if len(lines) < 2:
        return windows(text, size)
    header = "\n".join(lines[:header_lines])
    repeated = len(header) <= size // 3
    room = max(64, size - len(header) - 1) if repeated else size
    body = (lines[header_lines:] or lines[1:]) if repeated else lines
    packed: list[str] = []
    for piece in (w for line in body for w in windows(line, room)):
        if packed and len(packed[-1]) + 1 + len(piece) <= room:
            packed[-1] += "\n" + piece
        else:
            packed.append(piece)
    return [f"{header}\n{p}" if repeated else p for p in packed]


def _explode_text(rows: DataFrame, id_col: str, text_col: str, split) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ordinals, texts, counts = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = split(t or "")
                ids += [i] * len(parts)
                ordinals += range(len(parts))
                counts += [len(parts)] * len(parts)
                texts += parts
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), pa.array(ordinals, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], names=["id", "segment_index", "segment_count", "text"]
            )

    ship_package(rows.sparkSession)
    slim = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, segment_index long, segment_count long, text string").withColumnRenamed("id", id_col)


def sliding_chunks(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    size, overlap = CHUNK_TOKENS * CHARS_PER_TOKEN, OVERLAP_TOKENS * CHARS_PER_TOKEN
    return _explode_text(rows, id_col, text_col, lambda t: [x for a, b in sliding_spans(t, size, overlap) if (x := t[a:b].strip())])


def index_segments(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _explode_text(rows, id_col, text_col, pack_segments)
