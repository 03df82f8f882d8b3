"""Words, lines and 64-bit hashes of whole texts, computed over the bytes of an Arrow column.

A batch's texts lie one after another in one UTF-8 buffer. All functions work on that buffer
with numpy, so a text is never turned into Python strings word by word. Memory is bounded by
the piece size the caller asks :func:`pieces` for (one text longer than that is its own piece).
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: log2 of the positions whose powers are kept; powers of further ones are a product of two.
_BITS = 16
_BLOCK = 1 << _BITS


class Words(NamedTuple):
    """Byte spans of words, and for each text the index of its first word (one entry more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one uint8 array and its offsets from 0; a null text is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(batches, text: str, max_bytes: int = 4 << 20):
    """Record batches cut so that each holds at most ``max_bytes`` of text, or a single row."""
    for batch in batches:
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        start, n = 0, batch.num_rows
        while start < n:
            stop = max(start + 1, int(np.searchsorted(off, off[start] + max_bytes, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Give memory that Arrow keeps for later back to the system: for the end of a partition, as workers are used again."""
    pa.default_memory_pool().release_unused()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def find_words(data: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes other than those that ``apart`` marks; a word never crosses a text's end."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(off), np.int64))
    inside = ~apart[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    at = off[:-1][off[:-1] < len(data)]
    begin[at] = inside[at]
    at = off[1:][off[1:] > 0] - 1
    stop[at] = inside[at]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, off))


def find_lines(data: np.ndarray, off: np.ndarray) -> Words:
    r"""Spans of the ``\n``-separated lines (without the ``\n``); an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, off[:-1])  # line breaks before each text
    after = np.searchsorted(breaks, off[1:])
    first = np.concatenate([[0], np.cumsum(after - before + 1)])
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    opens = np.ones(first[-1], bool)
    opens[first[:-1]] = False
    starts[first[:-1]] = off[:-1]
    starts[opens] = breaks + 1
    closes = np.ones(first[-1], bool)
    closes[first[1:] - 1] = False
    ends[first[1:] - 1] = off[1:]
    ends[closes] = breaks
    return Words(starts, ends, first)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=2)
def _low_powers(base: int) -> np.ndarray:
    """``base ** i`` for the positions of a block."""
    values = np.full(_BLOCK, base, np.uint64)
    values[0] = 1
    return np.multiply.accumulate(values)


def _high_powers(base: int, n: int) -> np.ndarray:
    """``base ** (i * block)`` for the blocks of ``n`` positions."""
    values = np.full((n >> _BITS) + 1, pow(base, _BLOCK, 1 << 64), np.uint64)
    values[0] = 1
    return np.multiply.accumulate(values)


def rolling_sums(values: np.ndarray) -> np.ndarray:
    """Sums of ``values[i] * base ** i`` up to each position, one entry more than ``values``."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    low, high = _low_powers(_BASE), _high_powers(_BASE, n)
    for k, start in enumerate(range(0, n, _BLOCK)):
        part = values[start:start + _BLOCK]
        np.multiply(part, low[:len(part)], out=sums[start + 1:start + 1 + len(part)])
        sums[start + 1:start + 1 + len(part)] *= high[k]
    return np.cumsum(sums, out=sums)


def rolling_spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of the values behind ``sums``, equal for equal values wherever they stand."""
    down = _low_powers(_INVERSE)[starts & (_BLOCK - 1)] * _high_powers(_INVERSE, len(sums))[starts >> _BITS]
    return mix((sums[ends] - sums[starts]) * down + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """A uint64 hash of each byte span, equal for equal bytes wherever they stand."""
    return rolling_spans(rolling_sums(table[data]), starts, ends)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text and the index of each text's first shingle.

    A text of 1 to ``size - 1`` words has one shingle, its whole word sequence; one without words, none.
    """
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    pos = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    last = np.repeat(first[1:], n)
    h = np.full(at[-1], size, np.uint64)
    for k in range(size):
        there = pos + k < last
        w = words[np.where(there, pos + k, 0)] if len(words) else np.zeros(0, np.uint64)
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + np.where(there, w, np.uint64(k + 1)))
    return h, at


def span_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans, which are whole UTF-8 characters, as strings."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(
        np.ascontiguousarray(data[expand(starts, size)]))).cast(pa.string())


def bit_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The place of each hash in a bitmap of ``2 ** bits`` bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(places, bits: int) -> np.ndarray:
    """``2 ** bits`` bits as bytes, those of the column ``place`` set. Spark builds it in blocks of 4 KB; the driver gets
    those that aren't empty: at most ``2 ** bits / 8`` bytes, whatever the table's size."""
    rows = places.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("set")).collect()
    out = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for r in rows:  # Spark counts from 1: blocks, and places in them
        out[(r["block"] - 1) * 4096:r["block"] * 4096] = np.frombuffer(bytes(r["set"]), np.uint8)
    return out


def in_bitmap(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + counts[i] - 1`` for all i, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    small = np.int32 if total < 1 << 31 and (not len(starts) or starts.max() < 1 << 30) else np.int64
    out = np.repeat((starts - (ends - counts)).astype(small), counts)
    out += np.arange(total, dtype=small)
    return out
