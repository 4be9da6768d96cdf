"""Vectorised words, lines and hashes over Arrow string columns.

A batch of texts is seen as one byte array plus document offsets, so a Spark
task spends its time in numpy and not in a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The bytes that separate words, as the contract's pattern has them.
WORD_BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that are turned into arrays at a time; a longer text is a piece of its own.
CHUNK_BYTES = 2_000_000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    is_break = np.zeros(256, bool)
    is_break[list(WORD_BREAKS)] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    weight = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    return is_break, lower, weight


IS_BREAK, LOWER, BYTE_WEIGHT = _tables()
FOLDED_WEIGHT = BYTE_WEIGHT[LOWER]
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `limit` bytes."""
    data, offsets = as_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of marked bytes; no run crosses a text's border."""
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:n]
    start = np.flatnonzero(begins)
    count = np.diff(np.searchsorted(start, offsets))
    return start, np.flatnonzero(ends) + 1, np.repeat(np.arange(len(count)), count)


KEPT_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0, 1, ... n - 1. Those for a piece of usual length are kept; callers leave them as they are."""
    out = KEPT_POWERS.get(base)
    if out is None or len(out) < n:
        out = np.full(n if n > CHUNK_BYTES else min(CHUNK_BYTES, 1 << n.bit_length()), np.uint64(base))
        out[:1] = 1
        np.cumprod(out, out=out)
        if n <= CHUNK_BYTES:
            KEPT_POWERS[base] = out
    return out[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, equal spans giving equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    value = (FOLDED_WEIGHT if fold_case else BYTE_WEIGHT)[data]
    value *= powers(BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    back = powers(BASE_INVERSE, len(data) + 1)
    return mix64((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and hash of each word."""
    start, end, doc = runs(~IS_BREAK[data], offsets)
    return start, end, doc, span_hashes(data, start, end, fold_case)


def shingle_hashes(doc: np.ndarray, word: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word shingles, and their offsets by text.

    A text of fewer words than `width` gives its whole sequence as one; a text
    without words gives none.
    """
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])
    value = np.zeros(len(word) + width, np.uint64)
    for k in range(width):
        key = np.uint64(mix64(np.array([k + 1], np.uint64))[0] | np.uint64(1))
        value[: len(word)] += np.concatenate([word[k:], np.zeros(min(k, len(word)), np.uint64)]) * key
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(first[:-1], made) + np.arange(out[-1]) - np.repeat(out[:-1], made)
    hashes = value[at]
    for d in np.flatnonzero((count > 0) & (count < width)):
        own, total = word[first[d] : first[d + 1]], np.uint64(0)
        for k, w in enumerate(own):
            total = mix64(np.array([total ^ w], np.uint64) + np.uint64(k + 77))[0]
        hashes[out[d]] = total
    return mix64(hashes), out
