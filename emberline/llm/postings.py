"""Packed postings: ascending whole numbers as gap bytes, and counts beside them.

A block of postings holds, for some keys and some texts, the number key * texts + text of every
pair that occurs. Blocks are what a shuffle by key carries: about a byte for a pair.
"""

from __future__ import annotations

import numpy as np

SKIP = 255


def pack(values: np.ndarray) -> bytes:
    """Ascending numbers of at least 0. A byte under 255 ends a number's gap; each 255 before it adds 255."""
    if not len(values):
        return b""
    gap = np.diff(values, prepend=0)
    skips, last = np.divmod(gap, SKIP)
    at = np.cumsum(skips + 1) - 1
    out = np.full(int(at[-1]) + 1, SKIP, np.uint8)
    out[at] = last
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != SKIP]


def pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts of at least 1: the places of those above 1, and by how much."""
    more = np.flatnonzero(counts > 1)
    return pack(more), pack(np.cumsum(counts[more] - 1))


def unpack_counts(places: bytes, by: bytes, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    out[unpack(places)] += np.diff(unpack(by), prepend=0)
    return out


def narrow(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned numbers that hold them; widen() needs to know how many there are."""
    top = int(counts.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return counts.astype(kind).tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(f"<u{len(data) // n}")).astype(np.int64) if n else np.zeros(0, np.int64)
