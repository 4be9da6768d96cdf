"""Byte-level BPE: encoding by padded matrices of token ids, and decoding.

A text is cut by a pattern, and every match is merged by itself. Matches that a
task has not met yet are encoded together: those of about one length stand as
rows of one padded matrix, and in each round every row merges its leftmost pair
of the least rank. A row that merges is one token shorter afterwards, so the whole
matrix is compacted by one column, and rows without a pair left leave it.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that the rank files were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Encoding:
    """widest: bytes of the longest match that is merged in a matrix; longer ones, which would need as many rounds as they have
    bytes, merge along a heap, with the same result. cells: bytes of matches in one matrix. known: matches whose ids a task
    remembers before it forgets them all; it changes no result."""

    pattern: str = PATTERN
    widest: int = 256
    cells: int = 1 << 22
    known: int = 1 << 19


class PairTable:
    """(left id, right id) to the id of the merged token, by open addressing in arrays; NONE for pairs that never merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(left) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key = self.key(left, right)
        at, todo = self.slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = key[free]  # of several for one slot the last stays
            won = free[self.keys[at[free]] == key[free]]
            self.values[at[won]] = merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids of flat arrays of pairs; a negative id on either side merges with nothing."""
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = self.key(left[todo], right[todo])
        at = self.slot(key)
        while len(todo):
            have = self.keys[at]
            hit = have == key
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (have >= 0)
            todo, key, at = todo[go], key[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


class Merges:
    """A vocabulary of ranked byte strings, ready to encode and decode. The rank of a token is its id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.full(256, -1, np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int32), np.array(right, np.int32), np.array(merged, np.int32))
        self.tokens = {rank: token for token, rank in ranks.items()}
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary needs a token for each of the 256 bytes")

    def encode_all(self, pieces: list[bytes], p: Encoding) -> list[bytes]:
        """Ids of each piece as packed little-endian unsigned 32-bit integers. An empty piece has none."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:  # a piece that is a token is never split
                out[k] = rank.to_bytes(4, "little")
            elif len(piece) > p.widest:
                out[k] = self.merge_long(piece)
            elif piece:
                by_width.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, rows in by_width.items():
            step = max(1, p.cells // width)
            for k in range(0, len(rows), step):
                own = rows[k : k + step]
                for row, ids in zip(own, self.merge_rows([pieces[r] for r in own], width), strict=True):
                    out[row] = ids
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """One matrix: a row for each piece, its free cells -1."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        filled = np.arange(width) < length[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[filled] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        # rank[r, j] is that of the pair (j, j + 1); the last column has no pair.
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        row_of, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(ids):
            at = rank.argmin(axis=1)  # the leftmost of the least
            best = rank[np.arange(len(ids)), at]
            ends = best == NONE
            for r in np.flatnonzero(ends):
                out[row_of[r]] = ids[r][ids[r] >= 0].astype("<u4").tobytes()
            go = ~ends
            ids, rank, row_of, at, best = ids[go], rank[go], row_of[go], at[go], best[go]
            if not len(ids):
                break
            own = np.arange(len(ids))
            ids[own, at] = best
            keep = np.ones(ids.shape, bool)
            keep[own, at + 1] = False
            ids = ids[keep].reshape(len(own), -1)
            keep[own, at + 1], keep[own, at] = True, False
            rank = rank[keep].reshape(len(own), -1)
            wide = ids.shape[1]
            after = np.where(at + 1 < wide, ids[own, np.minimum(at + 1, wide - 1)], -1)
            before = np.where(at > 0, ids[own, np.maximum(at - 1, 0)], -1)
            new = self.pairs(np.concatenate([best, before]), np.concatenate([after, best]))
            rank[own, at] = new[: len(own)]
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = new[len(own) :][inner]
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges along a heap of (rank, place), with links to the neighbours that are left."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        first = self.pairs(ids[:-1], ids[1:]).tolist()
        ids, n, none = ids.tolist(), len(ids), int(NONE)
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), [*first, none]
        heap = [(r, k) for k, r in enumerate(first) if r != none]
        heapq.heapify(heap)
        tokens, ranks = self.tokens, self.ranks
        while heap:
            r, k = heapq.heappop(heap)
            if rank[k] != r or ids[k] < 0:
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = r, -1, after[gone]
            rank[gone] = none
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left < 0:
                    continue
                right = after[left]
                new = none if right >= n else ranks.get(tokens[ids[left]] + tokens[ids[right]], none)
                rank[left] = new
                if new != none:
                    heapq.heappush(heap, (new, left))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a line for each token: its bytes in base 64, a space, its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


@lru_cache(maxsize=2)
def merges_of(data: bytes) -> Merges:
    """Made once a worker for each vocabulary."""
    return Merges(read_ranks(data))


class Encoder:
    """Encodes texts; remembers the ids of matches met before."""

    def __init__(self, merges: Merges, p: Encoding) -> None:
        import regex

        self.merges, self.p = merges, p
        self.split: Callable[[str], list[str]] = regex.compile(p.pattern).findall
        self.ids: dict[str, bytes] = {}

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        """Packed ids of each text."""
        cut = [self.split(t) for t in texts]
        if len(self.ids) > self.p.known:
            self.ids.clear()
        fresh = [x for x in set(chain.from_iterable(cut)) if x not in self.ids]
        self.ids.update(zip(fresh, self.merges.encode_all([x.encode() for x in fresh], self.p), strict=True))
        known = self.ids.__getitem__
        return [b"".join(map(known, own)) for own in cut]


def groups_of(texts: list[str | None], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of whole texts of about limit characters."""
    first = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > limit:
            yield first, k
            first, size = k, 0
        size += len(text or "")
    if first < len(texts):
        yield first, len(texts)


def _encode(vocabulary: bytes, p: Encoding) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges_of(vocabulary), p)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, end in groups_of(texts):
                ids = encoder(t or "" for t in texts[first:end])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(ids, pa.binary())], names=["id", "ids"])

    return run


def _decode(vocabulary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = merges_of(vocabulary).decode
        for batch in batches:
            made = [decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["id", "ids", "decoded"])

    return run


def bpe_encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", params: Encoding | None = None) -> DataFrame:
    """(id_col, ids) for every row of docs: the text's token ids, packed as little-endian unsigned 32-bit integers.

    ranks_path names a rank file that the driver can read; its bytes, which a vocabulary bounds, go to the tasks with the
    code. No special tokens: their strings are ordinary text. A null or empty text has no ids; rows with a
    null or repeated id are each encoded; other columns are ignored. An empty table gives no rows.
    """
    data = Path(ranks_path).read_bytes()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encode(data, params or Encoding()), f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, decoded): the bytes that packed ids stand for. Null ids decode to nothing; an unknown id is an error."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("binary").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_decode(Path(ranks_path).read_bytes()), f"id {kind}, ids binary, decoded binary")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")


def id_list(ids: bytes | None) -> list[int]:
    """Packed ids as integers, for use on single rows."""
    return np.frombuffer(ids or b"", "<u4").tolist()
