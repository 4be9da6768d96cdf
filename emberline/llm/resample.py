"""Importance resampling towards a target corpus, by bucket-partitioned inverted postings.

Features are hashed runs of words. Tasks turn their texts into postings (bucket, document, count) and
send them to the range of buckets they fall in; the target corpus sends its counts to the same
places. There both meet: a bucket's gain follows from its counts in both, each posting gives its
document a contribution, and contributions are summed by document. A range of buckets is dealt over several
tasks by blocks of texts, so that a bucket which stands in every text has no task of its own; only counts of buckets go to all of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from ..operators.reach import numbered
from .postings import narrow, pack, pack_counts, unpack, unpack_counts, widen
from .textvec import LOWER, pieces, runs

# Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ROWS = "part int, kind int, total long, data binary, places binary, by binary, first long, texts int, ids array<long>, features array<long>, words array<long>"
GIVEN = "key long, weight long, id long, features long, words long"
#: Kinds of rows in the order in which a task needs them.
DOCUMENTS, TARGET, POSTINGS = 0, 1, 2


@dataclass(frozen=True)
class Resample:
    """longest: words of the longest feature. buckets: hashed features. least_words: shorter texts are not drawn. share: percent of the
    others that are drawn. seed: goes into the draw's hash. ranges: parts of the buckets; each has as many tasks as make up the
    session's shuffle partitions."""

    longest: int = 3
    buckets: int = 10_000
    least_words: int = 20
    share: int = 5
    seed: int = 42
    ranges: int = 8

    def border(self, r: int) -> int:
        """The first bucket of range r."""
        return r * self.buckets // self.ranges


def word_bytes() -> np.ndarray:
    out = np.zeros(256, bool)
    out[48:58] = out[97:123] = out[128:] = True
    return out


IS_WORD = word_bytes()


class Crc:
    """CRC-32 of many byte spans at once, and of spans joined, by tables of what zero bytes behind a span do."""

    FEW = 64

    def __init__(self) -> None:
        c = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            c = np.where(c & 1, np.uint32(POLYNOMIAL) ^ (c >> np.uint32(1)), c >> np.uint32(1)).astype(np.uint32)
        self.table = c
        at = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        few = [at]
        for _ in range(self.FEW):
            few.append(self.table[few[-1] & 255] ^ (few[-1] >> np.uint32(8)))
        self.few = np.stack(few)  # by length 0 to 64, place of the byte, byte
        self.powers = [self.few[self.FEW]]  # of 64 times 1, 2, 4, ... zero bytes
        for _ in range(26):
            last = self.powers[-1]
            self.powers.append(self.shifted(last, last.ravel()).reshape(4, 256))

    @staticmethod
    def shifted(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]

    def after(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What crc adds to the CRC of its span with length bytes behind it."""
        low = length % self.FEW
        out = self.few[low, 0, crc & 255] ^ self.few[low, 1, (crc >> 8) & 255] ^ self.few[low, 2, (crc >> 16) & 255] ^ self.few[low, 3, crc >> 24]
        for k, tables in enumerate(self.powers):
            if not (own := np.flatnonzero((length // self.FEW >> k) & 1)).size:
                if not (length // self.FEW >> k).any():
                    break
                continue
            out[own] = self.shifted(tables, out[own])
        return out

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC of each span: all spans advance by a byte at a time; long ones are left to the library."""
        length = end - start
        out, long = np.empty(len(start), np.uint32), np.flatnonzero(length > self.FEW)
        order = np.argsort(-length, kind="stable")
        order = order[len(long) :]
        state, at, size = np.full(len(order), 0xFFFFFFFF, np.uint32), start[order], length[order]
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -k, "left"))
            state[:live] = self.table[(state[:live] ^ data[at[:live] + k]) & 255] ^ (state[:live] >> np.uint32(8))
        out[order] = ~state
        for k in long:
            out[k] = zlib.crc32(data[start[k] : end[k]].tobytes())
        return out


CRC = Crc()


def features_of(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and text number of every run of 1 to longest words, and the number of words by text. A-Z count as a-z."""
    low = LOWER[data]
    start, end, doc = runs(IS_WORD[low], offsets)
    length = end - start
    word = CRC.spans(low, start, end)
    spaced = CRC.after(np.full(len(word), zlib.crc32(b" "), np.uint32), length) ^ word
    hashes, docs, now = [word], [doc], word
    for k in range(1, longest):
        now = CRC.after(now[:-1], length[k:] + 1) ^ spaced[k:]
        inside = doc[k:] == doc[: len(doc) - k]
        hashes.append(now[inside])
        docs.append(doc[k:][inside])
        if not len(now):
            break
    return np.concatenate(hashes), np.concatenate(docs), np.bincount(doc, minlength=len(offsets) - 1)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema() -> pa.Schema:
    many = pa.list_(pa.int64())
    return pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("total", pa.int64()), ("data", pa.binary()), ("places", pa.binary()), ("by", pa.binary()), ("first", pa.int64()), ("texts", pa.int32()), ("ids", many), ("features", many), ("words", many)])


def _emit(p: Resample, kind: int, salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to postings by range of buckets, and at a task's end its counts of all buckets for every place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, task = _schema(), TaskContext.get().partitionId()
        totals, chunk, key = np.zeros(p.buckets, np.int64), task, task << 40
        for batch in batches:
            for row, end, data, offsets in pieces(batch.column(1)):
                n = end - row
                crc, doc, words = features_of(data, offsets, p.longest)
                bucket = (crc % np.uint32(p.buckets)).astype(np.int64)
                totals += np.bincount(bucket, minlength=p.buckets)
                if kind == TARGET:
                    continue
                pairs, counts = np.unique(bucket * n + doc, return_counts=True)
                borders = np.searchsorted(pairs, [p.border(r) * n for r in range(p.ranges + 1)])
                rows = []
                for r in range(p.ranges):
                    own = slice(borders[r], borders[r + 1])
                    places, by = pack_counts(counts[own])
                    out = {"part": r * salts + chunk % salts, "kind": POSTINGS, "data": pack(pairs[own] - p.border(r) * n), "places": places, "by": by, "first": key, "texts": n}
                    if r == 0:  # also says what documents there are
                        out |= {"ids": batch.column(0).slice(row, n).to_pylist(), "features": np.bincount(doc, minlength=n).tolist(), "words": words.tolist()}
                    rows.append(out)
                yield _batch(rows, schema)
                chunk, key = chunk + 1, key + n
        every = int(totals.sum())
        own = [narrow(totals[p.border(r) : p.border(r + 1)]) for r in range(p.ranges)]
        yield _batch([{"part": r * salts + s, "kind": kind, "total": every, "data": own[r]} for r in range(p.ranges) for s in range(salts)], schema)

    return run


def gains(p: Resample, s: np.ndarray, t: np.ndarray, all_s: int, all_t: int) -> np.ndarray:
    """floor(1000 ln of a bucket's smoothed share of the target over that of the corpus), in doubles."""
    more = float(p.buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (all_s + more) / ((a + 1.0) * (all_t + more)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.float64)


def _settle(p: Resample, salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one place after the other, counts before postings, to contributions by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, gain, sizes, sums = None, None, None, None
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for k in range(len(batch)):
                at, kind, total, data, places, by, first, texts = (c[k].as_py() for c in columns[:8])
                if at != part:
                    part, gain, r = at, None, at // salts
                    width = p.border(r + 1) - p.border(r)
                    sums, sizes = np.zeros((2, width), np.int64), [0, 0]
                if kind != POSTINGS:
                    sums[kind] += widen(data, width)
                    sizes[kind] += total
                    continue
                if gain is None:
                    gain = gains(p, sums[0], sums[1], *sizes)
                pairs = unpack(data)
                bucket, doc = np.divmod(pairs, texts)
                given = np.bincount(doc, weights=gain[bucket] * unpack_counts(places, by, len(pairs)), minlength=texts).astype(np.int64)
                own = np.arange(texts) if r == 0 else np.unique(doc)
                more = [columns[c].slice(k, 1).flatten() if r == 0 else pa.nulls(len(own), pa.int64()) for c in (8, 9, 10)]
                yield pa.RecordBatch.from_arrays([pa.array(first + own), pa.array(given[own]), *more], names=["key", "weight", "id", "features", "words"])

    return run


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", params: Resample | None = None) -> DataFrame:
    """(id_col long, n_words, n_features, weight) for every row of docs: the sum of its features' gains.

    Null and empty texts have no features and weigh 0. Rows with a null or repeated id are each weighed. An empty
    target counts 0 in every bucket. Other columns are ignored. An empty table gives no rows.
    """
    p = params or Resample()
    spark = docs.sparkSession
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // p.ranges))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_emit(p, DOCUMENTS, salts), ROWS)
    other = target.select(F.lit(None).cast("long").alias("id"), F.col(target_col).cast("string").alias("text")).mapInArrow(_emit(p, TARGET, salts), ROWS)
    met = own.unionByName(other).repartitionById(p.ranges * salts, "part").sortWithinPartitions("part", "kind")
    given = met.mapInArrow(_settle(p, salts), GIVEN)
    summed = given.groupBy("key").agg(F.sum("weight").alias("weight"), F.max("id").alias("id"), F.max("features").alias("n_features"), F.max("words").alias("n_words"))
    return summed.select(F.col("id").alias(id_col), "n_words", "n_features", "weight")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", params: Resample | None = None) -> DataFrame:
    """(id_col, n_features, weight, score, rank) for every row of docs; rank is null for rows that are not drawn.

    The draw is without replacement: a score is the weight plus Gumbel noise made of the seed and the id, and the share of the rows of
    at least least_words words with the highest scores is drawn. Equal scores go by id, null ids last (their noise is that of an empty
    id), then by n_features. Rows with equal ids share their noise. See weigh() for odd rows.
    """
    p = params or Resample()
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut_lineage(weigh(docs, target, id_col, text_col, target_col, p).withColumn("score", (F.col("weight") + noise).cast("long")))
    fit = scored.where(F.col("n_words") >= p.least_words)
    drawn = fit.count() * p.share // 100
    ranked = numbered(fit, [F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features")], "_n").withColumn("rank", F.when(F.col("_n") <= drawn, F.col("_n")).cast("long"))
    rest = scored.where(F.col("n_words") < p.least_words).withColumn("rank", F.lit(None).cast("long"))
    names = [id_col, "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(rest.select(*names))
