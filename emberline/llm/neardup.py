"""MinHash near-duplicates by HyperMinHash.

Every distinct shingle set gets compressed registers: a leading-zero count and
a few mantissa bits of the smallest hash in each bucket. Bands of registers
give candidates, the collision-corrected estimate thins them, and the full
shingle sets confirm what is left. Links are made between classes (texts with
the same set are one), never between all pairs of a group.

Exactness. A pair at or above the threshold shares a band but for a chance of
5e-8 at the production parameters. Among sets that share bands no link is lost:

1. Every set is held against one leader, the one that leads most of its bands. A band is led by the set
   that meets the most others in all its bands, which in a group of copies is close to their base.
2. Bands whose sets are in one component by then are closed. In the others, a
   set too many of whose shingles no other open set has can't be similar to any.
3. What is left is held against its band's hub, a typical set that serves as many bands as it can, so that a
   set meets few hubs. A set y that is not similar to the hub can be similar to a set x only if both differ
   from the hub in common shingles, so x is looked up by the rarest of those
   (see deviations()), and the pairs found are held against each other. That holds for any hub, in the band or not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import Scratch, cut_lineage
from .textvec import mix64, pieces, shingle_hashes, words

EMPTY = 0xFFFF
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@dataclass(frozen=True)
class HyperMinHash:
    """Parameters of sketch and bands.

    width: words of a shingle. percent: least similarity. index_bits: 2**index_bits buckets.
    mantissa_bits: kept after the leading one. bands x rows registers are used for banding, where a
    bucket that a set leaves empty borrows from another. chance: how often the estimate may rule out
    a pair at the threshold. hot_share: classes with at least this share of all rows are looked up by
    broadcast, so there are 1 / hot_share of them at most. broadcast_rows: bound of a broadcast list of ids.
    """

    width: int = 5
    percent: int = 80
    index_bits: int = 7
    mantissa_bits: int = 10
    bands: int = 32
    rows: int = 4
    chance: float = 1e-9
    hot_share: float = 0.001
    broadcast_rows: int = 1_000_000


def compress(value: np.ndarray, mantissa_bits: int) -> np.ndarray:
    """Leading-zero count and the following mantissa bits of unsigned 64-bit values, as one uint16."""
    high = (value >> np.uint64(32)).astype(np.float64)
    zeros = np.where(high > 0, 32 - np.frexp(high)[1], 32).astype(np.uint64)
    mantissa = (value << (zeros + np.uint64(1))) >> np.uint64(64 - mantissa_bits)
    return ((zeros << np.uint64(mantissa_bits)) | mantissa).astype(np.uint16)


def bucket_registers(sorted_hashes: np.ndarray, p: HyperMinHash) -> np.ndarray:
    """Registers of one set from its sorted distinct hashes: the first of each bucket is its least."""
    shift = np.uint64(64 - p.index_bits)
    bucket = (sorted_hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    out = np.full(1 << p.index_bits, EMPTY, np.uint16)
    out[bucket[first]] = compress(sorted_hashes[first] << np.uint64(p.index_bits), p.mantissa_bits)
    return out


def random_walks(p: HyperMinHash) -> np.ndarray:
    buckets = 1 << p.index_bits
    return (mix64(np.arange(1, 257 * buckets + 1, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64).reshape(257, buckets)


def filled(registers: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Empty buckets borrow from buckets that a fixed random walk of their own visits."""
    out = registers.copy()
    row, bucket = np.nonzero((registers == EMPTY) & (registers != EMPTY).any(axis=1)[:, None])
    for walk in probes:
        if not len(row):
            return out
        got = registers[row, walk[bucket]]
        have = got != EMPTY
        out[row[have], bucket[have]] = got[have]
        row, bucket = row[~have], bucket[~have]
    for r, b in zip(row, bucket, strict=True):
        have = np.flatnonzero(registers[r] != EMPTY)
        out[r, b] = registers[r, have[np.searchsorted(have, probes[-1][b]) % len(have)]]
    return out


def band_keys(registers: np.ndarray, p: HyperMinHash) -> np.ndarray:
    """One 64-bit key for each row and band."""
    used = registers[:, : p.bands * p.rows].astype(np.uint64).reshape(len(registers), p.bands, p.rows)
    key = np.broadcast_to(mix64(np.arange(p.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1 << 20)), used.shape[:2]).copy()
    for k in range(p.rows):
        key = mix64(key ^ (used[:, :, k] + np.uint64((k + 1) << 20)))
    return key.view(np.int64)


def as_binary(registers: np.ndarray) -> pa.Array:
    size = registers.shape[1] * registers.itemsize
    return pa.Array.from_buffers(pa.binary(), len(registers), [None, pa.py_buffer(np.arange(len(registers) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(registers))])


def as_registers(column: pa.Array, p: HyperMinHash) -> np.ndarray:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint16).reshape(len(column), 1 << p.index_bits)


def distinct_sets(column: pa.Array, p: HyperMinHash) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingle hashes of each row) by runs of rows."""
    for row, end, data, offsets in pieces(column):
        _, _, doc, word = words(data, offsets)
        hashes, at = shingle_hashes(doc, word, end - row, p.width)
        yield row, [np.unique(hashes[at[k] : at[k + 1]]) for k in range(end - row)]


def _sketches(p: HyperMinHash) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in distinct_sets(batch.column(2), p):
                with np.errstate(over="ignore"):
                    print_a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    print_b = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), batch.column(1).slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(print_a), pa.array(print_b), as_binary(np.stack([bucket_registers(s, p) for s in sets]))],
                    names=["id", "text_hash", "n_shingles", "print_a", "print_b", "registers"],
                )

    return run


def _bands(p: HyperMinHash) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = random_walks(p)
        for batch in batches:
            if len(batch):
                keys = band_keys(filled(as_registers(batch.column(1), p), probes), p)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), p.bands)), pa.array(keys.ravel())], names=["node", "band"])

    return run


def _full_sets(p: HyperMinHash) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in distinct_sets(batch.column(1), p):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()), as_binary(np.stack([bucket_registers(s, p) for s in sets])), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["node", "n", "registers", "hashes"],
                )

    return run


def least_same(p: HyperMinHash) -> np.ndarray:
    """For each number of used registers, the count of equal ones that a pair at the threshold falls below with at most that chance."""
    most, share = 1 << p.index_bits, p.percent / 100
    out = np.zeros(most + 1, np.int64)
    for used in range(most + 1):
        below, same = 0.0, 0
        while same < used:
            below += comb(used, same) * share**same * (1 - share) ** (used - same)
            if below > p.chance:
                break
            same += 1
        out[used] = same
    return out


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, p: HyperMinHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Jaccard of each pair from registers, less the matches that chance alone would give; the used registers; the chance."""
    used = (a != EMPTY) | (b != EMPTY)
    same, n_used = ((a == b) & used).sum(axis=1), used.sum(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(1, np.minimum(n_a, n_b))
    # Fixed value: expected share of chance matches for one mantissa bit less than none.
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / 2**p.mantissa_bits
    return np.maximum(0.0, same / np.maximum(1, n_used) - chance) / (1 - chance), n_used, chance


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, p: HyperMinHash, least: np.ndarray) -> np.ndarray:
    """Which pairs the full sets have to decide: few used registers say little, so they rule out less."""
    value, used, chance = estimates(a, b, n_a, n_b, p)
    return value >= np.maximum(0.0, least[used] / np.maximum(1, used) - chance) / (1 - chance) - 1e-12


def lists(column: pa.Array) -> list[np.ndarray]:
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[at[k] : at[k + 1]] for k in range(len(column))]


def is_in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the sorted x are in the sorted y."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def _verified(p: HyperMinHash) -> Batches:
    """(a, b, registers and hashes of both) to the pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_same(p)
        for batch in batches:
            if not len(batch):
                continue
            x, y = lists(batch.column("hashes_a")), lists(batch.column("hashes_b"))
            n_x, n_y = np.array([len(s) for s in x]), np.array([len(s) for s in y])
            keep = may_link(as_registers(batch.column("registers_a"), p), as_registers(batch.column("registers_b"), p), n_x, n_y, p, least)
            keep &= np.minimum(n_x, n_y) * 100 >= np.maximum(n_x, n_y) * p.percent
            for k in np.flatnonzero(keep):
                both = int(is_in(x[k], y[k]).sum())
                keep[k] = 100 * both >= p.percent * (n_x[k] + n_y[k] - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _deviations(p: HyperMinHash) -> Batches:
    """(node, hub, component, hashes, hub_hashes) to (node, hub, component, n, linked, size, need, partly, tokens); see deviations()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, linked, size, need, partly, tokens = [], [], [], [], [], []
            for own, hub in zip(lists(batch.column("hashes")), lists(batch.column("hub_hashes")), strict=True):
                differ = np.concatenate([own[~is_in(own, hub)], hub[~is_in(hub, own)]])
                over = len(differ) * (100 + p.percent) - (len(own) + len(hub)) * (100 - p.percent)
                n.append(len(own))
                linked.append(over <= 0)
                size.append(len(differ))
                need.append(max(1, -(-over // 200)))
                partly.append(max(need[-1], (len(differ) * (100 + p.percent) + (len(hub) - len(own)) * (100 - p.percent)) // (2 * (100 + p.percent)) + 1))
                tokens.append(differ.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("hub"), batch.column("component"), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), pa.array(size, pa.int64()), pa.array(need, pa.int64()), pa.array(partly, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["node", "hub", "component", "n", "linked", "size", "need", "partly", "tokens"],
            )

    return run


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (a, b) but those that are their own component; component is the least node reachable.

    Alternates the large-star and small-star steps until no edge changes, each
    step an aggregation and a join, so a hub is never gathered in one task.
    """
    state_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = scratch.store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), thin=True)
    seen = state_of(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("u <> m").select("u", "m"))
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.store(small.union(least.select("u", "m")).distinct(), thin=True)
        state = state_of(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def star_labels(stars: DataFrame) -> DataFrame:
    """(node, component) for every node of stars (a, b), of which a is the middle: the least node of the stars that it is in, a part of its true component."""
    members = stars.select(F.col("a").alias("star"), F.col("b").alias("node")).union(stars.select("a", "a").distinct())
    least = members.groupBy("star").agg(F.min("node").alias("m"))
    return members.join(least, "star").groupBy("node").agg(F.min("m").alias("component"))


def merged(component: DataFrame, spokes: DataFrame) -> DataFrame:
    """component (node, component), each of which is widened by the links spokes (hub, node, component of node)."""
    hubs = placed(spokes.select(F.col("hub").alias("node"), F.col("component").alias("b")), component.withColumnRenamed("component", "a"), "a")
    wider = star_labels(hubs.where("a <> b").select("a", "b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    known = component.union(wider.select("component", "component"))
    return known.join(wider, "component", "left").groupBy("node").agg(F.min(F.coalesce("wider", "component")).alias("component"))


def leaders(bands: DataFrame) -> DataFrame:
    """(band, leader): of each band (rows band, node, c) the node whose bands hold the most nodes, the likeliest base of its copies."""
    mass = bands.groupBy("node").agg(F.sum("c").alias("mass"))
    return bands.join(mass, "node").groupBy("band").agg(F.max_by("node", F.struct("mass", "node")).alias("leader"))


def nearest(bands: DataFrame) -> DataFrame:
    """(a, b): for each node b the leader a of the most of its bands (rows band, node, leader), the least of equals."""
    met = bands.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("c"))
    return met.groupBy(F.col("node").alias("b")).agg(F.max_by("leader", F.struct("c", F.negative("leader"))).alias("a")).select("a", "b")


def open_bands(rows: DataFrame) -> DataFrame:
    """Those rows (band, component, n, ..) whose band holds more than one component, with least_n of the band."""
    mixed = rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least_n")).where("lo <> hi").select("band", "least_n")
    return rows.join(mixed, "band")


def linkable(rows: DataFrame, sets: DataFrame, p: HyperMinHash) -> DataFrame:
    """(node, own) of those nodes of rows (node, n, least_n) that can still be similar to another of them.

    own counts the shingles that no other of the nodes has. A set of n shingles and a partner of m share
    n - own at most, and m is at least least_n, what they share, and percent of n; so their similarity is at
    most (n - own) / (n + m - (n - own)). Nothing that could be linked is lost, however many there are.
    """
    nodes = rows.groupBy("node", "n").agg(F.min("least_n").alias("least_n"))
    spread = sets.join(nodes, "node", "left_semi").select("node", F.explode("hashes").alias("h"))
    single = spread.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("own"))
    shared = F.col("n") - F.col("own")
    partner = F.greatest(F.col("least_n"), shared, F.ceil(F.col("n") * p.percent / 100))
    scored = nodes.join(single, "node", "left").fillna(0, ["own"])
    return scored.where(shared * 100 >= (F.col("n") + partner - shared) * p.percent).select("node", "own")


def shared_hubs(rows: DataFrame) -> DataFrame:
    """(band, hub) of rows (band, node, own): few hubs for all bands, so that a node meets few of them.

    Each band proposes the node with the fewest shingles of its own. Of the proposals of its bands each node takes the one that
    meets the most rows, and a band's hub is the one that the most of its nodes take.
    """
    met = rows.join(rows.groupBy("band").agg(F.min_by("node", F.struct("own", "node")).alias("hub")), "band").select("band", "node", "hub")
    first = lambda by: F.max_by("hub", F.struct(by, F.negative("hub"))).alias("hub")
    taken = met.join(met.groupBy("hub").agg(F.count("*").alias("c")), "hub").groupBy("node").agg(first("c"))
    return rows.select("band", "node").join(taken, "node").groupBy("band", "hub").agg(F.count("*").alias("c")).groupBy("band").agg(first("c"))


def deviations(met: DataFrame, sets: DataFrame, p: HyperMinHash) -> DataFrame:
    """met (node, hub, component) with n, linked, size, need, partly and tokens, the shingles that only one of node and hub has.

    Let x and y be linked, d(x) the tokens of x, n(x) its shingles, t the threshold and r = (1 - t) / (1 + t). The sets
    differ in |d(x)| + |d(y)| - 2 |d(x) & d(y)| shingles, r (n(x) + n(y)) at most. As n(x) is n(hub) + |d(x)| at most
    and |d(x)| no less than |d(x) & d(y)|, the latter is at least (|d(y)| - r (n(hub) + n(y))) / (1 + r), which is above
    0 just when y is not linked to the hub. That is `need`. All but need - 1 of y's tokens hold one of x's.
    """
    own, hubs = sets.select("node", "hashes"), sets.select(F.col("node").alias("hub"), F.col("hashes").alias("hub_hashes"))
    both = met.join(own, "node").join(hubs, "hub").select("node", "hub", "component", "hashes", "hub_hashes")
    return both.mapInArrow(_deviations(p), "node long, hub long, component long, n long, linked boolean, size long, need long, partly long, tokens array<long>")


def able(dev: DataFrame, p: HyperMinHash) -> DataFrame:
    """Those deviations that can be in a link at all, with most and least.

    x shares with y no more tokens than it has in common with any other, s(x). So a link needs most(x) >= least(y)
    and most(y) >= least(x), where most(x) = 2 s(x) - |d(x)| + r n(x) and least(y) = |d(y)| - r n(y) (both times 100 + percent).
    """
    dev = dev.repartition("node", "hub")  # tasks of even size to explode
    tokens = dev.select("hub", "node", F.explode("tokens").alias("token"))
    single = tokens.groupBy("hub", "token").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("hub", "node").agg(F.count("*").alias("single"))
    scored = dev.join(single, ["hub", "node"], "left").fillna(0, ["single"])
    scored = scored.withColumn("most", (F.col("size") - 2 * F.col("single")) * (100 + p.percent) + F.col("n") * (100 - p.percent))
    scored = scored.withColumn("least", F.col("size") * (100 + p.percent) - F.col("n") * (100 - p.percent)).drop("single")
    bounds = scored.groupBy("hub").agg(F.max("most").alias("top"), F.min(F.when(~F.col("linked"), F.col("least"))).alias("low"), F.min("least").alias("lowest"))
    may = F.when(F.col("linked"), F.col("most") >= F.col("low")).otherwise((F.col("least") <= F.col("top")) & (F.col("most") >= F.col("lowest")))
    return scored.join(bounds, "hub").where(may & (F.col("linked") | (F.col("size") >= F.col("need")))).drop("top", "low", "lowest")


def by_rare_tokens(dev: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share one of the rarest tokens of each, of which one at least is not linked to the hub."""
    rows = scratch.store(dev.repartition("node", "hub").select("hub", "node", "component", "linked", "need", "partly", "most", "least", F.explode("tokens").alias("token")))
    common = rows.groupBy("hub", "token").agg(F.count("*").alias("df")).where("df > 1")
    found = scratch.store(rows.join(common, ["hub", "token"]).groupBy("hub", "node", "component", "linked", "need", "partly", "most", "least").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("found")))

    def rarest(of: DataFrame, least: str, mark: str) -> DataFrame:
        first = F.slice("found", F.lit(1), (F.size("found") - F.col(least) + 1).cast("int"))["token"]
        return of.where(F.size("found") >= F.col(least)).select("hub", *[F.col(c).alias(c + mark) for c in ("node", "component", "most", "least")], F.explode(first).alias("token"))

    met = rarest(found.where("not linked"), "need", "_y").join(rarest(found, "partly", "_x"), ["hub", "token"])
    met = met.where("node_y <> node_x and component_y <> component_x and most_y >= least_x and most_x >= least_y")
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: HyperMinHash | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Texts are linked when 100 * |A & B| >= percent * |A | B| over their
    distinct word shingles (A-Z lower-cased, words split at the ASCII space
    characters). component_id is the least id that links reach.

    A null, empty or wordless text has no shingles and is linked with nothing. Rows that repeat an id
    are each judged by their own text; kept says that the id is the component's least, so of equal rows
    each is kept. A row with a null id takes part like any other; it is kept only where no row of its
    component has an id. Other columns are ignored. An empty table gives no rows.
    """
    out = _judged(docs, id_col, text_col, params or HyperMinHash())
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: HyperMinHash | None = None) -> DataFrame:
    """docs with one row of each component, that of the least id; columns as before.

    Of rows that repeat both id and text one stays; rows that repeat an id with another text
    are judged by that text. A row with a null id goes if a row with an id is in its component; components
    without any id keep one row of each different text. Null, empty and wordless texts are in no group. An empty table stays empty.
    """
    p = params or HyperMinHash()
    judged = _judged(docs, id_col, text_col, p)
    dropped = cut_lineage(judged.where("not kept").select("id", "text_hash").distinct())
    listed = F.broadcast(dropped) if dropped.count() <= p.broadcast_rows else dropped
    key = [docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))]
    out = docs.join(listed, key[0].eqNullSafe(dropped["id"]) & (key[1] == dropped["text_hash"]), "left_anti")
    if judged.where("kept and n_shingles > 0").groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        return out
    is_group = F.coalesce(F.trim(F.translate(docs[text_col].cast("string"), "\t\n\x0b\f\r", " ")) != "", F.lit(False))
    first = out.where(is_group).groupBy(*[k.alias(f"_k{n}") for n, k in enumerate(key)]).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("_row"))
    return first.select("_row.*").unionByName(out.where(~is_group))


def _judged(docs: DataFrame, id_col: str, text_col: str, p: HyperMinHash) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept) of every row of docs, cut off."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        sketches = scratch.store(texts.mapInArrow(_sketches(p), "id long, text_hash long, n_shingles long, print_a long, print_b long, registers binary"))
        classes = _classes(sketches, scratch)
        component = _components(texts, classes, scratch, p)
        return cut_lineage(_by_row(sketches, classes, component, scratch, p))


PRINTS = ("n_shingles", "print_a", "print_b")


def _classes(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, prints, least_id, text_hash, copies, registers), a row for each different set; id and text_hash name one of its texts."""
    grouped = sketches.where("n_shingles > 0").groupBy(*PRINTS).agg(F.min("id").alias("least_id"), F.coalesce(F.min_by("text_hash", "id"), F.first("text_hash")).alias("text_hash"), F.count("*").alias("copies"), F.first("registers").alias("registers"))
    return scratch.store(grouped.withColumn("node", F.monotonically_increasing_id()))


def _components(texts: DataFrame, classes: DataFrame, scratch: Scratch, p: HyperMinHash) -> DataFrame:
    """(node, component) of the classes that are linked with another, but for each component's least node."""
    rows = classes.select("node", "registers").mapInArrow(_bands(p), "node long, band long")
    shared = rows.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    bands = scratch.store(rows.join(shared, "band").select("band", "node", "c"))
    wanted = scratch.store(classes.select("node", F.col("n_shingles").alias("n"), F.col("least_id").alias("id"), F.col("text_hash").alias("hash")).join(bands.select("node").distinct(), "node", "left_semi"))
    n_wanted = wanted.count()
    if not n_wanted:
        return bands.select("node", F.col("node").alias("component")).limit(0)

    asked = wanted.select("node", F.col("id").alias("wanted_id"), "hash")
    asked = F.broadcast(asked) if n_wanted <= p.broadcast_rows else asked
    picked = texts.join(asked, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("hash"))).select("node", "text")
    sets = scratch.store(picked.mapInArrow(_full_sets(p), "node long, n long, registers binary, hashes array<long>"))
    if sets.count() > n_wanted:  # rows that repeat both id and text
        sets = scratch.store(sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "registers", "hashes")]))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("node").alias(x), F.col("registers").alias(f"registers_{x}"), F.col("hashes").alias(f"hashes_{x}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_verified(p), "a long, b long")

    links = scratch.store(verified(nearest(bands.join(leaders(bands), "band"))), thin=True)
    component = scratch.store(star_labels(links), thin=True)
    left = scratch.store(open_bands(placed(bands.select("band", "node").join(wanted.select("node", "n"), "node"), component)))
    left = scratch.store(open_bands(left.drop("least_n").join(linkable(left, sets, p), "node")).drop("least_n"))
    if left.isEmpty():
        return connected_components(links, scratch)
    led = scratch.store(left.join(shared_hubs(left), "band").select("band", "node", "n", "hub", "component"))
    dev = scratch.store(deviations(led.where("node <> hub").groupBy("node", "hub").agg(F.first("component").alias("component")), sets, p))
    spokes = dev.where("linked").select("hub", "node", "component")
    component = scratch.store(merged(component, spokes), thin=True)
    still = open_bands(placed(led.drop("component"), component)).select("node", "hub", "component").distinct()
    close = scratch.store(able(dev.drop("component").join(still, ["node", "hub"]), p))
    more = scratch.store(verified(by_rare_tokens(close, scratch)), thin=True)
    return connected_components(links.union(spokes.select("hub", "node")).union(more), scratch)


def placed(rows: DataFrame, component: DataFrame, name: str = "component") -> DataFrame:
    """rows (node, ..) with their component; a node without links is its own."""
    return rows.join(component, "node", "left").withColumn(name, F.coalesce(name, "node"))


def _by_row(sketches: DataFrame, classes: DataFrame, component: DataFrame, scratch: Scratch, p: HyperMinHash) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept) of every sketch."""
    members = component.union(component.select("component", "component").distinct()).join(classes.select("node", "least_id"), "node")
    least = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = members.join(least, "component").select("node", "component_id")
    table = classes.select("node", *PRINTS, "least_id", "copies").join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "least_id"))
    table = scratch.store(table.where("copies > 1 or not component_id <=> least_id").select(*PRINTS, "copies", "component_id"))
    rows = sketches.select("id", "text_hash", *PRINTS)
    is_hot = F.col("copies") >= max(1000, p.hot_share * sketches.count())
    rows = rows.join(F.broadcast(table.where(is_hot).select(*PRINTS, F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))), list(PRINTS), "left")
    cold = rows.where("hot is null").drop("hot", "hot_id").join(table.where(~is_hot).select(*PRINTS, "component_id"), list(PRINTS), "left")
    out = cold.select("id", "text_hash", "n_shingles", "component_id").union(rows.where("hot").select("id", "text_hash", "n_shingles", "hot_id"))
    component_id = F.coalesce("component_id", "id")
    return out.withColumn("component_id", component_id).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
