"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words) get TF-IDF vectors over hashed words; a randomised
SVD, its products summed over Spark partitions, gives a small latent space.
Windows whose latent cosine with a benchmark passage is high are candidates;
the longest common subsequence of words with the item, and for paraphrases the
item's answer, decide.

Document frequencies and the SVD cover all documents, whole, and the benchmark itself, over the words that the benchmark
uses: one pass over the texts sums the products of words in a block, and the SVD's products are made from those sums. Every window of every
whole text is searched, against the benchmark in blocks of a bounded number of items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .textvec import pieces, runs, span_hashes


@dataclass(frozen=True)
class Latent:
    """block: half a window, in words. rank: latent dimensions. doc_weight: what a document counts in the SVD's fit, of a
    benchmark passage; beyond even_docs documents they count as much as so many, each an equal share. item_block, item_chars: items searched at
    once, and code points of them, on average; they bound the vocabulary, the latent space and what a task holds. cosine: least similarity of a candidate. exact / paraphrase: least share of an item's words in the
    common subsequence. answer_words: the item's last words; answer: the share of them that a
    paraphrase must hold.
    """

    block: int = 24
    rank: int = 256
    even_docs: int = 1000
    doc_weight: float = 0.05
    item_block: int = 1000
    item_chars: int = 2_000_000
    cosine: float = 0.35
    exact: float = 0.9
    paraphrase: float = 0.7
    answer_words: int = 8
    answer: float = 0.6
    seed: int = 11


IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each word; punctuation separates words, A-Z is lower-cased."""
    start, end, doc = runs(IN_WORD[data], offsets)
    return doc, span_hashes(data, start, end)


def blocks(doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number of each word (blocks run on over the texts) and each text's first block; a text has one at least."""
    count = np.bincount(doc, minlength=n_docs)
    first_word = np.concatenate([[0], np.cumsum(count)])
    n_blocks = np.maximum(1, -(-count // size))
    first = np.concatenate([[0], np.cumsum(n_blocks)])
    within = np.arange(len(doc)) - first_word[doc] if len(doc) else np.zeros(0, np.int64)
    return (first[doc] + within // size) if len(doc) else within, first


class Vocabulary:
    """The benchmark's words by a direct-address table, so that looking a word up is one array access."""

    def __init__(self, word_hashes: np.ndarray, bits: int = 20) -> None:
        self.shift, self.hashes = np.uint64(64 - bits), np.unique(word_hashes)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.slots[(self.hashes >> self.shift).astype(np.int64)] = np.arange(len(self.hashes), dtype=np.int32)  # words in one slot share a feature
        self.size = len(self.hashes)

    def of(self, word: np.ndarray) -> np.ndarray:
        """Feature number of each word, -1 for words that the benchmark does not use."""
        return self.slots[(word >> self.shift).astype(np.int64)]


#: Bytes of text turned into words at a time, so that their arrays stay in the processor's cache.
PIECE = 100_000


def distinct(high: np.ndarray, low: np.ndarray, n_high: int, n_low: int) -> np.ndarray:
    """The sorted distinct values of high * n_low + low, for numbers below n_high and n_low; small ones as 32 bits, which sort quicker."""
    key = high * n_low + low
    key = np.sort(key.astype(np.int32) if n_high * n_low < 1 << 31 else key)
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def known(vocabulary: Vocabulary, word: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    feature = vocabulary.of(word)
    have = feature >= 0
    return feature[have].astype(np.int64), block[have]


def summed(table: np.ndarray, feature: np.ndarray, row: np.ndarray, n_rows: int, step: int = 1_000) -> np.ndarray:
    """Sums of table[feature] by row; rows come in order."""
    out = np.zeros((n_rows, table.shape[1]), np.float32)
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    # The first feature of all rows, then the second of those that have one: rows with most come first.
    order = np.argsort(-count, kind="stable")
    for s in range(0, n_rows, step):
        own = order[s : s + step]
        left, at, sums = count[own], first[own], np.zeros((len(own), table.shape[1]), np.float32)
        for k in range(left[0]):
            more = np.searchsorted(-left, -k)
            sums[:more] += table[feature[at[:more] + k]]
        out[own] = sums
    return out


def _frequencies(p: Latent, vocabulary: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_blocks, n_rows = np.zeros(vocabulary.size, np.int64), 0, 0
        for batch in batches:
            n_rows += len(batch)
            for row, end, data, offsets in pieces(batch.column(0), PIECE):
                doc, word = tokens(data, offsets)
                block, first = blocks(doc, end - row, p.block)
                feature, block = known(vocabulary, word, block)
                key = distinct(block, feature, int(first[-1]), vocabulary.size)
                total += np.bincount(key % vocabulary.size, minlength=vocabulary.size) if len(key) else 0
                n_blocks += int(first[-1])
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(have, [-1, -2])), pa.array(np.append(total[have], [n_blocks, n_rows]))], names=["feature", "n"])

    return run


def inverse_frequencies(texts: DataFrame, vocabulary: Vocabulary, p: Latent) -> tuple[np.ndarray, int]:
    """ln(1 + N / df) of each word over the blocks of all texts: common words weigh less, never nothing. And the number of texts."""
    counts = texts.mapInArrow(_frequencies(p, vocabulary), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df, n_blocks, n_rows = np.zeros(vocabulary.size), 1, 0
    for r in counts.collect():
        if r["feature"] == -1:
            n_blocks = max(1, r["n"])
        elif r["feature"] == -2:
            n_rows = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return np.log1p(n_blocks / np.maximum(df, 1)).astype(np.float32), n_rows


def windows_of(block_sums: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each block with the one after it in the same text."""
    out = block_sums.copy()
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    k = np.flatnonzero(inner)
    out[k] += block_sums[k + 1]
    return out


UNIT, COMMON = 1 << 20, 2048


def _pair_sums(p: Latent, vocabulary: Vocabulary, idf: np.ndarray, rank: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """This partition's share of A'A less the inverse frequencies, A being unit TF-IDF rows of blocks of words: (pair, w).

    pair is a * size + b for words a <= b by their rank in frequency. w is in whole UNITs, so that sums are the same in any order.
    Pairs of the commonest words are summed in a square, others in lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, top, square_idf = vocabulary.size, min(COMMON, vocabulary.size), idf.astype(np.float64) ** 2
        square, keys, sums, held = np.zeros(top * top, np.int64), [], [], 0

        def summed_rest() -> tuple[np.ndarray, np.ndarray]:
            pair, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, at, np.concatenate([np.zeros(0, np.int64), *sums]))
            return pair, total

        for batch in batches:
            for row, end, data, offsets in pieces(batch.column(0), PIECE):
                doc, word = tokens(data, offsets)
                block, first = blocks(doc, end - row, 2 * p.block)
                f, block = known(vocabulary, word, block)
                norm = np.bincount(block, weights=square_idf[f], minlength=first[-1])
                key, count = np.unique(block * size + rank[f], return_counts=True)
                block, r = key // size, key % size
                share = UNIT * count / np.maximum(norm[block], 1e-6)
                # Each word of a block with itself and those after it there.
                last = np.cumsum(np.bincount(block, minlength=first[-1]))[block]
                for k in range(0, len(r), 20_000):
                    at = np.arange(k, min(len(r), k + 20_000))
                    n = last[at] - at
                    i = np.repeat(at, n)
                    j = i + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                    low, high, w = r[i], r[j], np.rint(share[i] * count[j]).astype(np.int64)
                    common = high < top
                    np.add.at(square, low[common] * top + high[common], w[common])
                    keys.append((low * size + high)[~common])
                    sums.append(w[~common])
                    held += len(keys[-1])
                if held > 2_000_000:
                    pair, total = summed_rest()
                    if 2 * len(pair) > held:
                        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total)], names=["pair", "w"])
                        pair, total = pair[:0], total[:0]
                    keys, sums, held = [pair], [total], len(pair)
        at = np.flatnonzero(square)
        pair, total = summed_rest()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at // max(1, top) * size + at % max(1, top), pair)), pa.array(np.append(square[at], total))], names=["pair", "w"])

    return run


#: Cells of the matrix that are multiplied as a whole at a time, and the share of them that must be filled for that.
CELLS, FILLED = 1 << 22, 1 / 200


def _products(basis: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """This partition's share of the symmetric matrix of rows (pair, w) times basis. Pairs of one first word stand together, for speed alone."""
    size = len(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, n_held = np.zeros(basis.shape, np.float32), [], 0

        def add(to: np.ndarray, of: np.ndarray, w: np.ndarray) -> None:
            for k in range(0, len(to), 8_000):
                order = np.argsort(to[k : k + 8_000], kind="stable") + k
                line = to[order]
                at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                out[line[at]] += np.add.reduceat(basis[of[order]] * w[order, None], at, axis=0)

        def add_held() -> None:
            pair, w = (np.concatenate(x) for x in zip(*held, strict=True))
            line, a = np.unique(pair // size, return_inverse=True)
            b, order = pair % size, np.argsort(a, kind="stable")
            rows = max(1, CELLS // size)
            for k in range(0, len(line), rows):
                of = order[slice(*np.searchsorted(a[order], [k, k + rows]))]
                own = line[k : k + rows]
                if len(of) < FILLED * len(own) * size:
                    add(line[a[of]], b[of], w[of])
                    apart = of[line[a[of]] != b[of]]
                    add(b[apart], line[a[apart]], w[apart])
                else:
                    part = np.zeros((len(own), size), np.float32)
                    part[a[of] - k, b[of]] = w[of]  # a pair comes once
                    out[own] += part @ basis
                    part[np.arange(len(own)), own] = 0
                    for c in range(0, size, 4096):
                        out[c : c + 4096] += part[:, c : c + 4096].T @ basis[own]

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.float32)))
            n_held += len(batch)
            if n_held > 500_000:
                add_held()
                held, n_held = [], 0
        if held:
            add_held()
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

    return run


def latent_space(texts: DataFrame, items: DataFrame, vocabulary: Vocabulary, idf: np.ndarray, weight: float, p: Latent) -> np.ndarray:
    """Word vectors of the whitened latent space (words x rank), inverse frequencies included, of all texts, each counting weight, and items."""
    rank = min(p.rank, len(idf))
    order = np.argsort(idf, kind="stable")
    place = np.empty(len(idf), np.int64)
    place[order] = np.arange(len(idf))
    # The lines of basis stand for words by frequency, like the pairs.
    basis = np.random.default_rng(p.seed).standard_normal((len(idf), rank)).astype(np.float32)[order]
    own = idf[order][:, None]

    def sums(of: DataFrame, each: float) -> DataFrame:
        return of.mapInArrow(_pair_sums(p, vocabulary, idf, place), "pair long, w long").groupBy("pair").agg((F.sum("w") * (each / UNIT)).alias("w"))

    # A task for each core, so that each gives its pairs of words once.
    both = sums(texts.coalesce(max(1, texts.sparkSession.sparkContext.defaultParallelism)), weight).unionByName(sums(items, 1.0)).groupBy("pair").agg(F.sum("w").alias("w"))
    pairs = cut_lineage(both.repartition(6, F.expr(f"pair div {len(idf)}")).sortWithinPartitions("pair")).coalesce(6)

    def product(b: np.ndarray) -> np.ndarray:
        parts = pairs.mapInArrow(_products(own * b), "part binary").toLocalIterator()  # a few parts of one bounded size
        return own * sum((np.frombuffer(r["part"], np.float32).reshape(b.shape) for r in parts), np.zeros_like(b))

    for _ in range(2):
        basis = np.linalg.qr(product(basis))[0].astype(np.float32)
    core = basis.T @ product(basis)
    value, vector = np.linalg.eigh((core + core.T) / 2)
    # Directions that no passage has are noise and are left out; weak ones are not blown up without bound.
    top = max(1e-6, float(value.max()))
    scale = np.where(value > 1e-3 * top, 1 / np.sqrt(np.maximum(value, 1e-2 * top)), 0)
    return (own * (basis @ vector) * scale).astype(np.float32)[place]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    place: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        u = v & place.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def item_passages(texts: list[str], vocabulary: Vocabulary, vectors: np.ndarray, p: Latent) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Words of each item, the item of each passage, and the passages' unit latent vectors."""
    doc, word = tokens(*_joined(texts))
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    own = [word[cut[k] : cut[k + 1]] for k in range(len(texts))]
    of, sums = [], []
    for k, w in enumerate(own):
        for s in range(0, max(1, len(w) - p.block), p.block):
            part = w[s : s + 2 * p.block]
            if len(part):
                of.append(k)
                sums.append(vectors[known(vocabulary, part, part)[0]].sum(axis=0))
    return own, np.array(of, np.int64), unit(np.array(sums, np.float32).reshape(len(of), vectors.shape[1]))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def verdict(item: np.ndarray, region: np.ndarray, p: Latent) -> tuple[int, float, float] | None:
    """(common words, their share of the item, share of the answer) if the region holds the item."""
    held = set(region.tolist())
    if sum(map(held.__contains__, item.tolist())) < p.paraphrase * len(item):
        return None
    common = common_subsequence(item, region)
    share, answer = common / len(item), float(np.mean([x in held for x in item[-p.answer_words :].tolist()]))
    return (common, share, answer) if share >= p.exact or (share >= p.paraphrase and answer >= p.answer) else None


class ItemWords:
    """How often each word stands in each item, by word; tells which texts hold enough of an item's words for verdict()."""

    def __init__(self, own: list[np.ndarray], vocabulary: Vocabulary, p: Latent) -> None:
        self.size, self.items = max(1, vocabulary.size), max(1, len(own))
        item = np.repeat(np.arange(len(own)), [len(w) for w in own])
        key, self.count = np.unique(vocabulary.of(np.concatenate([np.zeros(0, np.uint64), *own])).astype(np.int64) * self.items + item, return_counts=True)
        self.item, self.first = key % self.items, np.searchsorted(key // self.items, np.arange(self.size + 1))
        length = np.array([len(w) for w in own] or [0])
        self.least = np.where(length > 0, p.paraphrase * length, np.inf)

    def enough(self, doc: np.ndarray, feature: np.ndarray, n_docs: int, step: int = 256) -> np.ndarray:
        """Which texts may get a verdict at all, from the features of their words; where words share a feature, more than those."""
        key = distinct(doc, feature, n_docs, self.size)
        doc, feature, out = key // self.size, key % self.size, np.zeros(n_docs, bool)
        for s in range(0, n_docs, step):
            at = slice(*np.searchsorted(doc, [s, min(n_docs, s + step)]))
            n = self.first[feature[at] + 1] - self.first[feature[at]]
            posting = np.repeat(self.first[feature[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows = min(n_docs, s + step) - s
            held = np.bincount(np.repeat(doc[at] - s, n) * self.items + self.item[posting], weights=self.count[posting], minlength=rows * self.items)
            out[s : s + rows] = (held.reshape(rows, self.items) >= self.least).any(axis=1)
        return out


def _search(p: Latent, vocabulary: Vocabulary, vectors: np.ndarray, ids: list[int], texts: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, item_of, items = item_passages(texts, vocabulary, vectors, p)
        held = ItemWords(own, vocabulary, p)
        kind = [("id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common_words", pa.int64()), ("share", pa.float64()), ("answer_share", pa.float64())]
        for batch in batches:
            doc_ids = batch.column(0)
            for row, end, data, offsets in pieces(batch.column(1), 2 * PIECE):
                doc, word = tokens(data, offsets)
                # Without most of some item's words verdict() is None for every region.
                enough = held.enough(*known(vocabulary, word, doc)[::-1], end - row)[doc]
                if not enough.any():
                    continue
                doc, word = doc[enough], word[enough]
                block, first = blocks(doc, end - row, p.block)
                feature, of = known(vocabulary, word, block)
                window = unit(windows_of(summed(vectors, feature, of, int(first[-1])), first))
                first_word = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=end - row))])
                best: dict[tuple[int, int], tuple] = {}
                doc_of = np.repeat(np.arange(end - row), np.diff(first))
                for s in range(0, len(window) if len(items) else 0, 2048):
                    score = window[s : s + 2048] @ items.T
                    for w, q in zip(*np.nonzero(score >= p.cosine), strict=True):
                        d, item = int(doc_of[s + w]), int(item_of[q])
                        reach = max(p.block, len(own[item]))
                        at = first_word[d] + (s + w - first[d]) * p.block
                        region = word[max(first_word[d], at - reach) : min(first_word[d + 1], at + 2 * p.block + reach)]
                        if found := verdict(own[item], region, p):
                            best[d, item] = max(best.get((d, item), (0,)), (found[0], found[1], found[2], float(score[w, q])))
                if best:
                    rows = [(doc_ids[row + d].as_py(), ids[item], c, n, share, answer) for (d, item), (n, share, answer, c) in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), kind, strict=True)], names=[k for k, _ in kind])

    return run


Search = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def searches(texts: DataFrame, benchmark: DataFrame, item_col: str, p: Latent) -> list[Search]:
    """A search of (id, text) for each block of items; texts has the columns id and text."""
    items = benchmark.where(F.length(F.trim("text")) > 0).select(F.col(item_col).cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_blocks = max(1, -(-size[0] // p.item_block), -(-size[1] // p.item_chars))
    out = []
    for k in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        rows = own.orderBy("item", "text").collect()  # item_block rows on average
        vocabulary = Vocabulary(tokens(*_joined([r["text"] for r in rows]))[1])
        idf, n_texts = inverse_frequencies(texts.select("text"), vocabulary, p)
        weight = p.doc_weight * min(1.0, p.even_docs / max(1, n_texts))
        vectors = latent_space(texts.select("text"), own.select("text"), vocabulary, idf, weight, p) if vocabulary.size else np.zeros((0, 1), np.float32)
        out.append(_search(p, vocabulary, vectors, [r["item"] for r in rows], [r["text"] for r in rows]))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", params: Latent | None = None) -> DataFrame:
    """(id_col, item_id, cosine, common_words, share, answer_share): documents that hold a benchmark item.

    Null and empty texts and items hold nothing and are held by nothing. Rows with
    a repeated or null id are each searched. Repeated items are each reported.
    Other columns are ignored. An empty benchmark or table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for search in searches(texts, benchmark, item_col, params or Latent()):
        found = texts.mapInArrow(search, "id long, item_id long, cosine double, common_words long, share double, answer_share double")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(id_col), *out.columns[1:])


def _without(search: Search, at: int) -> Search:
    """Rows whose text, in column number at, the search does not find an item in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(at)], names=["id", "text"])
            keep = np.ones(len(batch), bool)
            for found in search(iter([numbered])):
                keep[found.column(0).to_numpy()] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Latent | None = None) -> DataFrame:
    """Rows of docs that hold no benchmark item, judged in place with no join; columns as before.

    Rows with a null or repeated id are judged each by its own text, equal texts alike. Null and empty texts
    stay. An empty benchmark drops nothing, an empty table stays empty.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out, at = docs, docs.columns.index(text_col)
    for search in searches(texts, benchmark, "item_id", params or Latent()):
        out = out.mapInArrow(_without(search, at), docs.schema)
    return out
