"""Cross-tokenizer alignment: where two tokenizers' tokens of one text begin and end together, and which overlap.

Byte ends of both tokenizers' tokens stand in packed bitsets over a block of texts. Their AND
holds the shared cuts; set bits counted before a place (a prefix of popcounts) say which token a byte belongs to, so
cuts map to ranges of tokens, and each token of the one to the tokens of the other that it overlaps. How
often a pair of ids is linked is counted over the whole corpus: a text's pairs travel as packed
postings to the range of right-hand ids they fall in, where the counts of that range meet them.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import Scratch, cut_lineage
from .bytebpe import groups_of
from .postings import pack, pack_counts, unpack, unpack_counts

CODED = "key long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, part int, first long, texts int, pairs binary, data binary, places binary, by binary"
GIVEN = "key long, n_best long, count_sum long"
#: What a coded row of a text leaves null, and what a row of postings leaves null.
TEXT_COLUMNS = ("key", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


@dataclass(frozen=True)
class Alignment:
    """chars: characters of texts that are tokenized together. ranges: parts of the right-hand ids; each has as many tasks as make
    up the session's shuffle partitions."""

    chars: int = 1_000_000
    ranges: int = 16


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokens:
    """Texts to ids, and each id's bytes. encode() gets texts without the space that both tokenizers put or find before them."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], table: list[bytes]) -> None:
        self.encode = encode
        self.table = np.array([*table, None], object)[:-1]
        self.size = np.fromiter(map(len, table), np.int64, len(table))
        self.named = np.array([str(k).encode() for k in range(len(table))], object)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.table[ids].tolist())


def in_order_of_ids(vocabulary: dict[str, int], merges: list) -> bool:
    """Whether the k-th merge makes the k-th id that is not a byte, so that an id is a rank."""
    made = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
    return None not in made and made == sorted(set(made)) and len(vocabulary) == 256 + len(made)


def byte_level(data: bytes) -> Tokens:
    """A tokenizers file of byte-level BPE; it is given a space before each text, and special strings are ordinary text.

    Where the file has plain byte-level BPE whose merges are in the order of their ids, a token's rank is its id, and of a span that no
    merge crosses all merges of lower ranks leave the one pair that the list has for it. Then merging by ranks
    gives the same ids, and the quicker library is used; else the library of the file.
    """
    from .bytebpe import PATTERN

    parsed, letters = json.loads(data), byte_letters()
    special = {t["content"] for t in parsed.get("added_tokens") or []}
    model, cut = parsed["model"], parsed.get("pre_tokenizer") or {}
    vocabulary = {t: k for t, k in model["vocab"].items() if t not in special}
    table = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in parsed.get("added_tokens") or [])]))
    for token, k in vocabulary.items():
        table[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and parsed.get("normalizer") is None
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if plain and in_order_of_ids(vocabulary, model["merges"]):
        from tiktoken import Encoding

        ranked = Encoding("ranked", pat_str=PATTERN, mergeable_ranks={table[k]: k for k in vocabulary.values()}, special_tokens={})
        return Tokens(lambda texts: [ranked.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts], table)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(data.decode())
    library.encode_special_tokens = True
    return Tokens(lambda texts: [np.array(x.ids, np.int64) for x in library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], table)


def parts_at_spaces(data: bytes, names: list[str]) -> bool:
    """Whether a model merges pairs, leaves texts as they are and has no piece over the border before a space, so that words are coded each by itself."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(data)
    rule, fit = model.normalizer_spec, model.trainer_spec
    kept = rule.name == "identity" and not rule.precompiled_charsmap and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces
    return kept and fit.model_type == fit.BPE and not fit.treat_whitespace_as_suffix and not any("▁" in x.lstrip("▁") for x in names)


class Words:
    """Codes texts of single spaces word by word and remembers words; other texts are left to the library whole."""

    KNOWN = 1 << 18

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]) -> None:
        self.library, self.ids = encode, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cut = [t.split(" ") for t in texts]
        if len(self.ids) > self.KNOWN:
            self.ids.clear()
        fresh = [w for w in set(chain.from_iterable(cut)) if w and w not in self.ids]
        self.ids.update(zip(fresh, (array("i", x).tobytes() for x in self.library(fresh)), strict=True))
        out = [np.array(self.library([t])[0], np.int64) if "" in own else np.frombuffer(b"".join(map(self.ids.__getitem__, own)), np.int32).astype(np.int64) for t, own in zip(texts, cut, strict=True)]
        return out


def piece_level(data: bytes) -> Tokens:
    """A sentencepiece model with byte fallback, which puts the space before a text itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=data)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    table = [bytes([int(x[3:5], 16)]) if model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
    library = lambda texts: model.encode(texts, num_threads=1)
    return Tokens(Words(library) if parts_at_spaces(data, names) else lambda texts: [np.array(x, np.int64) for x in library(texts)], table)


@lru_cache(maxsize=2)
def tokenizers_of(left: bytes, right: bytes) -> tuple[Tokens, Tokens]:
    """Made once a worker."""
    return byte_level(left), piece_level(right)


class Ends:
    """Ends of tokens over the bytes of a block, as a packed bitset with counts before each word of 64."""

    def __init__(self, ends: np.ndarray, n_bytes: int) -> None:
        marks = np.zeros(-(-(n_bytes + 1) // 64) * 64, np.uint8)
        marks[ends] = 1
        self.bits = np.packbits(marks, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of ends at places up to and including at, which is the number of the token that holds byte at."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        upto = self.bits[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(upto)

    def shared(self, other: Ends) -> np.ndarray:
        """Places where tokens of both end, ascending."""
        return np.flatnonzero(np.unpackbits((self.bits & other.bits).view(np.uint8), bitorder="little"))


def link(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of the given sizes in bytes that cover the same bytes: cuts' token ranks in A and in B, and the links.

    A rank is the number of tokens up to a shared cut. Links are (token of A, first token of B, how many of B).
    """
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    n = int(end_a[-1]) if len(end_a) else 0
    ends_a, ends_b = Ends(end_a, n), Ends(end_b, n)
    cuts = ends_a.shared(ends_b)
    first = ends_b.rank(end_a - size_a)
    return ends_a.rank(cuts), ends_b.rank(cuts), np.arange(len(size_a)), first, ends_b.rank(end_a - 1) - first + 1


def written(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, a: Tokens, b: Tokens) -> bytes:
    """Groups of one text as a1,a2|b1;a3|b2,b3."""
    if not len(ids_a):
        return b""
    n_a, n_b = len(ids_a), len(ids_b)
    out = np.empty(2 * (n_a + n_b), object)
    # A token stands after the tokens of its own list before it and those of the other list in earlier groups.
    group_a, group_b = np.searchsorted(cut_a, np.arange(n_a), "right"), np.searchsorted(cut_b, np.arange(n_b), "right")
    at_a = np.arange(n_a) + np.concatenate([[0], cut_b])[group_a]
    at_b = np.arange(n_b) + cut_a[group_b]
    mark_a, mark_b = np.full(n_a, b",", object), np.full(n_b, b",", object)
    mark_a[cut_a - 1], mark_b[cut_b - 1] = b"|", b";"
    out[2 * at_a], out[2 * at_a + 1] = a.named[ids_a], mark_a
    out[2 * at_b], out[2 * at_b + 1] = b.named[ids_b], mark_b
    return b"".join(out[:-1].tolist())


def _code(left: bytes, right: bytes, p: Alignment, salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to rows of texts and rows of postings by range of right-hand ids."""
    kinds = {"key": pa.int64(), "id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "part": pa.int32(), "first": pa.int64(), "texts": pa.int32(), "pairs": pa.binary(), "data": pa.binary(), "places": pa.binary(), "by": pa.binary()}
    schema = pa.schema(list(kinds.items()))

    def postings(codes: np.ndarray, doc: np.ndarray, texts: int, first: int, chunk: int) -> Iterator[dict]:
        """codes: right id << 32 | left id of each link, ranges of right ids being runs of the sorted distinct ones."""
        distinct, place = np.unique(codes, return_inverse=True)
        pairs, counts = np.unique(place * texts + doc, return_counts=True)
        owner = (distinct >> 32) % p.ranges
        for r in np.unique(owner):
            own = np.flatnonzero(owner == r)
            new = np.full(len(distinct), -1, np.int64)
            new[own] = np.arange(len(own))
            held = new[pairs // texts] >= 0
            places, by = pack_counts(counts[held])
            yield {"part": int(r) * salts + chunk % salts, "first": first, "texts": texts, "pairs": distinct[own].astype("<i8").tobytes(), "data": pack(new[pairs[held] // texts] * texts + pairs[held] % texts), "places": places, "by": by}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers_of(left, right)
        task = TaskContext.get().partitionId()
        key, chunk = task << 40, task
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, end in groups_of(texts, p.chars):
                rows, whole = [], []
                for k, text in enumerate(texts[begin:end]):
                    rows.append({"key": key + k, "id": ids[begin + k], "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""})
                    if text:
                        whole.append((k, text))
                own_a, own_b = a.encode([t for _, t in whole]), b.encode([t for _, t in whole])
                kept = []
                for (k, text), x, y in zip(whole, own_a, own_b, strict=True):
                    said = (" " + text).encode()
                    if a.joined(x) == said == b.joined(y):
                        kept.append((k, x, y))
                if kept:
                    ids_a, ids_b = np.concatenate([x for _, x, _ in kept]), np.concatenate([y for _, _, y in kept])
                    cut_a, cut_b, token, first, count = link(a.size[ids_a], b.size[ids_b])
                    at_a, at_b = np.cumsum([0, *(len(x) for _, x, _ in kept)]), np.cumsum([0, *(len(y) for _, _, y in kept)])
                    borders = np.searchsorted(cut_a, at_a, "right")  # a text's end is a cut, so groups never cross it
                    for n, (k, x, y) in enumerate(kept):
                        own = slice(borders[n], borders[n + 1])
                        made = written(x, y, cut_a[own] - at_a[n], cut_b[own] - at_b[n], a, b)
                        rows[k] |= {"n_a": len(x), "n_b": len(y), "n_groups": int(borders[n + 1] - borders[n]), "n_links": int(count[at_a[n] : at_a[n + 1]].sum()), "groups_sha256": hashlib.sha256(made).hexdigest()}
                    source = np.repeat(token, count)
                    target = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(source))
                    doc = np.repeat(np.array([k for k, _, _ in kept]), np.diff(at_a))
                    rows += postings((ids_b[target] << 32) | ids_a[source], doc[source], end - begin, key, chunk)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                key, chunk = key + end - begin, chunk + 1

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed postings to (b, a, n), summed over each batch's blocks."""
    for batch in batches:
        codes, counts = [], []
        for row in batch.to_pylist():
            pairs = np.frombuffer(row["pairs"], "<i8")
            place = unpack(row["data"]) // row["texts"]
            codes.append(pairs)
            counts.append(np.bincount(place, weights=unpack_counts(row["places"], row["by"], len(place)), minlength=len(pairs)))
        distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((distinct >> 32).astype(np.int32)), pa.array((distinct & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["b", "a", "n"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one place after the other, its counts in order of the pair before its postings, to shares of each text."""
    part, codes, counts, best, ready = None, [], [], [], False
    for batch in batches:
        parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
        borders = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1), len(parts)]
        for begin, end in zip(borders, borders[1:], strict=False):
            if begin == end:
                continue
            if parts[begin] != part:
                part, codes, counts, best, ready = parts[begin], [], [], [], False
            own = batch.slice(begin, end - begin)
            if kinds[begin] == 0:
                codes.append(own.column("pair").to_numpy())
                counts.append(own.column("n").to_numpy())
                best.append(own.column("best").to_numpy(zero_copy_only=False))
                continue
            if not ready:
                codes, counts, best, ready = np.concatenate(codes), np.concatenate(counts), np.concatenate(best), True
            for row in own.select(["first", "texts", "pairs", "data", "places", "by"]).to_pylist():
                at = np.searchsorted(codes, np.frombuffer(row["pairs"], "<i8"))
                place, doc = np.divmod(unpack(row["data"]), row["texts"])
                times = unpack_counts(row["places"], row["by"], len(place))
                total = np.zeros(row["texts"], np.int64)
                np.add.at(total, doc, counts[at][place] * times)
                tops = np.bincount(doc, weights=best[at][place] * times, minlength=row["texts"]).astype(np.int64)
                have = np.unique(doc)
                yield pa.RecordBatch.from_arrays([pa.array(row["first"] + have), pa.array(tops[have]), pa.array(total[have])], names=["key", "n_best", "count_sum"])


def align(docs: DataFrame, left_path: str, right_path: str, id_col: str = "doc_id", text_col: str = "text", params: Alignment | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs). texts: (id_col long, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs;
    pairs: (a, b, n, best), how often each pair of ids is linked in all docs, and whether no pair of its b is linked more often.

    left_path names a byte-level tokenizers file, right_path a sentencepiece model, both read by the driver and sent along, which a
    vocabulary bounds. Each text is a space and itself. Null and empty texts, and those whose tokens of either side do not give back the
    text's bytes, have no tokens. Rows with a null or repeated id are each aligned; other columns are ignored. An empty table gives no rows.
    """
    p = params or Alignment()
    spark = docs.sparkSession
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // p.ranges))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark) as scratch:
        coded = scratch.store(rows.mapInArrow(_code(Path(left_path).read_bytes(), Path(right_path).read_bytes(), p, salts), CODED))
        blocks = coded.where("part is not null").select("part", "first", "texts", "pairs", "data", "places", "by")
        counted = blocks.select("texts", "pairs", "data", "places", "by").mapInArrow(_counted, "b int, a int, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))
        counted = scratch.store(counted)
        pairs = cut_lineage(counted.join(counted.groupBy("b").agg(F.max("n").alias("_top")), "b").select("a", "b", "n", (F.col("n") == F.col("_top")).alias("best")))
        code = F.shiftleft(F.col("b").cast("long"), 32).bitwiseOR(F.col("a").cast("long"))
        places = F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: ((F.col("b") % p.ranges) * salts + s).cast("int"))
        totals = pairs.select(F.explode(places).alias("part"), F.lit(0).alias("kind"), code.alias("pair"), "n", "best")
        met = totals.unionByName(blocks.withColumn("kind", F.lit(1)), allowMissingColumns=True).repartitionById(p.ranges * salts, "part").sortWithinPartitions("part", "kind", "pair")
        given = met.mapInArrow(_settle, GIVEN).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        texts = coded.where("part is null").select(*TEXT_COLUMNS).join(given, "key", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        texts = cut_lineage(texts.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))
    return texts, pairs
