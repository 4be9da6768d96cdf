"""Alignment of two tokenizers against a plain version over all token pairs, and odd rows."""

import hashlib
import json
from collections import Counter
from functools import cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from emberline.functions.session import read_table
from emberline.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


@cache
def letters():
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter, n = {}, 0
    for byte in range(256):
        if byte in plain:
            letter[chr(byte)] = byte
        else:
            letter[chr(256 + n)] = byte
            n += 1
    return letter


def plain_bytes_a(model, k):
    return bytes(letters()[c] for c in model.id_to_token(k))


def plain_bytes_b(model, k):
    piece = model.id_to_piece(k)
    return bytes.fromhex(piece[3:5]) if model.is_byte(k) else piece.replace("▁", " ").encode()


def plain_align(libraries, docs):
    a, b = libraries
    links, meta = [], []
    for doc, text in docs:
        said = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a, bytes_b = [plain_bytes_a(a, k) for k in ids_a], [plain_bytes_b(b, k) for k in ids_b]
        if not text or b"".join(bytes_a) != said or b"".join(bytes_b) != said:
            links.append([])
            meta.append((doc, 0, 0, 0, 0, ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        own = [(x, y) for x, xe, xs in zip(ids_a, ends_a, [0, *ends_a], strict=False) for y, ye, ys in zip(ids_b, ends_b, [0, *ends_b], strict=False) if xs < ye and ys < xe] if len(ids_a) < 300 else None
        if own is None:  # a long text: the same by a walk
            own, j = [], 0
            for x, xe, xs in zip(ids_a, ends_a, [0, *ends_a], strict=False):
                while ends_b[j] <= xs:
                    j += 1
                k = j
                while k < len(ids_b) and (ends_b[k - 1] if k else 0) < xe:
                    own.append((x, ids_b[k]))
                    k += 1
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for cut in cuts:
            g, h = i, j
            while i < len(ids_a) and ends_a[i] <= cut:
                i += 1
            while j < len(ids_b) and ends_b[j] <= cut:
                j += 1
            groups.append(",".join(map(str, ids_a[g:i])) + "|" + ",".join(map(str, ids_b[h:j])))
        links.append(own)
        meta.append((doc, len(ids_a), len(ids_b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for own in links for x in own)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    rows = [(d, na, nb, ng, nl, sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), g) for own, (d, na, nb, ng, nl, g) in zip(links, meta, strict=True)]
    return sorted(rows, key=repr), count, top


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_equals_the_plain_version(spark, libraries):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    want, count, top = plain_align(libraries, [(r.doc_id, r.text) for r in docs.collect()])
    texts, pairs = alignment.align(docs, A, B)
    assert rows_of(texts) == want
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {x: (n, n == top[x[1]]) for x, n in count.items()}


def test_any_blocks_and_places_give_the_same_rows(spark, libraries):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").where("length(text) < 2000")
    want, _, _ = plain_align(libraries, [(r.doc_id, r.text) for r in docs.collect()])
    for p in (alignment.Alignment(chars=1, ranges=1), alignment.Alignment(chars=5000, ranges=7)):
        assert rows_of(alignment.align(docs.repartition(5), A, B, params=p)[0]) == want


def test_odd_rows(spark, libraries):
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "no id at all"), (5, "alpha beta gamma delta " * 5000), (6, "é😀 naïve 漢字 ½ Å ﬁ"), (7, "two  spaces"), (8, "tab\there\nline"), (9, " leading"),
        (10, "trailing "), (11, "<|endoftext|> <s> </s> <unk> <0x41>"), (12, "▁ mark"), (13, "à combining"), (14, "x" * 3000), (15, "\x00\x01 control"), (16, "ends\n"),
    ]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in texts], "doc_id long, text string, part string, key long, n_a int")
    want, _, _ = plain_align(libraries, texts)
    got = rows_of(alignment.align(docs, A, B)[0])
    assert got == want
    assert sum(r[1] == 0 for r in got) >= 3 and sum(r[1] > 0 for r in got) >= 8
    empty, pairs = alignment.align(docs.limit(0), A, B)
    assert empty.count() == 0 and pairs.count() == 0
    nothing, pairs = alignment.align(docs.where("doc_id < 3"), A, B)
    assert nothing.count() == 2 and pairs.count() == 0


def test_a_pair_in_every_text(spark, libraries):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words and "), F.col("id").cast("string")).alias("text")).repartition(6)
    want, _, _ = plain_align(libraries, [(k, f"the same words and {k}") for k in range(3000)])
    assert rows_of(alignment.align(docs, A, B)[0]) == want


def test_ranks_and_cuts():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 500):
        ends = np.unique(np.concatenate([rng.integers(1, n + 1, n // 3 + 1), [n]]))
        bits = alignment.Ends(ends, n)
        assert bits.rank(np.arange(n + 1)).tolist() == [int((ends <= k).sum()) for k in range(n + 1)]
        other = np.unique(np.concatenate([rng.integers(1, n + 1, n // 2 + 1), [n]]))
        assert bits.shared(alignment.Ends(other, n)).tolist() == sorted(set(ends.tolist()) & set(other.tolist()))


def test_both_libraries_of_byte_level_files_agree(libraries):
    """Ids by rank are those of the file's own library, over characters of every kind and over words."""
    data = Path(A).read_bytes()
    quick = alignment.byte_level(data)
    points = [chr(c) for c in [*range(1, 0xD800, 3), *range(0xE000, 0x10000, 5), *range(0x10000, 0x110000, 997)]]
    texts = ["a" + c + "b1" + c + "2 " + c + c + "! " + c for c in points] + ["it's we'll I'M  x   ", "\n\n \n", "<|endoftext|>", "x" * 700, "ab" * 300]
    for got, want in zip(quick.encode(texts), libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids
    other = json.loads(data)
    other["model"]["merges"] = other["model"]["merges"][::-1]
    assert not alignment.in_order_of_ids({t: k for t, k in other["model"]["vocab"].items() if k != 50256}, other["model"]["merges"])
    slow = alignment.byte_level(json.dumps(other).encode())
    assert slow.encode(["one two"])[0].tolist() != quick.encode(["one two"])[0].tolist() and slow.joined(slow.encode(["one two"])[0]) == b" one two"


def test_words_are_coded_as_in_their_texts(libraries):
    rng = np.random.default_rng(8)
    letters = list("abcdefgh    \n\t'.,éß漢😀019<>/") + ["<s>", "</s>", "<0x41>", "▁", "the", " of "]
    texts = ["".join(rng.choice(letters, rng.integers(1, 120))) for _ in range(2000)] + ["", " ", "  ", "a  b", " a", "a ", "a\n b\r\nc"]
    model = alignment.piece_level(Path(B).read_bytes())
    assert isinstance(model.encode, alignment.Words)
    got = model.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        if "▁" not in text:  # such a text does not give back its bytes in any case
            assert ids.tolist() == libraries[1].encode(text)
