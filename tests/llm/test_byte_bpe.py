"""Byte-level BPE against the tiktoken library, round trips, and odd rows."""

import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

from emberline.llm import bytebpe, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def merges():
    return bytebpe.merges_of(Path(RANKS).read_bytes())


@pytest.fixture(scope="module")
def library():
    ranks = bytebpe.read_ranks(Path(RANKS).read_bytes())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(merges, library, texts, **params):
    got = bytebpe.Encoder(merges, bytebpe.Encoding(**params))(texts)
    return all(bytebpe.id_list(ids) == library.encode_ordinary(t) and merges.decode(ids) == t.encode() for t, ids in zip(texts, got, strict=True))


def test_every_kind_of_character_is_cut_like_the_library_cuts_it(merges, library):
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x3000 + 0xE000), *range(0x10000, 0x110000, 97)]]
    assert same(merges, library, ["a" + c + "b1" + c + "2 " + c + c + "! " + c for c in points])


def test_random_texts(merges, library):
    rng = random.Random(5)
    letters = "abcdefgh  \n\t'sré漢字😀019.,!ABC"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(1500)] + ["", " ", "\n\n \n", "<|endoftext|>", "it's we'll I'M"]
    assert same(merges, library, texts)
    assert same(merges, library, texts, cells=64, known=1)


def test_long_matches_merge_alike_in_a_matrix_and_along_a_heap(merges, library):
    rng = random.Random(6)
    texts = ["a" * 3000, "ab" * 1500, "".join(rng.choice("etaoin") for _ in range(3000)), "x" * 300 + " " * 700 + "y", "漢" * 900]
    assert same(merges, library, texts)
    assert same(merges, library, texts, widest=4096)
    assert same(merges, library, ["".join(rng.choice("etaoinABC012") for _ in range(300_000))])


def test_query_equals_the_library_on_whole_documents(spark, library):
    rows = {r.doc_id: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for doc, text in texts.items():
        ids = library.encode_ordinary(text)
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (rows[doc].n_tokens, rows[doc].ids_sha256, rows[doc].decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_odd_rows(spark):
    kind = "doc_id long, text string, ids string, decoded int"
    df = spark.createDataFrame([(1, None, "clash", 1), (1, None, "clash", 1), (None, "", None, None), (2, "ab", None, None)], kind)
    coded = bytebpe.bpe_decode(bytebpe.bpe_encode(df, RANKS), RANKS).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in coded) == [(0, b""), (1, b""), (1, b""), (2, b"ab")]
    assert bytebpe.bpe_encode(df.limit(0), RANKS).count() == 0
    with pytest.raises(ValueError, match="256 bytes"):
        bytebpe.Merges({b"a": 0})
