"""The same sums for less work: matrix products where pairs are many, and pieces of text that stay in the cache."""

from time import process_time

import numpy as np
import pyarrow as pa
import pytest

from emberline.llm import decontaminate as D
from emberline.llm import textvec


def gathered(pair, w, basis):
    """The product by one row of basis for each pair and side, as it was made before."""
    size, out = len(basis), np.zeros(basis.shape, np.float32)
    for k in range(0, len(pair), 8_000):
        a, b, v = pair[k : k + 8_000] // size, pair[k : k + 8_000] % size, w[k : k + 8_000].astype(np.float32)
        for to, of, x in ((a, b, v), (b[a != b], a[a != b], v[a != b])):
            order = np.argsort(to, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]]))
            out[to[order][at]] += np.add.reduceat(basis[of[order]] * x[order, None], at, axis=0)
    return out


def product(pair, w, basis, rows=10_000):
    batches = (pa.RecordBatch.from_arrays([pa.array(pair[k : k + rows]), pa.array(w[k : k + rows])], names=["pair", "w"]) for k in range(0, len(pair), rows))
    (part,) = D._products(basis)(batches)
    return np.frombuffer(part.column(0)[0].as_py(), np.float32).reshape(basis.shape)


@pytest.mark.parametrize("size, share, cells", [(300, 0.4, 1 << 22), (300, 0.4, 1000), (300, 0.4, 1), (300, 0.002, 1 << 22), (5000, 0.01, 1 << 22), (1, 1.0, 1 << 22)])
def test_products_match_the_whole_matrix(monkeypatch, size, share, cells):
    monkeypatch.setattr(D, "CELLS", cells)
    random = np.random.default_rng(7)
    a, b = np.nonzero(np.triu(random.random((size, size)) < share))
    w, basis = random.random(len(a)), random.standard_normal((size, 16)).astype(np.float32)
    order = random.permutation(len(a))  # no order of the pairs is needed for a right result
    whole = np.zeros((size, size))
    whole[a, b] = whole[b, a] = w
    assert np.abs(product((a * size + b)[order], w[order], basis, 700) - whole @ basis).max() < 1e-2
    assert not product(np.zeros(0, np.int64), np.zeros(0), basis).any()


def test_many_pairs_cost_less_than_a_row_each():
    random = np.random.default_rng(8)
    a, b = np.nonzero(np.triu(random.random((1000, 1000)) < 0.3))
    w, basis = random.random(len(a)), random.standard_normal((1000, 256)).astype(np.float32)
    start = process_time()
    plain = gathered(a * 1000 + b, w, basis)
    middle = process_time()
    got = product(a * 1000 + b, w, basis)
    end = process_time()
    assert np.abs(got - plain).max() < 1e-2
    assert end - middle < (middle - start) / 2


def test_frequencies_take_small_pieces_and_count_all(monkeypatch):
    p, random = D.Latent(), np.random.default_rng(9)
    names = [f"w{k}" for k in range(500)]
    texts = [" ".join(random.choice(names, n)) for n in random.integers(0, 2000, 300)] + [None, "", "other"]
    vocabulary = D.Vocabulary(D.tokens(*D._joined(names[:400]))[1])
    seen = []
    monkeypatch.setattr(D, "tokens", lambda data, offsets, real=D.tokens: seen.append(len(data)) or real(data, offsets))
    (out,) = D._frequencies(p, vocabulary)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    total, n_blocks = np.zeros(vocabulary.size, int), 0
    for text in texts:
        own = vocabulary.of(D.tokens(*D._joined([text or ""]))[1])
        parts = [own[s : s + p.block] for s in range(0, len(own), p.block)] or [own]
        n_blocks += len(parts)
        for part in parts:
            total[np.unique(part[part >= 0])] += 1
    got = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert [got.get(f, 0) for f in range(vocabulary.size)] == total.tolist() and got[-1] == n_blocks and got[-2] == len(texts)
    first = seen[: len(seen) - len(texts)]
    assert sum(first) == sum(len(t or "") for t in texts) and max(first) <= D.PIECE


def test_powers_of_any_length():
    for n in (0, 1, 5, 3, 1000, textvec.CHUNK_BYTES + 1, 7):
        got = textvec.powers(textvec.BASE, n)
        assert len(got) == n and got[:3].tolist() == [1, textvec.BASE, textvec.BASE**2 % 2**64][:n]
        assert n < 4 or (got[1:] == got[:-1] * np.uint64(textvec.BASE)).all()
