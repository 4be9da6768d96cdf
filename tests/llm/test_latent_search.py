"""Texts that lack an item's words are left out before vectors are made, and none that could be found."""

import numpy as np
import pyarrow as pa

from emberline.llm import decontaminate as D


def test_search_finds_the_same_without_vectors_for_the_rest(monkeypatch):
    p, random = D.Latent(), np.random.default_rng(5)
    names, common = [f"w{k}" for k in range(400)], [f"c{k}" for k in range(30)]
    items = [" ".join([*random.choice(names, 40), *random.choice(common, 10)]) for _ in range(20)] + ["w1", "", "w1 w1 w1 w2"]
    texts = [" ".join(random.choice(common if k % 2 else names[300:], 200)) for k in range(300)] + ["", None, "c3 other"]
    for k in range(0, 300, 10):
        own = items[k % 20].split()
        texts[k] = " ".join([*["other"] * 90, *[w for w in own if random.random() < (1.0, 0.8, 0.6)[k % 3]], *["more"] * 50])
    vocabulary = D.Vocabulary(D.tokens(*D._joined(items))[1])
    vectors = random.standard_normal((vocabulary.size, 64)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    vectored = []
    monkeypatch.setattr(D, "summed", lambda *a, real=D.summed: vectored.append(len(a[1])) or real(*a))
    found = lambda: sorted(tuple(r.values()) for b in D._search(p, vocabulary, vectors, list(range(len(items))), items)(iter([batch])) for r in b.to_pylist())
    got, cost = found(), sum(vectored)
    monkeypatch.setattr(D.ItemWords, "enough", lambda self, doc, feature, n_docs: np.ones(n_docs, bool))
    vectored.clear()
    want = found()
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and len(got) >= 15
    assert cost < sum(vectored) / 2
