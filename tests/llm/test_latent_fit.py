"""The latent space is fitted on every block of every document."""

import numpy as np
import pyarrow as pa
import pytest

from emberline.llm import decontaminate as D


@pytest.mark.parametrize("common", [2048, 20])
def test_pair_sums_match_the_whole_matrix(monkeypatch, common):
    monkeypatch.setattr(D, "COMMON", common)
    p, random = D.Latent(), np.random.default_rng(3)
    names = [f"w{k}" for k in range(60)]
    texts = [" ".join(random.choice(names, random.integers(0, 130))) for _ in range(40)]
    vocabulary = D.Vocabulary(D.tokens(*D._joined(names))[1])
    idf = random.uniform(0.5, 3, vocabulary.size).astype(np.float32)
    place = np.argsort(np.argsort(idf, kind="stable"), kind="stable")
    want = np.zeros((vocabulary.size, vocabulary.size))
    for t in texts:
        words = vocabulary.of(D.tokens(*D._joined([t]))[1])
        for s in range(0, len(words), 2 * p.block):
            part = words[s : s + 2 * p.block]
            count = np.bincount(part, minlength=vocabulary.size)
            want += np.outer(count, count) / (idf[part].astype(float) ** 2).sum()
    got = np.zeros_like(want)
    for batch in D._pair_sums(p, vocabulary, idf, place)(pa.RecordBatch.from_arrays([pa.array(t)], names=["text"]) for t in (texts[:15], texts[15:])):
        np.add.at(got, (batch.column(0).to_numpy() // vocabulary.size, batch.column(0).to_numpy() % vocabulary.size), batch.column(1).to_numpy() / D.UNIT)
    got += np.triu(got, 1).T
    assert np.abs(got[np.ix_(place, place)] - want).max() < 1e-4


def test_every_document_is_in_the_fit(spark, monkeypatch):
    """1,200 documents and three items: before, at most 1,000 documents were."""
    seen = []
    monkeypatch.setattr(D, "latent_space", lambda texts, *more, real=D.latent_space: seen.append(texts.count()) or real(texts, *more))
    docs = spark.range(1200).selectExpr("id AS doc_id", "concat_ws(' ', 'one two three', id, id % 7, 'four') AS text")
    items = spark.createDataFrame([(1, "one two three four"), (2, "5 6 two four"), (3, " ")], "item_id long, text string")
    assert {r.item_id for r in D.find_leaks(docs, items).collect()} >= {1}
    assert seen == [1200]
