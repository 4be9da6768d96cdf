"""Texts and tables that would make a careless operator quadratic or unbounded."""

import time

from emberline.llm import license, quality, secrets
from emberline.llm.quality import CrfFit


def seconds(run):
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def spans_of(text):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["id", "text"])
    (out,) = secrets._scan(secrets.Novelty(), b"a dictionary of names")(iter([batch]))
    return out.column(1).to_pylist()[0]


def test_chained_assignments_are_read_once():
    assert [(s["kind"], s["start"], s["end"]) for s in spans_of("token=aaaaaa!token=bbbbbb! x")] == [("assign", 0, 12), ("novel", 6, 26), ("assign", 13, 25)]
    spans = []
    assert seconds(lambda: spans.extend(spans_of("token=aaaaaa!" * 100_000))) < 20
    assert sum(s["kind"] == "assign" for s in spans) == 100_000 and sum(s["kind"] == "novel" for s in spans) == 1


def test_long_licence_lines_take_linear_time(spark):
    def scan(words):
        text = "a licence of " + "some other words here " * (words // 4)
        df = spark.createDataFrame([(1, text), (2, "Licensed under the Apache License, Version 2.0.")], "doc_id long, text string")
        scored = license.licence_scan(df)
        return seconds(lambda: scored.collect())

    scan(10_000)
    assert scan(20_000) < 3 * scan(10_000) + 2


def test_one_labelled_id_on_many_rows_stays_in_bounds(spark):
    docs = spark.range(3000).selectExpr("7L as doc_id", "concat('a line of text ', id) as text").coalesce(2)
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    taken = []
    fit = quality.fit_crf
    try:
        quality.fit_crf = lambda features, first, y, p: taken.append(len(y)) or fit(features, first, y, p)
        quality.train_quality(docs, labels, params=CrfFit(train_rows=10, steps=2))
    finally:
        quality.fit_crf = fit
    assert taken == [10]
