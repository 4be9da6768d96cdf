"""Importance resampling against a plain version, packed postings, joined checksums, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from emberline.functions.session import read_table
from emberline.llm import postings, resample

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % 10_000 for r in runs)


def plain_resample(docs, target):
    own = [(i, *plain_features(t)) for i, t in docs]
    s = sum((f for _, _, f in own), Counter())
    t = sum((plain_features(x)[1] for x in target), Counter())
    big_s, big_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * big_s / (float(s[b] + 1) * big_t))) for b in s}
    rows = []
    for i, n, f in own:
        weight = sum(gain[b] * c for b, c in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = 5 * len(fit) // 100
    out = [(i, f, w, x, k if k <= drawn else None) for k, (i, _, f, w, x) in enumerate(fit, 1)] + [(i, f, w, x, None) for i, n, f, w, x in rows if n < 20]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_equals_the_plain_version(spark):
    docs, target = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "benchmark")
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert rows_of(resample.resample(docs, target)) == want
    assert any(r[4] for r in want)


def test_any_number_of_places_gives_the_same_rows(spark):
    docs, target = read_table(spark, SF, "documents").repartition(7), read_table(spark, SF, "benchmark")
    want = rows_of(resample.resample(docs, target))
    one = resample.Resample(ranges=1)
    many = resample.Resample(ranges=31)
    assert rows_of(resample.resample(docs, target, params=one)) == want == rows_of(resample.resample(docs.coalesce(1), target, params=many))


def test_one_word_in_every_text(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the the "), F.col("id").cast("string")).alias("text")).repartition(8)
    target = spark.createDataFrame([("the end",)], "text string")
    assert rows_of(resample.resample(docs, target)) == plain_resample([(k, f"the the {k}") for k in range(4000)], ["the end"])


def test_odd_rows(spark):
    long = "alpha beta gamma delta " * 20_000
    word = "x" * 70_000
    texts = [(1, None), (2, ""), (3, "..."), (4, "one"), (4, "one"), (None, "no id here " * 9), (None, "no id here " * 9), (5, long), (6, "É漢字 naïve 😀ok ÀB " * 30), (7, f"{word} {word}b c"), (8, "A_b\x00C 9")]
    docs = spark.createDataFrame([(i, t, "clash", 3, 1) for i, t in texts], "doc_id long, text string, key string, weight int, part int")
    for target in (["one two", None, ""], []):
        other = spark.createDataFrame([(t,) for t in target], "text string")
        assert rows_of(resample.resample(docs, other)) == plain_resample(texts, target)
    assert resample.resample(docs.limit(0), docs.select("text")).count() == 0


def test_packed_postings_come_back():
    rng = np.random.default_rng(3)
    for top in (1, 254, 255, 256, 3000, 10**6):
        values = np.unique(rng.integers(0, top + 1, 500))
        assert (postings.unpack(postings.pack(values)) == values).all()
        counts = rng.integers(1, top + 2, 300)
        assert (postings.unpack_counts(*postings.pack_counts(counts), 300) == counts).all()
        assert (postings.widen(postings.narrow(counts), 300) == counts).all()
    assert postings.pack(np.zeros(0, np.int64)) == b"" and len(postings.unpack(b"")) == 0


def test_joined_checksums():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 1000, 5000):
        a, b = rng.integers(0, 256, 9, np.uint8).tobytes(), rng.integers(0, 256, n, np.uint8).tobytes()
        joined = resample.CRC.after(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b))
        assert joined == zlib.crc32(a + b)
