"""Search by index against a scan of all names."""

import random
import re

from pyspark.sql import functions as F

from emberline.operators import search


def test_hits_equal_a_scan(spark, tmp_path):
    rng = random.Random(2)
    names = [("".join(rng.choice("abAB é:") for _ in range(rng.randrange(1, 9))) + str(k), None if k % 7 == 0 else "".join(rng.choice("abcAC/é ") for _ in range(rng.randrange(0, 12)))) for k in range(200)]
    nodes = spark.createDataFrame([*names, (None, "no id"), names[3]], "id string, label string")
    search.write_index(nodes, str(tmp_path / "index"))
    index, kept = (spark.read.parquet(str(tmp_path / "index" / x)) for x in ("postings", "names"))
    for text in ["a", "AB", "abA", "é", "ab a", "aaaa", "cc/", "no id", "1", "", "zzz"]:
        low = text.lower()
        want = {i for i, label in names if low in i.lower() or low in (label or "").lower()}
        assert {r.id for r in search.hits(index, kept, text).collect()} == want, text
    plan = search.hits(index, kept, "abA")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*gram", plan)


def test_no_nodes(spark):
    none = spark.createDataFrame([], "id string, label string")
    assert search.hits(search.postings(none), none, "abc").count() == 0
    one = spark.createDataFrame([("ab", "")], "id string, label string")
    assert [r.gram for r in search.postings(one).orderBy(F.col("gram")).collect()] == ["a", "ab", "b"]
