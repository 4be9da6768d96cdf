"""Sums and counts by fans give what every pair one by one gives, and take no row for each pair."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import reach as R

EDGE = "src string, dst string, rel string, file string, line int, transitive boolean, seq long"


def levels(edges, start):
    """node: (level, passes), by the rule that the first edge to meet a node counts."""
    found, queue = {}, [(start, 0)]
    for at, level in queue:
        for src, dst, passes in edges:
            if src == at and dst != start and dst not in found:
                found[dst] = (level + 1, passes)
                if passes:
                    queue.append((dst, level + 1))
    return found


def graphs(count, seed):
    rng = random.Random(seed)
    for g in range(count):
        size, many = rng.randrange(3, 12), rng.randrange(4, 34)
        share = rng.choice((0.2, 0.5, 0.8))
        edges = [(f"{g}.{rng.randrange(size)}", f"{g}.{rng.randrange(size)}", rng.random() < share) for _ in range(many)]
        edges += [(f"{g}.{rng.randrange(size)}", f"{g}.f{k}", rng.random() < 0.5) for k in range(5)] + [(f"{g}.f{rng.randrange(5)}", f"{g}.{rng.randrange(size)}", True) for k in range(2)]
        yield list({e[:2]: e for e in edges if e[0] != e[1]}.values()), [f"{g}.{k}" for k in range(size)] + [f"{g}.f{k}" for k in range(5)]


@pytest.fixture(scope="module")
def many(spark):
    rng, rows, nodes, want = random.Random(3), [], [], {}
    for edges, names in graphs(60, 11):
        weight = {n: rng.choice((0, 0, 3, 7, 9)) for n in names}
        nodes += [(n, weight[n]) for n in names]
        rows += [(s, d, "r", None, None, p, i) for i, (s, d, p) in enumerate(edges)]
        for start in names:
            want[start] = (levels(edges, start), weight)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, EDGE), spark.createDataFrame(nodes, "id string, severity int").withColumn("label", F.col("id")).withColumn("kind", F.lit("x")), want


def test_sums_match_plain_search(spark, many):
    edges, nodes, want = many
    starts = nodes.select(F.col("id").alias("start"))
    got = {r.start: (r.score, r.max_severity) for r in R.scores_from(edges, nodes, starts).collect()}
    assert got == {s: (sum(w[n] for n in f), max([0, *(w[n] for n in f)])) for s, (f, w) in want.items()}


def test_counts_match_plain_search(spark, many):
    edges, nodes, want = many
    got = {(r.start, r.level): tuple(r)[2:] for r in R.counts_from(edges, nodes.select(F.col("id").alias("start"))).collect()}
    plain = {}
    for start, (found, _) in want.items():
        for level in {x for x, _ in found.values()}:
            own = sorted(n for n, (x, _) in found.items() if x == level)
            plain[start, level] = (len(own), sum(not found[n][1] for n in own), own[0], own[-1])
    assert got == plain


@pytest.mark.parametrize("evidence", [True, False])
def test_pairs_match_plain_search(spark, many, evidence):
    edges, nodes, want = many
    starts = nodes.select(F.col("id").alias("start"))
    order = {}
    for r in sorted(R.reach(edges, starts, evidence=evidence).collect(), key=lambda r: (r.start, r.level, r.place)):
        order.setdefault(r.start, []).append((r.node, (r.level, r.transitive)))
    assert order == {s: list(f.items()) for s, (f, _) in want.items() if f}
    rows = {(r.start, r.node) for r in R.found(edges, nodes, starts, evidence=evidence).collect()}
    assert rows == {(s, n) for s, (f, w) in want.items() for n in f if w[n]}


def test_findings_by_kind_match_those_one_by_one(spark, many):
    """Labels repeat, so that level and order of discovery decide; some have none."""
    edges, nodes, want = many
    told = nodes.withColumns({"kind": F.when(F.crc32("id") % 3 == 0, "x").otherwise("y"), "label": F.when(F.crc32("id") % 5 > 0, (F.crc32("id") % 2).cast("string"))})
    starts = nodes.select(F.col("id").alias("start"))
    own = {r.id: r for r in told.collect()}
    plain = {}
    for start, (found, weight) in want.items():
        for place, node in enumerate(found):
            if weight[node]:
                key = (-weight[node], own[node].label or "", place)
                plain.setdefault((start, own[node].kind), []).append((*key, node))
    got = {(r.start, r.kind): (r.n_findings, r.weight, r.worst) for r in R.kinds_from(edges, told, starts).collect()}
    assert got == {k: (len(v), -sum(x[0] for x in v), min(v)[-1]) for k, v in plain.items()}


def test_a_hub_is_summed_and_not_spelled_out(spark, tmp_path):
    """500 starts by one hub of 400 nodes: before, levels held 200,000 pairs of them."""
    rows = [(f"a{i}", "hub", "r", None, None, True, 1) for i in range(500)] + [("hub", f"m{i}", "r", None, None, False, i) for i in range(400)] + [(f"m{i}", "hub", "r", None, None, True, 1) for i in range(400)]
    edges = spark.createDataFrame(rows, EDGE)
    nodes = spark.createDataFrame([(f"m{i}", 1) for i in range(400)], "id string, severity int")
    starts = spark.createDataFrame([(f"a{i}",) for i in range(500)] + [("m3",)], "start string")
    with R.Scratch(spark) as scratch:
        search = R.Search(edges, starts, scratch, nodes, evidence=False)
        assert search.core().count() == 501
        assert {(r.start == "m3", r.score) for r in search.scores().collect()} == {(False, 400), (True, 399)}
        assert {(r.start == "m3", r.level, r.n_reached, r.first_node) for r in search.counts().collect()} == {(False, 1, 1, "hub"), (True, 1, 1, "hub"), (False, 2, 400, "m0"), (True, 2, 399, "m0")}


def test_ids_whose_numbers_meet_get_others(spark):
    edges = spark.createDataFrame([("a", "b", "r", None, None, True, 1), ("b", "c", "r", None, None, True, 2)], EDGE)
    with R.Scratch(spark) as scratch:
        ids, by = R.numbers(edges, edges.select(F.col("src").alias("start")), None, scratch, lambda c: F.lit(7).cast("long") + F.length(c))
        assert ids.count() == 3 and ids.select("n").distinct().count() == 3
        assert ids.where(by(F.col("id")) != F.col("n")).count() == 0
