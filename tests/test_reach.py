import random

from pyspark.sql import functions as F

from emberline.operators.link import mesh, resolve_refs
from emberline.operators.merge import ATTRS, first_edges, merge_nodes
from emberline.operators.reach import numbered, path_steps, rank, reach, score, scores_from, weighted

EDGE = "src string, dst string, rel string, file string, line int, transitive boolean, seq int"


def breadth_first(edges, start):
    """Discovery order, by the rule: a node counts by the edge that meets it first and passes on only if that edge does."""
    found, queue = {}, [start]
    for at in queue:
        for src, dst, rel, passes in edges:
            if src == at and dst != start and dst not in found:
                found[dst] = (src, rel)
                if passes:
                    queue.append(dst)
    return found


def test_random_graphs_match_plain_search(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for g in range(4):
        edges = [(f"{g}.{rng.randrange(9)}", f"{g}.{rng.randrange(9)}", f"r{rng.randrange(2)}", rng.random() < 0.7) for _ in range(22)]
        edges = list({e[:3]: e for e in edges if e[0] != e[1]}.values())
        rows += [(*e[:3], None, None, e[3], i) for i, e in enumerate(edges)]
        for s in range(9):
            want[f"{g}.{s}"] = breadth_first(edges, f"{g}.{s}")
    rng.shuffle(rows)
    starts = spark.createDataFrame([(s,) for s in want] + [(None,)], "start string")
    got = {}
    for r in sorted(reach(spark.createDataFrame(rows, EDGE), starts).collect(), key=lambda r: (r.level, r.place)):
        got.setdefault(r.start, {})[r.node] = (r.src, r.rel)
    for start, found in want.items():
        assert list(got.get(start, {}).items()) == list(found.items())


def test_scores_paths_and_ranking(spark):
    nodes = spark.createDataFrame(
        [("a", "agent", "Agent A", 0, 1), ("b", "agent", "Agent B", 0, 2), ("t", "tool", "shell tool", 0, 3), ("i", "identity", "svc", 0, 4), ("j", "identity", "db", 0, 5),
         ("n", "resource", "net", 2, 6), ("x", "resource", "Shell", 7, 7), ("h", "resource", "Root", 10, 8), ("s", "secret", "KEY", 5, 9), ("lone", "agent", "lone", 0, 10)],
        "id string, kind string, label string, severity int, seq int")
    edges = spark.createDataFrame(
        [("a", "t", "can call", "f.yml", 3, True, 1), ("t", "x", "shell", "f.yml", 4, True, 2), ("a", "i", "runs as", "f.yml", 5, True, 3), ("i", "n", "attached to", "c.yml", 1, True, 4),
         ("n", "j", "can reach", "c.yml", 2, False, 5), ("j", "h", "privileged", "c.yml", 3, True, 6), ("i", "s", "holds", "c.yml", None, True, 7), ("b", "s", "holds", None, None, True, 8), ("s", "b", "loop", None, None, True, 9)], EDGE)
    starts = nodes.where("kind = 'agent'").select(F.col("id").alias("start"))
    reached = reach(edges, starts, hops=True)
    scores = {r.start: (r.score, r.max_severity, r.rating) for r in score(reached, nodes, starts).collect()}
    assert scores == {"a": (14, 7, "high"), "b": (5, 5, "medium"), "lone": (0, 0, "low")}
    assert scores == {r.start: (r.score, r.max_severity, r.rating) for r in scores_from(edges, nodes, starts).collect()}
    assert scores_from(edges.limit(0), nodes, starts).count() == 3
    assert {r.node for r in reached.where("start = 'a'").collect()} == {"t", "x", "i", "n", "j", "s", "b"}
    steps = path_steps(weighted(reached, nodes).where("start = 'a' and node = 'x'"), nodes).orderBy("step").collect()
    assert [(s["from"], s["to"], s["evidence"]) for s in steps] == [("Agent A", "shell tool", "f.yml:3"), ("shell tool", "Shell", "f.yml:4")]
    assert [(r["rank"], r.id) for r in rank(score(reached, nodes, starts), nodes).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, "lone")]
    assert path_steps(weighted(reached, nodes).where("start = 'a' and node = 's'"), nodes).orderBy("step").collect()[-1].evidence == "c.yml"
    assert reach(edges.limit(0), starts).count() == 0 and reach(edges, starts.limit(0)).count() == 0


def test_numbers_are_whole(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    rows = numbered(df, [F.desc("k"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 1001))
    assert [(r.k, r.id) for r in rows] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert numbered(df.limit(0), [F.asc("id")]).count() == 0


def test_merge_is_in_emission_order(spark):
    rows = [("n", "tool", "late", 3, None, None, "b", ["y", "x"], ["A"], None, 3), ("n", "agent", "first", 1, None, None, "a", ["x"], ["A"], None, 1),
            ("n", "tool", "mid", 2, "f", 9, None, None, None, True, 2), ("n", "tool", "end", 0, "g", 1, None, None, None, False, 4), (None, "tool", "no id", 0, None, None, None, None, None, None, 5)]
    df = spark.createDataFrame(rows, "id string, kind string, label string, severity int, file string, line int, source string, aliases array<string>, cap_add array<string>, inline_value_found boolean, seq int")
    got = merge_nodes(df.repartition(4), {k: ATTRS[k] for k in ("source", "aliases", "cap_add", "inline_value_found")}).collect()
    assert [tuple(r) for r in got] == [("n", "agent", "first", 3, "f", 9, "b", ["x", "y"], ["A", "A"], True, 1)]


def test_first_edge_keeps_its_evidence(spark):
    df = spark.createDataFrame([("a", "b", "r", "late", 2, True, 2), ("a", "b", "r", None, None, False, 1), ("a", "a", "r", "self", 1, True, 0), ("a", "b", "q", "x", 1, True, 3)], EDGE)
    got = {(r.rel, r.file, r.transitive, r.seq) for r in first_edges(df).collect()}
    assert got == {("r", None, False, 1), ("q", "x", True, 3)}


def test_mesh_is_linear_and_ordered(spark):
    df = spark.createDataFrame([("n", "a", 1, 10), ("n", "a", 2, 11), ("n", "b", 3, 12), ("n", "c", 4, 13), ("solo", "z", 1, 1)], "net string, member string, pos int, line int")
    got = mesh(df).collect()
    reach_order = [r.member for r in sorted((r for r in got if r.kind == "reach"), key=lambda r: (r["last"], r.pos))]
    assert reach_order == ["b", "c", "a"] and sum(r.kind == "attached" for r in got) == 4


def test_exact_id_wins_over_alias(spark):
    from emberline.operators.merge import SEQ

    seq = "named_struct('phase', 0, 'file_key', array(named_struct('is_dir', false, 'name', 'f')), 'doc', {}, 'step', array(0), 'sub', array())"
    nodes = spark.createDataFrame([("k8s:a", ["t"], 1), ("t", [], 2), ("u", ["w", "t"], 3), ("v", ["w"], 4)], "id string, aliases array<string>, n int").select("id", "aliases", F.expr(seq.format("n")).cast(SEQ).alias("seq"))
    refs = spark.createDataFrame([("a", "t", 1), ("a", "w", 2), ("a", "none", 3)], "src string, ref string, line int").select("src", "ref", F.lit("runs as").alias("rel"), F.lit("f").alias("file"), "line", F.expr(seq.format("line")).cast(SEQ).alias("seq"))
    edges, lost = resolve_refs(refs, nodes)
    assert [r.dst for r in edges.orderBy("seq").collect()] == ["t", "u", "v"]
    assert [r.ref for r in lost.collect()] == ["none"]
