"""Kept scores against full searches, over random edits of random graphs."""

import random

from pyspark.sql import functions as F

from emberline.operators import delta
from emberline.operators.reach import scores_from

EDGE = "src string, dst string, rel string, transitive boolean, seq int"


def graph(rng, groups=6, size=7, edges=14):
    """Separate groups of nodes, so that a change meets some starts and not others."""
    out = {}
    for g in range(groups):
        for _ in range(edges):
            a, b = rng.sample(range(size), 2)
            out[f"{g}.{a}", f"{g}.{b}", "r"] = (rng.random() < 0.7, rng.randrange(1000))
    return out, {f"{g}.{n}": rng.randrange(-1, 8) for g in range(groups) for n in range(size)}


def edit(rng, edges, heavy):
    """One or two changes of any kind inside one group."""
    g = rng.randrange(6)
    own = [e for e in edges if e[0].startswith(f"{g}.")]
    for _ in range(rng.randrange(1, 3)):
        what = rng.randrange(5)
        if what == 0 and own:
            edges.pop(rng.choice(own), None)
        elif what == 1:
            a, b = rng.sample(range(8), 2)  # 7 is a new node
            edges[f"{g}.{a}", f"{g}.{b}", "r"] = (rng.random() < 0.7, rng.randrange(1000))
        elif what == 2 and own:
            e = rng.choice(own)
            edges[e] = (not edges.get(e, (True, 0))[0], edges.get(e, (True, 5))[1])
        elif what == 3 and own:
            e = rng.choice(own)
            edges[e] = (edges.get(e, (True, 0))[0], rng.randrange(1000))
        else:
            heavy[f"{g}.{rng.randrange(8)}"] = rng.randrange(-1, 8)


def frames(spark, edges, heavy):
    rows = [(*e, *v) for e, v in edges.items()]
    ids = set(heavy) | {x for e in edges for x in e[:2]}
    nodes = spark.createDataFrame([(i, heavy.get(i, 0)) for i in sorted(ids)], "id string, severity int")
    return spark.createDataFrame(rows, EDGE), nodes, nodes.where("id like '%.0' or id like '%.1' or id like '%.7'").select(F.col("id").alias("start"))


def told(df):
    return {r.start: (r.score, r.max_severity, r.rating) for r in df.collect()}


def test_updates_equal_full_searches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delta, "MOST", 3)  # so that pairs are written into one on the way
    rng = random.Random(11)
    edges, heavy = graph(rng)
    state, steps = delta.State(spark, str(tmp_path / "kept")), []
    for generation in range(5):
        e, n, s = frames(spark, edges, heavy)
        steps.append(state.update(e, n, s, 2 * generation))
        assert told(state.scores()) == told(scores_from(e, n, s))
        edit(rng, edges, heavy)
    assert steps[0].searched == steps[0].starts and sum(x.searched for x in steps[1:]) < 0.5 * sum(x.starts for x in steps[1:])
    assert len(state.kept.every()) <= 5


def test_an_update_that_is_run_again_replaces_itself(spark, tmp_path):
    rng = random.Random(3)
    edges, heavy = graph(rng)
    state = delta.State(spark, str(tmp_path / "kept"))
    state.update(*frames(spark, edges, heavy), 1)
    edges["0.0", "5.5", "r"] = (True, 1)
    e, n, s = frames(spark, edges, heavy)
    first = state.update(e, n, s, 2)
    assert state.update(e, n, s, 2) == first and 0 < first.searched < first.starts
    assert told(state.scores()) == told(scores_from(e, n, s))
    none = state.update(e, n, s, 3)
    assert (none.searched, none.rescored) == (0, 0)
    gone = state.update(e.limit(0), n, s.limit(0), 4)
    assert gone.starts == 0 and state.scores().count() == 0
