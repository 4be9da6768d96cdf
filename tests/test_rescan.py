"""Streams of files: newer versions replace older ones, deleted files go, and only what arrives is parsed."""

import json
import random

import pytest

from emberline.plans.scan import build_graph, rank_agents
from emberline.sources.config_files import file_rows
from emberline.streaming import rescan, versions

RAW = "rel string, content string, version bigint, deleted boolean, at timestamp"


def one_agent(name, tool):
    return f"agents:\n  - {{name: {name}, tools: [{tool}]}}\n"


def test_a_newer_version_replaces_the_older(spark, tmp_path):
    arrive = tmp_path / "in"
    arrive.mkdir()

    def send(name, *rows):
        (arrive / name).write_text("\n".join(json.dumps(dict(zip(("rel", "content", "version", "deleted"), r, strict=False))) for r in rows))
        stream = spark.readStream.schema(rescan.FILE_SCHEMA + ", deleted boolean").json(str(arrive))
        rescan.start_rescan(stream, str(tmp_path / "a"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
        return {r.label: r.score for r in rescan.current_ranking(spark, str(tmp_path / "o")).collect()}

    one, two = one_agent("a", "bash"), one_agent("b", "http")
    assert send("1.json", ("x.yaml", one, 1), ("x.yaml", "agents: []", 0), ("y.yaml", two, 5)) == {"a": 7, "b": 3}
    assert send("2.json", ("x.yaml", one.replace("bash", "sql"), 2), ("y.yaml", one, 4)) == {"a": 6, "b": 3}
    rows = rescan.current_rows(spark, str(tmp_path / "a"))
    assert {r.rel for r in rows.collect()} == {"x.yaml", "y.yaml"} and rows.count() == 2
    assert send("3.json", ("y.yaml", None, 6, True)) == {"a": 6}
    steps = {r.generation: (r.starts, r.searched) for r in rescan.steps_of(spark, str(tmp_path / "o")).collect()}
    assert steps == {0: (2, 2), 1: (2, 1), 2: (1, 0)}


def test_equal_versions_go_by_content(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", None, 2), ("b", "z", 1)], rescan.FILE_SCHEMA)
    assert {(r.rel, r.content) for r in rescan.latest(df).collect()} == {("a", "y"), ("b", None)}


def test_an_archive_takes_in_its_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rescan, "MOST_BATCHES", 2)
    kept = rescan.Archive(spark, str(tmp_path))
    told, rng = {}, random.Random(4)
    for number in range(6):
        arrived = {f"f{rng.randrange(4)}.yaml": (rng.randrange(10), rng.random() < 0.2) for _ in range(2)}
        df = spark.createDataFrame([(rel, one_agent(f"v{v}", "bash"), v, gone) for rel, (v, gone) in arrived.items()], "rel string, content string, version long, deleted boolean")
        for rel, (v, gone) in arrived.items():
            if v >= told.get(rel, (-1, False))[0]:
                told[rel] = (v, gone)
        for _ in range(1 + number % 2):  # a batch that is run again replaces itself
            rows = kept.add(number, df, None)
        assert {(r.rel, r.registry.agents[0].name) for r in rows.collect()} == {(rel, f"v{v}") for rel, (v, gone) in told.items() if not gone}
    assert len(kept.batches.every()) <= 4


@pytest.mark.parametrize("seed", [1])
def test_late_repeated_and_deleted_files_give_the_ranking_of_the_final_folder(spark, tmp_path, seed):
    """Files come in a random order over several runs of the query; the ranking is that of the newest versions."""
    rng, arrive = random.Random(seed), tmp_path / "in"
    arrive.mkdir()
    rows = []
    for f in range(4):
        for v in range(1, 4):
            gone = v == 3 and f % 2 == 0
            rows.append({"rel": f"f{f}.yaml", "content": None if gone else one_agent(f"a{f}", ("bash", "sql", "http")[(f + v) % 3]), "version": v, "deleted": gone, "at": f"2024-01-01 00:{10 * v + f:02}:00"})
    final = [(r["rel"], r["content"]) for r in rows if r["version"] == 3 and not r["deleted"]]
    rows += rng.sample(rows, 4)
    rng.shuffle(rows)
    for k in range(2):
        (arrive / f"{k}.json").write_text("\n".join(map(json.dumps, rows[k::2])))
        stream = versions.newest_versions(spark.readStream.schema(RAW).json(str(arrive)))
        rescan.start_rescan(stream, str(tmp_path / "a"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    want = {(r["rank"], r.label, r.score) for r in rank_agents(build_graph(file_rows(spark.createDataFrame(final, "rel string, content string")))).collect()}
    assert {(r["rank"], r.label, r.score) for r in rescan.current_ranking(spark, str(tmp_path / "o")).collect()} == want and len(want) == 2


def test_only_rows_that_replace_go_on_and_tombstones_end(spark, tmp_path):
    arrive = tmp_path / "in"
    arrive.mkdir()
    got = []

    def send(name, *sent):
        (arrive / name).write_text("\n".join(json.dumps(dict(zip(("rel", "content", "version", "deleted", "at"), r, strict=True))) for r in sent))
        stream = versions.newest_versions(spark.readStream.schema(RAW).json(str(arrive)), "10 minutes")
        out = []
        query = stream.writeStream.foreachBatch(lambda df, n: out.extend((r.rel, r.version, r.deleted) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        got.append(sorted(out))
        return got[-1]

    assert send("1.json", ("a", "x", 2, False, "2024-01-01 00:00:00"), ("a", "w", 1, False, "2024-01-01 00:01:00"), ("b", "y", 1, None, "2024-01-01 00:02:00"), (None, "z", 1, False, "2024-01-01 00:02:00")) == [("a", 2, False), ("b", 1, False)]
    assert send("2.json", ("a", "x", 2, False, "2024-01-01 00:03:00"), ("b", None, 2, True, "2024-01-01 00:04:00")) == [("b", 2, True)]
    assert send("3.json", ("b", "late", 1, False, "2024-01-01 00:05:00"), ("c", "v", 1, False, "2024-01-01 02:00:00")) == [("c", 1, False)]
    assert send("4.json", ("b", "too late", 3, False, "2024-01-01 00:06:00"), ("b", "anew", 1, False, "2024-01-01 02:01:00")) == [("b", 1, False)]
