"""Scores that are kept between graphs: after a change only starts that meet a changed edge are searched again.

A search of a start sees nothing but the edges of the nodes it goes on from, in their order. So it gives the
same as before unless an edge of such a node was added, removed, changed in transitivity or moved in order. The
state keeps, as Parquet by generation, each start's reached nodes in buckets by node: an index that leads from a
changed edge's source to the starts that went on from it. Of starts that are not searched again, only those that
reach a node whose severity changed are summed anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import Generations, Scratch, cut_lineage
from .reach import Search, scored

#: Buckets of the index by node, and parts of each by start, so that a node which all starts reach is not written by one task.
BUCKETS, PARTS = 64, 8
#: Generations that hold pairs before all valid pairs are written into one.
MOST = 16


@dataclass(frozen=True)
class Step:
    """What an update did: the starts there are, those searched again, and those only summed anew."""

    generation: int
    starts: int
    searched: int
    rescored: int


def bucket(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int")


def settled(edges: DataFrame) -> DataFrame:
    """What a search sees of edges: src, dst, transitive, and a hash of the place among the source's edges."""
    first = edges.where("src <> dst").groupBy("src", "dst").agg(F.min_by("transitive", "seq").alias("transitive"), F.min("seq").alias("seq"))
    return first.select("src", "dst", "transitive", F.xxhash64("seq").alias("place"))


def weights(nodes: DataFrame) -> DataFrame:
    return nodes.where("severity > 0").groupBy("id").agg(F.max("severity").cast("int").alias("severity"))


def differing(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys of rows that only one of two tables of distinct rows has."""
    return one.unionByName(other).groupBy(*one.columns).count().where("count = 1").select(key).distinct()


class State:
    """Scores of starts under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.kept = spark, Generations(spark, root, "owners")

    def table(self, generation: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self.kept.path(generation, name))

    def scores(self, generation: int | None = None) -> DataFrame:
        """start, score, max_severity, rating of a generation, by default the last that is whole."""
        return self.table(self.kept.last() if generation is None else generation, "owners").drop("since")

    def pairs(self, owners: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
        """start, node, passes of owners; with nodes (id) only pairs of those, from their buckets alone."""
        used = sorted(r[0] for r in owners.select("since").distinct().collect())  # MOST at most
        paths = [p for g in used if self.kept.exists(p := self.kept.path(g, "pairs"))]
        if not paths:
            return self.spark.createDataFrame([], "start string, node string, passes boolean")
        read = self.spark.read.schema("start string, node string, passes boolean, since long, bucket int")
        rows = reduce(DataFrame.unionByName, [read.parquet(p) for p in paths])
        if nodes is not None:
            held = [r[0] for r in nodes.select(bucket("id").alias("b")).distinct().collect()]  # BUCKETS at most
            rows = rows.where(F.col("bucket").isin(held)).join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
        return rows.join(owners.select("start", "since"), ["start", "since"], "left_semi").select("start", "node", "passes")

    def write(self, generation: int, name: str, df: DataFrame, *by: str) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(self.kept.path(generation, name))

    def update(self, edges: DataFrame, nodes: DataFrame, starts: DataFrame, generation: int) -> Step:
        """Brings the scores of starts (column start) to a graph, as a generation above all before.

        An update that is run again, after a failure or for the same generation, starts from the generation before and replaces
        what it wrote. Null and repeated starts count as in a search. Generations that no later one needs are removed.
        """
        before = self.kept.last(generation)
        now, heavy = cut_lineage(settled(edges)), cut_lineage(weights(nodes))
        current = cut_lineage(starts.where("start is not null").select("start").distinct())
        none = current.limit(0)
        if before is None:
            owners, known = None, none
            again, anew = current, none
        else:
            self.kept.drop_below(before, "edges", "weights")
            owners = self.table(before, "owners").join(current, "start", "left_semi")
            since = [r[0] for r in owners.select("since").distinct().collect()]
            if not any(g < before for g in since):
                self.kept.drop_below(before, "pairs", "owners")
            sources = cut_lineage(differing(now, self.table(before, "edges"), "src").withColumnRenamed("src", "id"))
            went_on = self.pairs(owners, sources).where("passes").select("start").unionByName(sources.select(F.col("id").alias("start")))
            again = current.join(went_on, "start", "left_semi").unionByName(current.join(owners, "start", "left_anti")).distinct()
            again = cut_lineage(again)
            heavier = differing(heavy, self.table(before, "weights"), "id")
            known = owners.join(again, "start", "left_anti")
            anew = cut_lineage(self.pairs(known, heavier).select("start").distinct())
        whole = before is not None and len({*since, generation}) > MOST
        with Scratch(self.spark) as scratch:
            search = Search(edges, again, scratch, nodes)
            pairs = search.named(search.pairs("start", "node", "parent", "code", "mark")).select("start", "node", "transitive").withColumnRenamed("transitive", "passes")
            scores = [search.scores().withColumn("since", F.lit(generation).cast("long"))]
            if owners is not None:
                of_anew = owners.join(anew, "start", "left_semi")
                sums = self.pairs(of_anew).join(heavy.withColumnRenamed("id", "node"), "node").groupBy("start").agg(F.sum("severity").alias("score"), F.max("severity").alias("max_severity"))
                rescored = scored(anew.join(sums, "start", "left")).join(of_anew.select("start", "since"), "start")
                same = known.join(anew, "start", "left_anti")
                if whole:
                    pairs = pairs.unionByName(self.pairs(known))
                scores += [rescored, same]
            names = ["start", "score", "max_severity", "rating", "since"]
            out = scores[0].select(*names)
            for one in scores[1:]:
                out = out.unionByName(one.select(*names))
            out = out.withColumn("since", F.lit(generation).cast("long")) if whole else out
            placed = pairs.withColumn("since", F.lit(generation).cast("long")).withColumn("bucket", bucket("node"))
            self.write(generation, "edges", now)
            self.write(generation, "weights", heavy)
            self.write(generation, "pairs", placed.repartition("bucket", F.pmod(F.xxhash64("start"), F.lit(PARTS))).sortWithinPartitions("bucket", "node"), "bucket")
            self.write(generation, "owners", out)  # last: its success mark makes the generation whole
        return Step(generation, current.count(), again.count(), anew.count())
