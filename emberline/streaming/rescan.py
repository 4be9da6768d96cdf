"""Continuous re-scan: config files that arrive as rows keep the ranking of a graph fresh.

A batch parses only the files that arrive, and the graph is linked anew from the newest typed rows of each file, because
links cross files. Only starts that meet a changed edge are searched again (operators.delta). Deleted files leave the graph.
Everything is written to paths of the batch, so a batch that is run again after a failure replaces
what it wrote, and readers of an earlier ranking are not disturbed. Now and then a batch writes all current rows, and
those before it go.
"""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.session import Generations, cut_lineage
from ..operators.delta import State
from ..operators.reach import rank
from ..plans.scan import graph_of
from ..sources.config_files import file_rows
from ..sources.documents import Labels, parse_files

FILE_SCHEMA = "rel string, content string, version bigint"
#: Batches in the archive before one of them takes in all current rows.
MOST_BATCHES = 32


def latest(files: DataFrame) -> DataFrame:
    """(rel, content, version, deleted): the newest version of each file; of equal versions a deletion, else the one whose content sorts last, nulls first."""
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in files.columns else F.lit(False)
    best = files.groupBy("rel").agg(F.max(F.struct("version", deleted.alias("deleted"), "content")).alias("best"))
    return best.select("rel", "best.content", "best.version", "best.deleted")


class Archive:
    """Typed rows and versions of files by batch, and the kept scores, under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.batches, self.scores = spark, Generations(spark, f"{root}/batches", "files"), State(spark, f"{root}/scores")

    def table(self, batch: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self.batches.path(batch, name)).withColumn("batch", F.lit(batch).cast("long"))

    def files(self, upto: int | None = None) -> DataFrame | None:
        """rel, version, deleted, batch: the newest of each file among whole batches; of equal versions the one that arrived last."""
        whole = [b for b in self.batches.every() if (upto is None or b < upto) and self.batches.exists(f"{self.batches.path(b, 'files')}/_SUCCESS")]
        if not whole:
            return None
        every = reduce(DataFrame.unionByName, [self.table(b, "files") for b in whole])
        return every.groupBy("rel").agg(F.max(F.struct("version", "batch", "deleted")).alias("m")).select("rel", "m.*")

    def rows(self, files: DataFrame) -> DataFrame:
        """Typed rows of files that are not deleted."""
        used = sorted(r[0] for r in files.select("batch").distinct().collect())  # as many as there are batches in the archive
        if not used:
            return parse_files(file_rows(self.spark.createDataFrame([], "rel string, content string")))
        rows = reduce(DataFrame.unionByName, [self.table(b, "rows") for b in used])
        return rows.join(files.where("not deleted").select("rel", "batch"), ["rel", "batch"], "left_semi").drop("batch")

    def add(self, number: int, arrived: DataFrame, labels: Labels | None) -> DataFrame:
        """Takes in a batch of arrived files (rel, content, version, deleted) and gives the typed rows of all files."""
        held = [b for b in self.batches.every() if b < number]
        if held and self.holds_all(held[-1]):
            self.batches.drop_below(held[-1], "rows", "files", "all")
            held = held[-1:]
        before = self.files(upto=number)
        typed = parse_files(file_rows(arrived.where("not deleted")), labels)
        told = arrived.select("rel", "version", "deleted")
        if before is not None and len(held) >= MOST_BATCHES:
            # Everything goes into this batch. The last one stays for a second run of this batch; a deleted file's tombstone stays for late versions.
            kept = cut_lineage(before.join(told.select("rel", F.col("version").alias("_v")), "rel", "left").where("_v is null or version > _v").drop("_v"))
            typed = typed.join(kept.select("rel"), "rel", "left_anti").unionByName(self.rows(kept))
            told = told.join(kept.select("rel"), "rel", "left_anti").unionByName(kept.select("rel", "version", "deleted"))
        cut_lineage(typed).write.mode("overwrite").parquet(self.batches.path(number, "rows"))
        if before is not None and len(held) >= MOST_BATCHES:
            self.spark.range(1).write.mode("overwrite").parquet(self.batches.path(number, "all"))
        told.write.mode("overwrite").parquet(self.batches.path(number, "files"))  # last: makes the batch whole
        return cut_lineage(self.rows(cut_lineage(self.files(upto=number + 1))))

    def holds_all(self, batch: int) -> bool:
        return self.batches.exists(f"{self.batches.path(batch, 'all')}/_SUCCESS")


def current_rows(spark: SparkSession, archive: str) -> DataFrame:
    """Typed rows of every file's newest version, without deleted files."""
    kept = Archive(spark, archive)
    return kept.rows(kept.files())


def current_ranking(spark: SparkSession, output: str) -> DataFrame:
    """The ranking of the last batch that was written whole."""
    kept = Generations(spark, f"{output}/ranking", "agents")
    return spark.read.parquet(kept.path(kept.last(), "agents"))


def steps_of(spark: SparkSession, output: str) -> DataFrame:
    """generation, starts, searched, rescored of every batch whose ranking is kept."""
    kept = Generations(spark, f"{output}/ranking", "agents")
    return reduce(DataFrame.unionByName, [spark.read.parquet(kept.path(g, "step")) for g in kept.every()])


def start_rescan(stream: DataFrame, archive: str, output: str, checkpoint: str, labels: Labels | None = None) -> StreamingQuery:
    """Start a query that takes arriving files into archive and ranks the agents anew under output.

    stream: rel, content, version, and deleted if files may go. It may be newest_versions() of a raw stream; without that the archive itself
    tells newer versions from older ones, and remembers deleted files for ever. Of one file's rows in a batch the newest counts.
    """

    def batch(files: DataFrame, number: int) -> None:
        spark, kept = files.sparkSession, Archive(files.sparkSession, archive)
        graph = graph_of(kept.add(number, cut_lineage(latest(files)), labels))
        agents = graph.nodes.where("kind = 'agent'").select(F.col("id").alias("start"))
        step = kept.scores.update(graph.edges, graph.nodes, agents, number)
        at = Generations(spark, f"{output}/ranking", "agents")
        spark.createDataFrame([asdict(step)], "generation long, starts long, searched long, rescored long").write.mode("overwrite").parquet(at.path(number, "step"))
        rank(kept.scores.scores(number), graph.nodes).write.mode("overwrite").parquet(at.path(number, "agents"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
