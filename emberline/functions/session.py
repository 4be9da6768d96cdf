"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
from types import TracebackType
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


#: Shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests, the bench and the command line."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("emberline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named in spark.checkpoint.dir.

    A folder of our own is made only where the session names none and the master
    is local; on a cluster a folder of one machine would be of no use to the others.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="emberline-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared checkpoint folder, for the time of a with block.

    Unlike checkpoints they are compressed and read by column, and their sizes are
    known to the planner. They are gone after the block: what leaves it has to be
    cut off before (cut_lineage).
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.made, self.at = spark, 0, {}
        self.root = f"{ensure_checkpoint_dir(spark)}/emberline-{uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.remove(self.root)

    def remove(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def store(self, df: DataFrame, thin: bool = False, by: str | None = None) -> DataFrame:
        """df written and read back. thin: rows of a few numbers, for which a file for each core is enough. by: a column of few values, with a folder each.

        What the write shuffled goes with it: the table is read from now on, and nothing is made again from those files.
        """
        path, self.made = f"{self.root}/{self.made}", self.made + 1
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            out = (df.coalesce(self.spark.sparkContext.defaultParallelism) if thin else df).write
            (out.partitionBy(by) if by else out).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(stored)] = path
        return stored

    def drop(self, stored: DataFrame) -> None:
        """Removes a table that nothing reads any more."""
        self.remove(self.at.pop(id(stored)))


class Generations:
    """Numbered folders root/gen=N of tables; a generation is whole once its table named last has been written."""

    def __init__(self, spark: SparkSession, root: str, last: str) -> None:
        self.spark, self.root, self.mark = spark, root, last
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def path(self, generation: int, table: str) -> str:
        return f"{self.root}/gen={generation}/{table}"

    def exists(self, where: str) -> bool:
        return self.fs.exists(self._path(where))

    def every(self) -> list[int]:
        """Numbers of all generations, whole or not, ascending."""
        if not self.exists(self.root):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))]
        return sorted(int(n[4:]) for n in names if n.startswith("gen="))

    def last(self, below: int | None = None) -> int | None:
        """The last whole generation (below a number)."""
        return max((g for g in self.every() if (below is None or g < below) and self.exists(f"{self.path(g, self.mark)}/_SUCCESS")), default=None)

    def drop_below(self, generation: int, *tables: str) -> None:
        for g in self.every():
            if g < generation:
                for table in tables:
                    self.fs.delete(self._path(self.path(g, table)), True)
                if not self.fs.listStatus(self._path(f"{self.root}/gen={g}")):
                    self.fs.delete(self._path(f"{self.root}/gen={g}"), True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
