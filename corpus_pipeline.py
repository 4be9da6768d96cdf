"""The corpus pipeline: five operators in a row, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.session import cut_lineage, read_table
from emberline.llm.decontaminate import drop_leaking
from emberline.llm.mixing import mixed_documents
from emberline.llm.neardup import keep_one
from emberline.llm.quality import keep_good
from emberline.llm.secrets import redact_secrets


#: Rows of a batch that goes to a Python worker: texts are long, and the session's default of 10,000 of them stands several times in memory.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches; a smaller setting stays. It holds on, since a stage's frame runs after the stage returns."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts."""
    small_batches(spark)
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, over shingles of five words: that with the least id."""
    small_batches(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    small_batches(spark)
    return drop_leaking(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars renewed."""
    small_batches(spark)
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a positive rate, and their domain, rate and copies in the mix."""
    small_batches(spark)
    return mixed_documents(docs, read_table(spark, sf_dir, "labels"))


STAGES = [("quality classifier", quality), ("near-dedup", dedup), ("decontamination", decontaminate), ("secret scan", secrets), ("mixing", mixing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage but the last is cut off in the shared checkpoint folder.

    Null, empty, very long and repeated rows fare as each stage's docstring says: a document without words is one
    empty line to the first stage, in no group of copies, holds no passage and no secret, and has no tokens to mix.
    An empty table gives no rows. Columns of other names pass through; those that mixing adds replace their namesakes.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
