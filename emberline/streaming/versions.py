"""The newest version of each file of a stream, kept as state by file.

Files arrive late, twice and out of order, and are deleted. State holds the newest version that was seen; only rows
that replace it go on. A deleted file leaves a tombstone, so that a late older version does not bring it back; once
the watermark has passed the deletion, rows that old are dropped before they get here, and the tombstone goes too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "rel string, content string, version bigint, deleted boolean, at timestamp"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def newness(version: int | None, deleted: bool | None, content: str | None) -> tuple:
    """What orders versions of a file: the number, of equal ones a deletion, else the content that sorts last, nulls first."""
    return (version is not None, version or 0, bool(deleted), content is not None, content or "")


class Newest(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "version bigint, deleted boolean, content string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: newness(r.version, r.deleted, r.content))
        if self.held.exists() and newness(*self.held.get()) >= newness(best.version, best.deleted, best.content):
            return
        self.held.update((best.version, bool(best.deleted), best.content))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best.deleted and best.at is not None:
            self.handle.registerTimer(int(best.at.timestamp() * 1000) + 1)
        yield Row(rel=key[0], content=None if best.deleted else best.content, version=best.version, deleted=bool(best.deleted), at=best.at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_versions(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows of a stream (rel, content, version, deleted, at) that replace what was the newest of their file.

    at is the event time; rows that are older than the newest at by more than delay may be dropped. Rows without a name go, a null
    deleted is false, and null versions are older than any number. The session's state store has to be the one that keeps
    state of several variables (STORE); it is set here.
    """
    files.sparkSession.conf.set(*STORE)
    known = files.where("rel is not null").select("rel", "content", F.col("version").cast("long").alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "at")
    return known.withWatermark("at", delay).groupBy("rel").transformWithState(Newest(), OUTPUT, "Append", "EventTime")
