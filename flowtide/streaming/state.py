"""The latest row of each key of a polled feed, kept in the state store, with timers for keys that are seen no more.

A poll costs what it touches: the state of a key is read and written where it is kept, and no folder of earlier polls is listed or opened. The state
itself can be read as a table (latest()), as of any batch whose changes the store still keeps.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampType

from .jobs import WATCHED

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns that a poll's result has besides those of the feed.
SEEN = [StructField("first_seen_ts", TimestampType()), StructField("last_seen_ts", TimestampType())]
TOLD = [StructField("rows", LongType()), StructField("changed", BooleanType()), StructField("gone", BooleanType())]


def known(value) -> bool:
    return value is not None and not (isinstance(value, float) and math.isnan(value))


def same(a, b) -> bool:
    return a == b if known(a) and known(b) else known(a) == known(b)


def plain(value):
    """Rows of a batch have instants with a zone, the state has them as local times without one; here both are the latter."""
    return value.astimezone().replace(tzinfo=None) if isinstance(value, datetime.datetime) and value.tzinfo else value


def millis(at: datetime.datetime) -> int:
    return int(at.timestamp() * 1000)


class _Latest(StatefulProcessor):
    """One key: the best row of a poll against the row before it."""

    def __init__(self, columns: list[str], schema: StructType, best: list[str], order: str, ties: list[str], watched: list[str], expire_ms: int | None):
        self.columns, self.schema, self.best, self.order, self.ties, self.watched, self.expire_ms = columns, schema, best, order, ties, watched, expire_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.schema)

    def _better(self, a: dict, b: dict) -> bool:
        """Greatest by the columns of best, unknown values last, then the latest, then the least of the ties."""
        for name, up in [*((c, True) for c in [*self.best, self.order]), *((c, False) for c in self.ties)]:
            x, y = a[name], b[name]
            if same(x, y):
                continue
            if not known(x) or not known(y):
                return known(x) if up else not known(x)
            return (x > y) == up
        return False

    def _result(self, row: tuple, rows: int, changed: bool, gone: bool, before) -> Row:
        names = [f.name for f in [*self.schema.fields, *TOLD]]
        return Row(*names, f"previous_{self.watched[0]}")(*row, rows, changed, gone, before)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        top, n = None, 0
        for row in ({c: plain(r[c]) for c in self.columns} for r in rows):
            n += 1
            if top is None or self._better(row, top):
                top = row
        old = self.latest.get() if self.latest.exists() else None
        seen = top[self.order]
        before = dict(zip((f.name for f in self.schema.fields), map(plain, old))) if old else {}
        first = before.get("first_seen_ts") or seen
        last = max((x for x in (before.get("last_seen_ts"), seen) if x is not None), default=None)
        state = (*(top[c] for c in self.columns), first, last)
        changed = old is None or any(not same(before[c], top[c]) for c in self.watched)
        self.latest.update(state)
        if self.expire_ms is not None and last is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(millis(last) + self.expire_ms)
        yield self._result(state, n, changed, False, before.get(self.watched[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.latest.exists():
            old = tuple(self.latest.get())
            self.latest.clear()
            yield self._result(old, 0, False, True, old[self.columns.index(self.watched[0])])


@dataclass(frozen=True)
class StateStorePolls:
    """A poll job whose state is in the state store. Results go to folders by batch, each written once: what a poll showed of each key (with whether it
    changed, and from what), which is the snapshot, the change log and the ingest log in one."""

    root: str
    key: str
    best: tuple[str, ...]
    order: str = "snapshot_ts"
    ties: tuple[str, ...] = ()
    watched: tuple[str, ...] = tuple(WATCHED)
    #: A key not seen for so many seconds of event time leaves the state and is reported as gone.
    expire_s: int | None = None

    def polled(self, stream: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """A row for each key that a poll shows, and for each that expires. before: states of a store of another kind, to start from."""
        columns = stream.columns
        schema = StructType([*(StructField(f.name, f.dataType) for f in stream.schema.fields), *SEEN])
        out = StructType([*schema.fields, *TOLD, StructField(f"previous_{self.watched[0]}", stream.schema[self.watched[0]].dataType)])
        processor = _Latest(columns, schema, list(self.best), self.order, list(self.ties), list(self.watched), None if self.expire_s is None else self.expire_s * 1000)
        timed = stream if self.expire_s is None else stream.withWatermark(self.order, "0 seconds")
        return timed.groupBy(self.key).transformWithState(processor, out, "Update", "None" if self.expire_s is None else "EventTime")

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        spark = stream.sparkSession

        def save(df: DataFrame, batch: int) -> None:
            df.withColumn("run_ts", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.root}/polled/batch={batch}")

        before = spark.conf.get(PROVIDER)
        spark.conf.set(PROVIDER, ROCKSDB)  # the query takes its settings as it starts
        try:
            return self.polled(stream).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{self.root}/progress").trigger(**(trigger or {"availableNow": True})).start()
        finally:
            spark.conf.set(PROVIDER, before)

    def latest(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        """The state after a batch (default: the last one), read from the state store."""
        reader = spark.read.format("statestore").option("path", f"{self.root}/progress").option("stateVarName", "latest")
        if batch is not None:
            reader = reader.option("batchId", batch)
        return reader.load().select("value.*")

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/polled")

    def snapshots(self, spark: SparkSession) -> DataFrame:
        return self.history(spark).where("not gone")

    def changes(self, spark: SparkSession) -> DataFrame:
        return self.history(spark).where("changed").select(F.col(self.order).alias("changed_ts"), self.key, f"previous_{self.watched[0]}", *self.watched)

    def ingest_log(self, spark: SparkSession) -> DataFrame:
        """A row for each batch: rows fetched and keys that changed."""
        return self.history(spark).groupBy("batch").agg(F.min("run_ts").alias("run_ts"), F.sum("rows").alias("rows_fetched"), F.count_if("changed").alias("rows_changed"), F.lit(True).alias("ok"), F.lit("").alias("message"))
