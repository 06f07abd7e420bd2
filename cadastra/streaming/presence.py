"""Presence as a stream: a listing's changes of status and the end of its grace, in order of event time.

A key's events wait in its state until the watermark has passed them, so files may come in any order within the allowed
lateness; then they are taken in order of time and id. The grace after `missing` is a timer of event time. State and
timers live in the RocksDB store, so a restarted query goes on where it was. The stream's rows equal those of `history`,
the batch form; what comes later than the watermark is left to the batch recompute, which knows no lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadastra.operators.history import transitions

ROW = "listing string, at timestamp, event string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class Presence(StatefulProcessor):
    """listing's events (at, event_id, type: missing or reactivated) to its changes, and `off_market` after the grace."""

    def __init__(self, grace_hours: int):
        self.grace = grace_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, event_id string", "type string")
        self.now = handle.getValueState("now", "status string, since long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, event_id, kind in zip(part["at_ms"], part["event_id"], part["type"]):
                self.waiting.updateValue((int(at), str(event_id)), (kind,))
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Takes all that the watermark has passed, whichever timer called."""
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if k[0] <= passed)
        before = (status, since, told) = tuple(self.now.get()) if self.now.exists() else (None, 0, True)
        out: list[tuple[int, str]] = []
        for at, event_id, kind in due:
            if status == "missing" and not told and since + self.grace < at:
                out.append((since + self.grace, "off_market"))
                told = True
            if kind != status:
                out.append((at, kind))
                status, since, told = kind, at, kind != "missing"
            self.waiting.removeKey((at, event_id))
        if status == "missing" and not told:
            end = since + self.grace
            if end < passed:
                out.append((end, "off_market"))
                told = True
            else:
                self.handle.registerTimer(end + 1)
        if (status, since, told) != before:
            self.now.update((status, since, told))
        if out:
            yield pd.DataFrame({"listing": [key[0]] * len(out), "at": pd.to_datetime([a for a, _ in out], unit="ms"), "event": [e for _, e in out]})

    def close(self) -> None:
        pass


def stream(events: DataFrame, lateness: str, grace_hours: int = 24) -> DataFrame:
    """listing, at, event of a stream of events (listing, at, event_id, type); needs `use_rocksdb`."""
    used = events.filter(F.col("type").isin("missing", "reactivated") & F.col("at").isNotNull() & F.col("listing").isNotNull())
    timed = used.withWatermark("at", lateness).select("listing", "at", F.unix_millis("at").alias("at_ms"), F.col("event_id").cast("string").alias("event_id"), "type")
    return timed.groupBy("listing").transformWithStateInPandas(statefulProcessor=Presence(grace_hours), outputStructType=ROW, outputMode="Append", timeMode="EventTime")


def history(events: DataFrame, until, grace_hours: int = 24) -> DataFrame:
    """The same of a table: changes up to `until`, and where `missing` lasted longer than the grace by then."""
    until = F.lit(until).cast("timestamp")
    used = events.filter(F.col("type").isin("missing", "reactivated") & (F.col("at") <= until)).withColumn("event_id", F.col("event_id").cast("string"))
    changes = transitions(used, "listing", ["at", "event_id"], "type")
    next_ = F.lead("at").over(Window.partitionBy("listing").orderBy("at", "event_id"))
    marked = changes.withColumn("ends", F.col("at") + F.make_dt_interval(hours=F.lit(grace_hours))).withColumn("next", F.coalesce(next_, until))
    gone = marked.filter((F.col("type") == "missing") & (F.col("ends") < F.col("next")))
    return changes.select("listing", "at", F.col("type").alias("event")).unionByName(gone.select("listing", F.col("ends").alias("at"), F.lit("off_market").alias("event")))
