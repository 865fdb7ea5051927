"""Last price per listing in the engine's keyed state store, with expiry by timer."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SEEN = "listing_key bigint, scrape_ts timestamp, event_id bigint, price decimal(10,2)"
LAST = "scrape_ts timestamp, event_id bigint, price decimal(10,2)"
CHANGES = ("listing_key bigint, event_id bigint, scrape_ts timestamp, old_price decimal(10,2), "
           "new_price decimal(10,2), expired boolean")
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_per_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The newest row of each listing in a batch of rows: what a task sends on to the listing's state."""
    for rows in batches:
        yield rows.sort_values(["scrape_ts", "event_id"]).groupby("listing_key", sort=False).tail(1)


class LastPrice(StatefulProcessor):
    """One value per listing: its newest priced sighting. A newer one with another price is a change; an older one
    is late and leaves the value. A listing not seen for `keep` of event time is forgotten by its timer."""

    def __init__(self, keep: dt.timedelta):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max((r for part in rows for r in part[["scrape_ts", "event_id", "price"]].itertuples(index=False, name=None)),
                     key=lambda r: r[:2])
        old = self.last.get() if self.last.exists() else None
        seen = (pd.Timestamp(newest[0]).to_pydatetime(), int(newest[1]))
        if old is not None and (pd.Timestamp(old[0]).to_pydatetime(), old[1]) >= seen:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((pd.Timestamp(newest[0], tz="UTC") + self.keep).timestamp() * 1000))
        self.last.update((*seen, newest[2]))
        if old is None or old[2] != newest[2]:
            yield _change(key[0], seen[1], newest[0], None if old is None else old[2], newest[2], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.last.get()
        self.last.clear()
        yield _change(key[0], old[1], pd.Timestamp(old[0]), old[2], None, True)

    def close(self) -> None:
        pass


def _change(key, event_id, at, old, new, expired) -> pd.DataFrame:
    return pd.DataFrame({"listing_key": [key], "event_id": [event_id], "scrape_ts": [at], "old_price": [old],
                         "new_price": [new], "expired": [expired]})


@contextmanager
def _state_store(spark: SparkSession):
    """The store that keeps keyed state on disk, for the streams that start within."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


class KeyedPrices:
    """Last prices as keyed state. A task reduces its rows to the newest per listing before they are sent, so a hot
    listing arrives as a row per batch of a task, and reads and writes of the state grow with the listings of a
    micro-batch, not with history. Rows later than `lateness` behind the newest may be dropped."""

    def __init__(self, spark: SparkSession, root: str, keep: dt.timedelta = dt.timedelta(days=365), lateness: str = "60 days"):
        self.spark, self.root, self.keep, self.lateness = spark, root, keep, lateness

    def changes(self, log: DataFrame) -> DataFrame:
        """The changes of the last price from one micro-batch to the next, and listings forgotten."""
        priced = log.where((F.col("status_code") == 200) & F.col("price").isNotNull() & F.col("listing_key").isNotNull())
        newest = priced.select("listing_key", "scrape_ts", "event_id", "price").mapInPandas(newest_per_key, SEEN)
        return newest.withWatermark("scrape_ts", self.lateness).groupBy("listing_key").transformWithStateInPandas(
            LastPrice(self.keep), CHANGES, outputMode="Append", timeMode="EventTime")

    def run(self, log: DataFrame) -> None:
        """Drain what is there."""
        with _state_store(self.spark):
            running = (
                self.changes(log).writeStream.format("parquet").option("path", f"{self.root}/changes")
                .option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()
            )
            running.awaitTermination()

    def prices(self) -> DataFrame:
        """The state as a table: one row per listing."""
        with _state_store(self.spark):
            state = self.spark.read.format("statestore").option("stateVarName", "last").load(f"{self.root}/progress")
        return state.select(F.col("key.listing_key").alias("listing_key"), "value.event_id", "value.scrape_ts", "value.price")

    def changed(self) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(f"{self.root}/changes")
