"""Incremental versions of the nightly jobs on Structured Streaming."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.operators.alerts import is_price_drop
from bandwise.operators.enrich import ask_view
from bandwise.operators.normalizing import normalize_records
from bandwise.operators.skew import latest_per_key, time_chunk, with_previous
from bandwise.schemas import HISTORY_TYPE, NATURAL_KEY
from bandwise.session import run_folder  # noqa: F401
from bandwise.sources.parsing import parse_pages, routed

STATE_SCHEMA = "listing_key bigint, scrape_ts timestamp, event_id bigint, price decimal(10,2)"


def table_stream(spark: SparkSession, folder: str, name: str, max_files: int = 1000) -> DataFrame:
    """A parquet table as a stream; `max_files` bounds a micro-batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )


class PriceTracker:
    """Last price per listing as state, price drops and late rows as outputs.

    Every micro-batch joins the state of the batches before it and writes the keys it changed, so
    writes grow with the batch and a retried batch overwrites its own output only. Within a batch the previous price comes from the
    chunked lag, so a hot listing is not one task's work. Rows not newer than the state are late:
    they are kept aside and never overwrite a newer price.
    """

    def __init__(self, spark: SparkSession, root: str, drop_pct: float = 5.0):
        self.spark, self.root, self.drop_pct = spark, root, drop_pct

    def _state(self, version: int) -> DataFrame:
        """Last price per listing after that batch: the newest of the rows written until then."""
        if self._last_version() < 0:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        rows = self.spark.read.schema(f"{STATE_SCHEMA}, v bigint").parquet(f"{self.root}/state")
        return latest_per_key(
            rows.where(F.col("v") <= version).drop("v"), ["listing_key"], ["scrape_ts", "event_id"]
        )

    def process(self, batch: DataFrame, batch_id: int) -> None:
        columns = ["listing_key", "scrape_ts", "event_id", "price"]
        state = self._state(batch_id - 1)
        known = state.select(
            "listing_key", F.struct("scrape_ts", "event_id").alias("seen"),
            F.col("price").alias("state_price"),
        )
        rows = batch.where((F.col("status_code") == 200) & F.col("price").isNotNull())
        rows = rows.select(*columns).join(known, "listing_key", "left")
        late = F.coalesce(F.struct("scrape_ts", "event_id") <= F.col("seen"), F.lit(False))
        rows.where(late).select(*columns).write.mode("overwrite").parquet(
            f"{self.root}/late/batch={batch_id}")
        fresh = rows.where(~late)
        previous = with_previous(
            fresh, ["listing_key"], time_chunk("scrape_ts"), ["scrape_ts", "event_id"], ["price"])
        old = F.coalesce("prev.price", "state_price")
        previous.where(is_price_drop(old, F.col("price"), self.drop_pct)).select(
            "listing_key", "event_id", "scrape_ts", old.alias("old_price"),
            F.col("price").alias("new_price"),
        ).write.mode("overwrite").parquet(f"{self.root}/drops/batch={batch_id}")
        latest_per_key(
            fresh.select(*columns), ["listing_key"], ["scrape_ts", "event_id"]
        ).select(*columns).write.mode("overwrite").parquet(f"{self.root}/state/v={batch_id}")

    def run(self, stream: DataFrame) -> int:
        """Drain what is there; returns the last batch id."""
        running = (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.root}/progress")
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()
        return self._last_version()

    def _last_version(self) -> int:
        """The newest version written; a drain without new rows writes none."""
        try:
            written = self.spark.read.parquet(f"{self.root}/state").select(F.max("v")).first()[0]
        except AnalysisException:
            return -1
        return -1 if written is None else int(written)

    def prices(self, version: int) -> DataFrame:
        return self._state(version)

    def drops(self) -> DataFrame:
        return self.spark.read.schema(
            "listing_key bigint, event_id bigint, scrape_ts timestamp, "
            "old_price decimal(10,2), new_price decimal(10,2)"
        ).parquet(f"{self.root}/drops/*")

    def late(self) -> DataFrame:
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.root}/late/*")


class PageIngest:
    """Raw pages to listing and comp tables as they arrive: parse, route, normalize, merge.

    Each micro-batch parses its pages once and writes their normalized records; a retried batch
    overwrites its own folder, and writes grow with the batch alone. The tables are one aggregate
    with map-side combine over the records, ordered by fetch time and not by arrival, so late pages
    never overwrite newer ones and any split into micro-batches gives the same tables. Pages that
    answered 404 are not parsed: they mark a known listing removed until it is seen again. Of
    listings fetched at the same moment, the one with the greater hash is the later; a 404 of that
    moment comes after them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def process(self, batch: DataFrame, batch_id: int) -> None:
        started = time.monotonic()
        gone = F.col("status_code") == 404
        records = normalize_records(routed(parse_pages(batch.where(~gone))))
        removed = batch.where(gone).select(
            "source", F.col("url").alias("source_url"), F.col("fetched_at").cast("timestamp").alias("scrape_ts"),
            F.lit("removed").alias("route"))
        records.unionByName(removed, allowMissingColumns=True).write.mode("overwrite").parquet(
            f"{self.root}/records/batch={batch_id}")
        batch.groupBy("source").agg(
            F.count("*").alias("pages_fetched"), F.count_if(gone).alias("pages_gone")
        ).withColumn("duration_s", F.lit(round(time.monotonic() - started, 2))).write.mode("overwrite").parquet(
            f"{self.root}/runs/batch={batch_id}")

    def run(self, stream: DataFrame) -> None:
        """Drain what is there."""
        running = (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.root}/progress")
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()

    def _records(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/records")
        for key in NATURAL_KEY:
            rows = rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
        return rows

    def runs(self) -> DataFrame:
        """One row per source and micro-batch: pages, records, how many were new to their table, errors, duration.

        Failed fetches, pages without a record and records without a key are extraction errors.
        """
        comp = (F.col("route") == "comp").alias("comp")
        kept = self._records().where(F.col("route") != "removed").select(*NATURAL_KEY, comp, "batch")
        found = kept.groupBy("source", "batch").agg(F.count("*").alias("records_extracted"))
        new = kept.groupBy(*NATURAL_KEY, "comp").agg(F.min("batch").alias("batch")).groupBy("source", "batch").agg(
            F.count("*").alias("records_inserted"))
        told = (self.spark.read.parquet(f"{self.root}/runs").join(found, ["source", "batch"], "left")
                .join(new, ["source", "batch"], "left").na.fill(0, ["records_extracted", "records_inserted"]))
        return told.select(
            "source", "batch", "pages_fetched", "records_extracted", "records_inserted",
            (F.col("records_extracted") - F.col("records_inserted")).alias("records_updated"),
            (F.col("pages_fetched") - F.col("pages_gone") - F.col("records_extracted")).alias("extraction_errors"),
            F.lit(0).cast("long").alias("normalization_errors"), "duration_s")

    def price_changes(self) -> DataFrame:
        """One row per changed ask of a listing: the new price with its time, the price before it and when the
        listing had last been touched, by a page or by its removal. A listing's first price and missing prices change
        nothing, but a price that follows a missing one does."""
        keys, day = list(NATURAL_KEY), time_chunk("scrape_ts", 86_400)
        rows = self._records()
        values = [c for c in rows.columns if c not in (*keys, "route", "batch")]
        asks = rows.where(F.col("route") == "listing").select(
            *keys, "scrape_ts", "asking_price", F.xxhash64(*values).alias("tie"))
        old = with_previous(asks, keys, day, ["scrape_ts", "tie"], ["asking_price", "scrape_ts"], name="old")
        changed = old.where(
            F.col("old").isNotNull() & (F.col("asking_price") != 0)
            & ~F.col("asking_price").eqNullSafe(F.col("old.asking_price")))
        gone = rows.where(F.col("route") == "removed").select(*keys, "scrape_ts", F.lit(True).alias("gone"))
        both = changed.withColumn("gone", F.lit(False)).unionByName(gone, allowMissingColumns=True)
        touched = with_previous(both, keys, day, ["scrape_ts", "gone", "tie"], ["scrape_ts"], name="last")
        return touched.where(~F.col("gone")).select(
            *keys, "scrape_ts", "tie", F.nullif(F.col("old.asking_price"), F.lit(0)).alias("old_price"),
            F.greatest("old.scrape_ts", "last.scrape_ts").alias("old_ts"), F.col("asking_price").alias("new_price"))

    def listings(self) -> DataFrame:
        """One row per listing: its newest record, the times it was first seen and last touched, its status and the
        history of its own asks (null before the first change), as repeated upserts in the order of the fetches leave
        it."""
        rows, keys = self._records().drop("batch"), list(NATURAL_KEY)
        values = [c for c in rows.columns if c not in (*keys, "route")]
        seen, at = F.col("route") == "listing", F.struct("scrape_ts", F.xxhash64(*values))
        found = rows.where(F.col("route") != "comp").groupBy(*keys).agg(
            F.max_by(F.when(seen, F.struct(*values)), F.when(seen, at)).alias("row"),
            F.min(F.when(seen, F.col("scrape_ts"))).alias("created_at"),
            F.max(F.when(~seen, F.col("scrape_ts"))).alias("gone_at"))
        status = F.when(F.col("gone_at") >= F.col("row.scrape_ts"), "removed").otherwise("active")
        entry = F.struct(F.col("old_price").cast("double").alias("price"), F.col("old_ts").cast("string").alias("ts"))
        noted = self.price_changes().groupBy(*keys).agg(F.array_sort(
            F.collect_list(F.struct("scrape_ts", "tie", entry.alias("entry")))).alias("changes"))
        history = F.transform("changes", lambda c: c["entry"]).cast(HISTORY_TYPE)
        return found.where(F.col("row").isNotNull()).join(noted, keys, "left").select(
            *keys, "row.*", "created_at", F.greatest("row.scrape_ts", "gone_at").alias("updated_at"),
            status.alias("listing_status"), history.alias("price_history"))

    def comps(self) -> DataFrame:
        """One row per sale: its first record, with the newest confidence that is not zero."""
        rows, keys = self._records().drop("batch"), list(NATURAL_KEY)
        values = [c for c in rows.columns if c not in (*keys, "route", "normalization_confidence")]
        score = F.nullif(F.col("normalization_confidence"), F.lit(0))
        at = F.struct("scrape_ts", F.xxhash64(*values))
        found = rows.where(F.col("route") == "comp").groupBy(*keys).agg(
            F.min_by(F.struct(*values), at).alias("row"),
            F.max_by(score, F.when(score.isNotNull(), at)).alias("confidence_score"))
        return found.select(*keys, "row.*", "confidence_score")


def drain_to_table(stream: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Run an append stream into a parquet folder and read the result."""
    schema = stream.schema
    running = (
        stream.writeStream.format("parquet").outputMode("append")
        .partitionBy(*partition_by)
        .option("path", f"{root}/data").option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{root}/data")


def unique_alerts(alerts: DataFrame, keys: list[str], time: str, horizon: str) -> DataFrame:
    """First alert per key within the watermark horizon."""
    return alerts.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def daily_metrics(log: DataFrame, time: str, lateness: str = "2 days") -> DataFrame:
    """Observations and errors per day."""
    return log.withWatermark(time, lateness).groupBy(F.window(time, "1 day")).agg(
        F.count("*").alias("pages"), F.count_if(F.col("status_code") != 200).alias("errors")
    )


def drain_daily(metrics: DataFrame, root: str) -> DataFrame:
    """Keep the newest figures per day: each micro-batch writes its updates, the reader takes the
    last of a day."""
    spark = metrics.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("window.start").alias("day"), "pages", "errors").withColumn(
            "batch", F.lit(batch_id)
        ).write.mode("overwrite").parquet(f"{root}/data/b={batch_id}")

    running = (
        metrics.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    updates = spark.read.schema("day timestamp, pages bigint, errors bigint, batch bigint").parquet(
        f"{root}/data/*")
    return latest_per_key(updates, ["day"], ["batch"]).drop("batch")


def priced_stream(listings: DataFrame, bands: DataFrame) -> DataFrame:
    """Streaming asks against the current static bands."""
    return ask_view(listings, bands)
