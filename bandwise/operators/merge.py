"""Keyed merges without a merge-capable table format: read, join, write the next version."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.operators.skew import latest_per_key, time_chunk, with_previous
from bandwise.schemas import HISTORY_TYPE, NATURAL_KEY

KEPT_ON_UPDATE = ("created_at", "listing_status", "id", "price_history")


def one_per_key(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = NATURAL_KEY
) -> DataFrame:
    """The newest row of each natural key; rows without a full key are left out."""
    for key in keys:
        df = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return latest_per_key(df, keys, order)


def appended_history(old_history, old_price, old_time, new_price) -> Column:
    """History after a new price: a changed, present price pushes the old one onto it."""
    history = F.coalesce(old_history, F.array().cast(HISTORY_TYPE))
    changed = (new_price != 0) & ~new_price.eqNullSafe(old_price)
    entry = F.struct(
        F.nullif(old_price.cast("double"), F.lit(0.0)).alias("price"),
        old_time.cast("string").alias("ts"),
    )
    return F.when(
        F.coalesce(changed, F.lit(False)), F.concat(history, F.array(entry))
    ).otherwise(old_history)


def upsert_listings(
    stored: DataFrame,
    batch: DataFrame,
    now: dt.datetime,
    *,
    keep_existing_when_null: bool = False,
) -> DataFrame:
    """The listing table after a batch, with the action taken per row.

    Both sides hold one row per key. New keys are inserted; known ones take every column the
    batch provides, nulls included unless told otherwise, but keep their creation time, status,
    id and history, and a changed ask is noted in the history. One full outer join on the key;
    in a BucketedTable only the batch moves.
    """
    keys = list(NATURAL_KEY)
    new = batch.select(*keys, *[F.col(c).alias(f"new_{c}") for c in batch.columns if c not in keys],
                       F.lit(True).alias("in_batch"))
    old = stored.withColumn("in_store", F.lit(True))
    joined = old.join(new, keys, "full_outer")
    in_batch, in_store = F.col("in_batch").isNotNull(), F.col("in_store").isNotNull()

    columns = []
    for name in stored.columns:
        if name in keys:
            columns.append(F.col(name))
        elif name == "updated_at":
            columns.append(F.when(in_batch, F.lit(now)).otherwise(F.col(name)).alias(name))
        elif name == "price_history":
            columns.append(
                F.when(
                    in_batch & in_store,
                    appended_history(F.col(name), F.col("asking_price"), F.col("updated_at"),
                                     F.col("new_asking_price")),
                ).otherwise(F.col(name)).alias(name)
            )
        elif f"new_{name}" not in joined.columns:
            columns.append(F.col(name))
        elif name in KEPT_ON_UPDATE:
            columns.append(
                F.when(in_store, F.col(name)).otherwise(F.col(f"new_{name}")).alias(name)
            )
        else:
            fresh = F.col(f"new_{name}")
            if keep_existing_when_null:
                fresh = F.coalesce(fresh, F.col(name))
            columns.append(F.when(in_batch, fresh).otherwise(F.col(name)).alias(name))
    action = (
        F.when(in_batch & in_store, "updated").when(in_batch, "inserted").otherwise("untouched")
    )
    return joined.select(*columns, action.alias("action"))


def upsert_comps(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The comp table after a batch: comps are written once, a repeated key only refreshes the
    confidence when the batch has one."""
    keys = list(NATURAL_KEY)
    score = batch.select(
        *keys, F.nullif(F.col("confidence_score"), F.lit(0)).alias("new_score"),
        F.lit(True).alias("in_batch"),
    )
    kept = (
        stored.join(score, keys, "left")
        .withColumn("confidence_score", F.coalesce("new_score", "confidence_score"))
        .withColumn("action", F.when(F.col("in_batch"), "updated").otherwise("untouched"))
        .select(*stored.columns, "action")
    )
    fresh = batch.join(stored.select(*keys), keys, "left_anti").select(*stored.columns)
    return kept.unionByName(fresh.withColumn("action", F.lit("inserted")))


def mark_removed(stored: DataFrame, gone: DataFrame, now: dt.datetime) -> DataFrame:
    """Soft delete: keys that answered 404 get status removed; nothing is deleted."""
    keys = list(NATURAL_KEY)
    hit = gone.select(*keys).distinct().withColumn("gone", F.lit(True))
    return (
        stored.join(hit, keys, "left")
        .withColumn(
            "listing_status", F.when(F.col("gone"), "removed").otherwise(F.col("listing_status"))
        )
        .withColumn("updated_at", F.when(F.col("gone"), F.lit(now)).otherwise(F.col("updated_at")))
        .drop("gone")
    )


def run_metrics(outcomes: DataFrame, run_at: dt.datetime, finished_at: dt.datetime | None = None) -> DataFrame:
    """One run-log row per source from per-page outcomes (columns source, outcome); the duration is null while a run
    is not finished."""
    took = None if finished_at is None else round((finished_at - run_at).total_seconds(), 2)
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.groupBy("source").agg(
        F.count_if(F.col("outcome") != "fetch_error").alias("pages_fetched"),
        is_("inserted", "updated", "normalization_error").alias("records_extracted"),
        is_("inserted").alias("records_inserted"),
        is_("updated").alias("records_updated"),
        is_("fetch_error", "extraction_error").alias("extraction_errors"),
        is_("normalization_error").alias("normalization_errors"),
    ).withColumns({"run_at": F.lit(run_at), "duration_s": F.lit(took).cast("double")})


def promote_closed(listings: DataFrame, comps: DataFrame) -> DataFrame:
    """Closed listings with a final price and date that the comps do not hold yet."""
    closed = listings.where(
        (F.col("listing_status") == "sold") & F.col("final_price").isNotNull()
        & F.col("sale_date").isNotNull()
    )
    return closed.join(comps.select(*NATURAL_KEY), list(NATURAL_KEY), "left_anti")


def price_changes(log: DataFrame, key: str = "listing_key") -> DataFrame:
    """Price history from a snapshot log as one row per change (a history array per key would
    grow without bound): the first price of a key has no old one."""
    seen = log.where((F.col("status_code") == 200) & F.col("price").isNotNull())
    previous = with_previous(
        seen, [key], time_chunk("scrape_ts"), ["scrape_ts", "event_id"], ["price", "scrape_ts"]
    )
    return previous.where(
        F.col("prev").isNull() | (F.col("prev.price") != F.col("price"))
    ).select(
        key, "event_id", "scrape_ts", F.col("prev.price").alias("old_price"),
        F.col("prev.scrape_ts").alias("old_ts"), F.col("price").alias("new_price"),
    )


def relists(log: DataFrame, min_gap: dt.timedelta, key: str = "listing_key") -> DataFrame:
    """Sightings that follow a removal of the same key after more than `min_gap`."""
    previous = with_previous(
        log, [key], time_chunk("scrape_ts"), ["scrape_ts", "event_id"],
        ["scrape_ts", "status_code"],
    )
    gap = F.unix_micros("scrape_ts") - F.unix_micros("prev.scrape_ts")
    return previous.where(
        (F.col("status_code") == 200) & (F.col("prev.status_code") == 404)
        & (gap > int(min_gap.total_seconds() * 1_000_000))
    ).select(key, "event_id", "scrape_ts", F.col("prev.scrape_ts").alias("removed_ts"))


def mark_relisted(stored: DataFrame, found: DataFrame, key: str = "listing_key") -> DataFrame:
    """Removed listings that a relist event (from `relists`) shows again get status relist and
    the time of the newest such event; all others stay as they are."""
    again = found.groupBy(key).agg(F.max("scrape_ts").alias("relisted_at"))
    joined = stored.join(again, key, "left")
    back = (F.col("listing_status") == "removed") & (F.col("relisted_at") > F.col("updated_at"))
    return (
        joined.withColumns({
            "listing_status": F.when(back, "relist").otherwise(F.col("listing_status")),
            "updated_at": F.when(back, F.col("relisted_at")).otherwise(F.col("updated_at")),
        })
        .drop("relisted_at")
    )
