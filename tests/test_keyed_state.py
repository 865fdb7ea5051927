"""Last prices in keyed state: any split into micro-batches, late rows, timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bandwise.streaming.keyed_state import STATE_STORE, KeyedPrices

SCHEMA = "listing_key bigint, scrape_ts timestamp, event_id bigint, price decimal(10,2), status_code int"
GIVEN = SCHEMA.replace("decimal(10,2)", "int")
DAY = dt.datetime(2024, 1, 1)


def rows_of(rng, n):
    """Half of all rows belong to one listing; some are errors, some have no price or no key."""
    return [(rng.choice([1, rng.randrange(9), None]) if k % 2 else 1, DAY + dt.timedelta(minutes=rng.randrange(9_000)), k,
             rng.choice([None, 10, 20, 30]), rng.choice([200, 200, 404])) for k in range(n)]


def newest(rows):
    out = {}
    for key, at, event, price, status in rows:
        if key is not None and price is not None and status == 200:
            out[key] = max(out.get(key, (DAY, -1, None)), (at, event, price))
    return {k: (e, t, float(p)) for k, (t, e, p) in out.items()}


def drain(spark, root, parts, **options):
    keyed = KeyedPrices(spark, str(root), **options)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, GIVEN).withColumn("price", F.col("price").cast("decimal(10,2)")).coalesce(1).write.parquet(f"{root}/in/{k:02}")
    keyed.run(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*"))
    return keyed


@pytest.mark.parametrize("batches", [1, 3])
def test_any_split_gives_the_last_prices(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows = rows_of(rng, 600)
    rng.shuffle(rows)
    keyed = drain(spark, tmp_path, [rows[k::batches] for k in range(batches)])
    got = keyed.prices().collect()
    assert {r.listing_key: (r.event_id, r.scrape_ts, float(r.price)) for r in got} == newest(rows)
    assert len(got) == len({r.listing_key for r in got})
    assert spark.conf.get(STATE_STORE, None) is None or "RocksDB" not in spark.conf.get(STATE_STORE)


def test_changes_late_rows_and_a_restart(spark, tmp_path):
    at = [DAY + dt.timedelta(hours=h) for h in range(9)]
    keyed = drain(spark, tmp_path, [[(1, at[2], 1, 50, 200), (2, at[2], 2, 70, 200)], [(1, at[1], 3, 10, 200), (2, at[3], 4, 70, 200)]])
    seen = {(r.listing_key, r.old_price and float(r.old_price), float(r.new_price)) for r in keyed.changed().collect()}
    assert seen == {(1, None, 50.0), (2, None, 70.0)}  # the late row and the equal price change nothing
    spark.createDataFrame([(1, at[5], 9, 40, 200)], GIVEN).withColumn("price", F.col("price").cast("decimal(10,2)")).write.parquet(f"{tmp_path}/in/08")
    again = KeyedPrices(spark, str(tmp_path))
    again.run(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"))
    assert (1, 50.0, 40.0) in {(r.listing_key, r.old_price and float(r.old_price), float(r.new_price)) for r in again.changed().collect()}
    assert {r.listing_key: float(r.price) for r in again.prices().collect()} == {1: 40.0, 2: 70.0}


def test_a_listing_not_seen_for_long_is_forgotten(spark, tmp_path):
    late = DAY + dt.timedelta(days=100)
    keyed = drain(spark, tmp_path, [[(1, DAY, 1, 50, 200), (2, DAY, 2, 60, 200)], [(2, late, 3, 60, 200)], [(2, late, 4, 65, 200)]],
                  keep=dt.timedelta(days=30), lateness="10 days")
    assert {r.listing_key: float(r.price) for r in keyed.prices().collect()} == {2: 65.0}
    gone = keyed.changed().where("expired").collect()
    assert [(r.listing_key, float(r.old_price), r.new_price) for r in gone] == [(1, 50.0, None)]
