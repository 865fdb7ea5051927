import datetime as dt
import random

from pyspark.sql import functions as F

from bandwise.operators import linkage as L
from bandwise.operators import merge as M
from bandwise.operators import quality as Q
from bandwise.operators.skew import time_chunk, with_previous

NOW = dt.datetime(2025, 3, 15)
T0 = dt.datetime(2025, 1, 1)
STORED = ("source string, source_url string, asking_price double, mileage int, listing_status string, "
          "created_at timestamp, updated_at timestamp, price_history array<struct<price:double,ts:string>>")


def test_upsert_keeps_and_overwrites(spark):
    stored = spark.createDataFrame([
        ("bat", "u1", 100.0, 5, "removed", T0, T0, None),
        ("bat", "u2", 100.0, 5, "active", T0, T0, [(1.0, "x")]),
        ("bat", "u3", None, 5, "active", T0, T0, None),
    ], STORED)
    batch = spark.createDataFrame([
        ("bat", "u1", 90.0, None, NOW), ("bat", "u2", 0.0, 7, NOW), ("bat", "u3", 50.0, 7, NOW),
        ("ebay", "u1", 1.0, 1, NOW),
    ], "source string, source_url string, asking_price double, mileage int, created_at timestamp")
    rows = {(r["source"], r["source_url"]): r for r in M.upsert_listings(stored, batch, NOW).collect()}
    one = rows["bat", "u1"]
    assert (one["asking_price"], one["mileage"], one["listing_status"]) == (90.0, None, "removed")
    assert one["created_at"] == T0 and one["updated_at"] == NOW and one["action"] == "updated"
    assert [h["price"] for h in one["price_history"]] == [100.0]
    assert [h["price"] for h in rows["bat", "u2"]["price_history"]] == [1.0]  # a zero is no price
    assert [h["price"] for h in rows["bat", "u3"]["price_history"]] == [None]
    assert rows["ebay", "u1"]["action"] == "inserted"
    kept = M.upsert_listings(stored, batch, NOW, keep_existing_when_null=True)
    assert kept.where("source = 'bat' and source_url = 'u1'").first()["mileage"] == 5


def test_upsert_is_idempotent(spark):
    stored = spark.createDataFrame([("bat", "u1", 100.0, 5, "active", T0, T0, None)], STORED)
    batch = stored.select("source", "source_url", "asking_price", "mileage")
    once = M.upsert_listings(stored, batch, NOW).drop("action")
    twice = M.upsert_listings(once, batch, NOW).drop("action")
    assert once.collect() == twice.collect()


def test_comps_are_write_once(spark):
    schema = "source string, source_url string, sale_price double, confidence_score double"
    stored = spark.createDataFrame([("bat", "u", 10.0, 0.5)], schema)
    batch = spark.createDataFrame([("bat", "u", 99.0, 0.9), ("bat", "v", 5.0, 0.1)], schema)
    rows = {r["source_url"]: r for r in M.upsert_comps(stored, batch).collect()}
    assert rows["u"]["sale_price"] == 10.0 and rows["u"]["confidence_score"] == 0.9
    assert rows["v"]["action"] == "inserted"


def test_previous_across_chunks(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < .5 else rng.choice([None, 1, 2, 3]), i, T0 + dt.timedelta(minutes=rng.randrange(6000)),
             rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, id int, ts timestamp, v double")
    found = with_previous(df, ["k"], time_chunk("ts"), ["ts", "id"], ["v"])
    got = {(r["k"], r["id"]): r["prev"] and r["prev"]["v"] for r in found.collect()}
    want, last = {}, {}
    for k, i, ts, v in sorted(rows, key=lambda r: (r[2], r[1])):
        want[k, i] = last.get(k)
        last[k] = v
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]  # all rows are shuffled once by key and slice


def test_similar_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    day = dt.date(2024, 1, 1)
    rows = [(f"r{i:04d}", None if rng.random() < .9 else "VIN", 1990, "G5", "manual",
             rng.choice(["red", "red", "red", "blue"]), rng.randrange(0, 40_000),
             day + dt.timedelta(days=rng.randrange(700))) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, vin string, year int, generation string, "
                               "transmission string, exterior_color_canonical string, mileage int, listing_date date")
    got = {r["id"]: (r["duplicate_date"], r["possible_duplicate_id"]) for r in L.similar_duplicates(df).collect()}
    by_id = {r[0]: r for r in rows}

    def matches(r, s):
        return (r[2:6] == s[2:6] and abs(r[6] - s[6]) <= 500 and 0 <= (r[7] - s[7]).days <= 60
                and (s[7], s[6], s[0]) < (r[7], r[6], r[0]))

    free = [r for r in rows if r[1] is None]
    want = {}
    for r in free:
        dates = [s[7] for s in free if matches(r, s)]
        if dates:
            want[r[0]] = min(dates)
    assert {k: v[0] for k, v in got.items()} == want and want
    assert all(matches(by_id[k], by_id[d]) and by_id[d][7] == day_ for k, (day_, d) in got.items())


def test_year_ranges_overlap(spark):
    df = spark.createDataFrame([(1989,), (1994,), (1970,), (2001,)], "year int")
    rows = L.with_models_by_year(df, L.canonical_models(spark)).collect()
    assert sorted((r["year"], r["model_generation"]) for r in rows if r["model_generation"]) == [
        (1970, "G1"), (1989, "G4"), (1989, "G5"), (1994, "G5"), (1994, "G6")]
    assert len(rows) == 6


def test_quarantine(spark):
    df = spark.createDataFrame(
        [("bat", "u", 1990, 5, 0.5), ("bat", "u", None, -1, 0.5), (None, "u", 1964, 5, 1.5)],
        "source string, source_url string, year int, mileage int, normalization_confidence double")
    good, bad = Q.split_by_rules(df, Q.listing_rules())
    assert good.count() == 1
    assert sorted(r["violations"] for r in bad.collect()) == [
        ["source missing", "year out of range", "confidence out of range"], ["year missing", "mileage negative"]]


def test_removed_listings_seen_again_are_relists(spark):
    day = dt.timedelta(days=1)
    log = spark.createDataFrame(
        [(1, 1, T0, 404), (1, 2, T0 + 8 * day, 200),  # back after more than a week
         (2, 3, T0, 404), (2, 4, T0 + 6 * day, 200),  # back too soon
         (3, 5, T0, 200), (3, 6, T0 + 9 * day, 200)],  # never gone
        "listing_key long, event_id long, scrape_ts timestamp, status_code int")
    stored = spark.createDataFrame(
        [(1, "removed", T0), (2, "removed", T0), (3, "active", T0), (4, None, T0)],
        "listing_key long, listing_status string, updated_at timestamp")
    found = M.relists(log, dt.timedelta(days=7))
    rows = {r[0]: (r["listing_status"], r["updated_at"]) for r in M.mark_relisted(stored, found).collect()}
    assert rows == {1: ("relist", T0 + 8 * day), 2: ("removed", T0), 3: ("active", T0), 4: (None, T0)}
