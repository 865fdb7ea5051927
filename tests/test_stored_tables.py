"""Daily counts, borrowed bands and bucketed tables."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from bandwise.operators import bands as B
from bandwise.operators import merge as M
from bandwise.operators.bucketed import BucketedTable
from bandwise.operators.histograms import DailyHistograms
from bandwise.session import run_folder

DAY = dt.date(2025, 3, 15)
COMPS = "generation string, body_style string, transmission string, sale_price decimal(10,2), sale_date date, confidence_score double"


def comps_of(spark, rng, n):
    rows = [(rng.choice(["G1", "G2", None]), rng.choice(["coupe", "targa"]), rng.choice(["manual", "auto", None]),
             rng.choice([None, Decimal(rng.randrange(100, 90_000)) / 100, Decimal("500.00")]),
             rng.choice([None, *[DAY - dt.timedelta(days=rng.randrange(0, 260))] * 20]), rng.choice([None, 0.9, 0.75])) for _ in range(n)]
    return spark.createDataFrame(rows, COMPS)


def same(a, b):
    assert a.columns == b.columns
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_counts_by_day_give_the_bands_of_a_rebuild(spark, tmp_path):
    comps = comps_of(spark, random.Random(6), 900).cache()
    days = [DAY - dt.timedelta(days=k) for k in (2, 1, 0)]
    counts = DailyHistograms(spark, str(tmp_path / "a"))
    late = (F.col("confidence_score") == 0.75) & (F.col("sale_date") < F.lit(days[0]))
    known = comps.where(~F.coalesce(late, F.lit(False)))
    counts.add(known, "first", until=days[0])
    counts.add(known, "first", until=days[0])  # a retry
    for day in days:
        if day != days[0]:
            counts.add(known, f"{day}", since=day, until=day)
        assert same(counts.bands(day), B.band_table(known.where(F.col("sale_date") <= F.lit(day)), day))
    counts.add(comps.where(late), "late")  # late comps of old days add up
    want = B.band_table(comps, DAY, include_wide_only=True)
    assert same(counts.bands(DAY, include_wide_only=True), want)
    merged = counts.compacted(str(tmp_path / "b"), DAY - dt.timedelta(days=180), DAY)
    assert same(merged.bands(DAY, include_wide_only=True), want)
    stored = counts.counts(dt.date(2000, 1, 1), DAY).agg(F.sum("n")).first()[0]
    left = merged.counts(dt.date(2000, 1, 1), DAY).agg(F.sum("n"), F.min("day")).first()
    assert left[0] < stored and left[1] >= DAY - dt.timedelta(days=180)


def test_days_outside_the_window_are_not_read(spark, tmp_path):
    counts = DailyHistograms(spark, str(tmp_path / "a"))
    counts.add(comps_of(spark, random.Random(1), 300), "first")
    few = counts.counts(DAY - dt.timedelta(days=3), DAY)
    plan = few._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("PushedFilters")[0]
    assert "day" in filters and ">=" in filters
    empty = DailyHistograms(spark, str(tmp_path / "e"))
    empty.add(comps_of(spark, random.Random(1), 5).limit(0), "first")
    assert empty.bands(DAY).count() == 0


def test_thin_clusters_borrow_from_the_finest_level(spark):
    rng = random.Random(3)
    comps = comps_of(spark, rng, 150)
    rows = [r for r in comps.collect() if r.sale_price is not None and r.sale_date is not None and r.sale_date >= DAY - dt.timedelta(days=90)
            and None not in (r.generation, r.body_style, r.transmission)]
    bands = B.band_table(comps, DAY, thin_window_days=90, levels=[list(x) for x in B.LATTICE])
    asked = [(i, g, b, t) for i, (g, b, t) in enumerate((g, b, t) for g in ("G1", "G2", "G9", None) for b in ("coupe", "targa", "new", None)
                                                         for t in ("manual", "auto", None))]
    asks = spark.createDataFrame(asked, "id long, generation string, body_style string, transmission string")
    got = {r.id: (r.level, r.comp_count, r.median_price) for r in B.borrowed_bands(asks, bands).collect()}
    assert len(got) == len(asked)
    levels = set()
    for i, *values in asked:
        ask = dict(zip(("generation", "body_style", "transmission"), values, strict=True))
        want = (None, None, None)
        for level in B.LATTICE:
            prices = [float(r.sale_price) for r in rows if all(r[k] == ask[k] for k in level)]
            if all(ask[k] is not None for k in level) and len(prices) >= 5:
                want = ("+".join(level) or "all", len(prices), round(float(np.percentile(prices, 50)), 4))
                break
        assert got[i] == want
        levels.add(want[0])
    assert len(levels) >= 3, levels


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning"), plan


def test_a_merge_moves_the_batch_only(spark):
    now = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    schema = "source string, source_url string, id string, asking_price decimal(10,2), listing_status string, created_at timestamp"
    at = dt.datetime(2024, 1, 1)
    stored = spark.createDataFrame([("bat", f"u{k}", f"i{k}", Decimal(k), "active", at) for k in range(200)], schema).withColumns(
        {"price_history": F.array().cast(M.HISTORY_TYPE), "updated_at": F.col("created_at")})
    batch = spark.createDataFrame([("bat", f"u{k}", f"n{k}", Decimal(k + k % 2), "active", at) for k in range(150, 230)], schema)
    folder = run_folder(spark, "bucketed")
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    table = BucketedTable(spark, name, folder, buckets=4)
    table.load(stored)
    joined = M.upsert_listings(table.rows(), batch, now)
    moved, plan = exchanges(joined)
    assert moved == 1 and "Bucketed: true" in plan
    assert exchanges(M.upsert_listings(stored, batch, now))[0] == 2
    want = M.upsert_listings(stored, batch, now)
    done = table.merge(batch, lambda old, new: M.upsert_listings(old, new, now))
    assert same(done.select(want.columns), want)
    again = BucketedTable(spark, name, folder, buckets=4)  # another session's view of the same table
    assert again.version == 1 and "action" not in again.rows().columns
    second = again.merge(batch, lambda old, new: M.upsert_listings(old, new, now))
    assert {r["action"]: r["count"] for r in second.groupBy("action").count().collect()} == {"updated": 80, "untouched": 150}
    per_bucket = second.select(F.input_file_name().alias("f")).distinct().count()
    assert per_bucket <= 4
