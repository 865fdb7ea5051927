import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from bandwise.functions import deltas
from bandwise.operators import bands as B

DAY = dt.date(2025, 3, 15)
SCHEMA = ("generation string, body_style string, transmission string, sale_price decimal(10,2), "
          "sale_date date, confidence_score double")


def _comps(spark, rows):
    from decimal import Decimal
    return spark.createDataFrame(
        [(g, b, t, None if p is None else Decimal(str(p)), d, c) for g, b, t, p, d, c in rows], SCHEMA)


def test_golden_band(spark):
    rows = [("G6", "coupe", "manual", p, DAY, c) for p, c in
            [(79500, .95), (87000, .9), (98500, .95), (104000, .94), (111000, .95)]]
    band = B.band_table(_comps(spark, rows), DAY).first()
    assert band["cluster_key"] == "G6:coupe:manual"
    assert (band["median_price"], band["p25_price"], band["p75_price"]) == (98500, 87000, 104000)
    assert (band["min_price"], band["max_price"], band["comp_count"]) == (79500, 111000, 5)
    assert round(band["avg_confidence"], 3) == 0.938 and not band["insufficient_data"]
    delta = spark.range(1).select(deltas.pct_of(F.lit(97500), F.lit(98500.0))).first()[0]
    assert delta == -1.0


def test_widening_and_filters(spark):
    new, old, ancient = DAY, DAY - dt.timedelta(days=120), DAY - dt.timedelta(days=181)
    rows = [("G1", "targa", "auto", 100 + i, old, .9) for i in range(4)]
    rows += [("G1", "targa", "auto", 200, new, .9)]
    rows += [("G2", "targa", "auto", 100, old, .9)]  # wide window only
    rows += [("G3", "targa", "auto", 100, ancient, .9), ("G3", None, "auto", 1, new, .9),
             ("G3", "targa", "auto", None, new, .9)]
    comps = _comps(spark, rows)
    bands = {r["cluster_key"]: r for r in B.band_table(comps, DAY).collect()}
    assert list(bands) == ["G1:targa:auto"]
    assert bands["G1:targa:auto"]["window_days"] == 180 and bands["G1:targa:auto"]["comp_count"] == 5
    every = B.band_table(comps, DAY, include_wide_only=True)
    assert {r["cluster_key"] for r in every.collect()} == {"G1:targa:auto", "G2:targa:auto"}
    edge = [("G4", "targa", "auto", 5, DAY - dt.timedelta(days=90), .9)]
    assert B.single_window_bands(_comps(spark, edge), DAY).count() == 1


def test_exact_percentiles_of_a_hot_cluster(spark):
    rng = random.Random(7)
    prices = [round(rng.lognormvariate(10, 1), 2) for _ in range(4001)] + [25000.0] * 1500
    rows = [("G5", "coupe", "manual", p, DAY, .5) for p in prices]
    band = B.band_table(_comps(spark, rows), DAY).first()
    want = np.percentile(prices, [25, 50, 75])
    assert np.allclose([band["p25_price"], band["median_price"], band["p75_price"]], want, atol=1e-4)


def test_comps_are_read_once(spark):
    rows = [("G5", "coupe", "manual", 10, DAY, .5)]
    bands = B.band_table(_comps(spark, rows), DAY)
    bands.collect()
    plan = bands._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_delta_modes(spark):
    df = spark.createDataFrame(
        [(80.0, 100.0, False), (80.0, 100.0, True), (80.0, 0.0, False), (80.0, None, None)],
        "ask double, median double, thin boolean")
    args = F.col("ask"), F.col("median"), F.col("thin")
    got = df.select(*[deltas.ask_vs_median(*args, m) for m in deltas.MODES]).collect()
    assert [tuple(r) for r in got] == [
        (-20.0, -20.0, -20.0), (-20.0, -20.0, None), (None, None, None), (None, None, None)]
