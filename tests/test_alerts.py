import datetime as dt

import pytest
from pyspark.sql import functions as F

from bandwise.operators import alerts as A
from bandwise.operators import search as S

NOW = dt.datetime(2025, 3, 15, 12, tzinfo=dt.timezone.utc)
VIEW = ("id string, source_url string, listing_status string, asking_price double, delta_pct double, "
        "median_price double, insufficient_data boolean, price_history array<struct<price:double,ts:string>>, "
        "created_at timestamp")


@pytest.mark.parametrize("hours, want", [(2, True), (24, True), (24 + 1 / 3600, False), (30, False), (None, False)])
def test_new_listing_window(spark, hours, want):
    made = None if hours is None else NOW - dt.timedelta(hours=hours)
    df = spark.createDataFrame([(made,)], "t timestamp")
    assert df.select(A.is_new(F.col("t"), NOW)).first()[0] is want


def test_unparsable_time_is_not_new(spark):
    assert spark.range(1).select(A.is_new(F.lit("not-a-date"), NOW)).first()[0] is False


@pytest.mark.parametrize("old, new, want", [
    (100000, 90000, True), (110000, 95000, True), (100000, 95000, True), (100000, 98000, False),
    (90000, 95000, False), (90000, 90000, False), (None, 90000, False), (100000, None, False),
    (0, 90000, False), (100.0, 95.01, False),
])
def test_price_drop(spark, old, new, want):
    df = spark.createDataFrame([(None if old is None else float(old), None if new is None else float(new))], "o double, n double")
    assert df.select(A.is_price_drop(F.col("o"), F.col("n"))).first()[0] is want


@pytest.mark.parametrize("delta, want", [(-15.0, "watch"), (-24.999, "watch"), (-25.0, "act"), (-50.0, "act")])
def test_severity(spark, delta, want):
    assert spark.range(1).select(A.underpriced_severity(F.lit(delta))).first()[0] == want


def _view(spark):
    old = NOW - dt.timedelta(days=9)
    return spark.createDataFrame([
        ("a", "u/a", "active", 75000.0, -25.0, 100000.0, False, [(80000.0, "t0"), (79000.0, "t1")], old),
        ("b", "u/b", "relist", 90000.0, -20.0, 110000.0, True, None, old),
        ("c", "u/c", "active", None, None, None, None, [(5.0, "t")], NOW),
        ("d", "u/d", "active", 99000.0, -14.9, 116000.0, False, [], old),
    ], VIEW)


def test_rules_and_dedup(spark):
    made = A.candidate_alerts(_view(spark), NOW)
    got = {(r["listing_id"], r["alert_type"]): r for r in made.collect()}
    assert set(got) == {("a", "underpriced"), ("a", "price_drop"), ("b", "relist"),
                        ("b", "insufficient_data_warning"), ("c", "new_listing")}
    assert got["a", "underpriced"]["severity"] == "act"
    assert got["a", "underpriced"]["reason"] == (
        "Asking $75,000 is 25.0% below cluster median $100,000 — u/a")
    assert got["c", "new_listing"]["reason"] == "New listing: u/c"
    existing = made.withColumn(
        "status", F.when(F.col("alert_type") == "relist", "dismissed").otherwise("read"))
    assert [r["alert_type"] for r in A.new_alerts(made, existing).collect()] == ["relist"]
    again = A.new_alerts(made, made)
    assert again.count() == 0


def test_transitions(spark):
    alerts = spark.createDataFrame([("1", "open"), ("2", "read"), ("3", "dismissed")], "id string, status string")
    asked = spark.createDataFrame(
        [("1", "read"), ("1", "dismissed"), ("2", "dismissed"), ("3", "open"), ("2", "open"), ("1", "gone"),
         ("9", "read")], "id string, new_status string")
    got = {(r["id"], r["new_status"]): r["verdict"] for r in A.apply_transitions(alerts, asked).collect()}
    assert got == {("1", "read"): "applied", ("1", "dismissed"): "applied", ("2", "dismissed"): "applied",
                   ("3", "open"): "rejected", ("2", "open"): "rejected", ("1", "gone"): "invalid status",
                   ("9", "read"): "not found"}


def test_stamping_covers_info_alerts(spark):
    rows = A.candidate_alerts(_view(spark), NOW)
    assert A.pending_notifications(rows).count() == 2
    assert A.stamp_notified(rows, NOW).where(F.col("notified_at").isNull()).count() == 0


def test_search_validation(spark):
    df = spark.createDataFrame([("active", 5.0)], "listing_status string, asking_price double")
    with pytest.raises(ValueError):
        S.search_listings(df, generation="G9")
    with pytest.raises(ValueError):
        S.page(df, [F.col("asking_price")], 0)
    with pytest.raises(ValueError):
        S.page(df, [F.col("asking_price")], 201)
    assert S.search_listings(df, generation="", price_min=5).count() == 1
