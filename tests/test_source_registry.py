"""One pass over pages of all sources, and sources that a job brings along."""

import datetime as dt
import json

from pyspark.sql import functions as F

from bandwise.functions import extract as X
from bandwise.functions.dom import Pick
from bandwise.sources import parsing as P

AT = dt.datetime(2025, 2, 3, 4)
COLUMNS = "page_id long, source string, url string, fetched_at timestamp, content string, content_type string, status_code int"


def pages(spark, *rows):
    return spark.createDataFrame([(k, s, f"u{k}", AT, c, "html", status) for k, (s, c, status) in enumerate(rows)], COLUMNS)


def fifth(c):
    return P.Extraction(
        [{"name": X.slot_first("f", "name")}, {"year": X.year(c("name"), X.YEAR_FROM_1965)}], c("name") != "",
        dict(title_raw=c("name"), year=c("year"), asking_price=X.first_amount(X.slot("f", "price")), currency=F.lit("GBP"),
             is_completed=F.lit(False)))


def test_a_source_is_added_without_touching_the_parser(spark):
    spec = {"slots": {"name": Pick(("h2.name",), text="tight"), "price": Pick((".cost",), take="all", text="raw")}}
    sources = P.SOURCES | {"corner": P.Source(fifth, spec)}
    item = {"Item": {"Title": "1990 Porsche 911", "CurrentPrice": {"Value": "51,000"}, "ItemSpecifics": {"NameValueList": {"Name": "Trim", "Value": ["Targa", "x"]}}}}
    table = pages(
        spark, ("corner", '<h2 class="name">1971 Porsche 911 T</h2><b class="cost">$12,500</b>', 200), ("corner", "<p>none</p>", 200),
        ("bat", "<h1>1984 Porsche 911 Carrera</h1>", 301), ("bat", "<h1>1984 Porsche 911 Carrera</h1>", 404), ("ebay", json.dumps(item), 500),
        ("ebay", "no json", 200), ("ebay", '{"item": {}}', 200), ("pcarmarket", "<h1>1995 Porsche 911</h1>", 301), ("pcarmarket", "<h1>1995 Porsche 911</h1>", 200),
        ("unknown", "<h1>1980 Porsche</h1>", 200), ("bat", "", 200), (None, "<h1>1984 Porsche 911</h1>", 200), ("carsandbids", None, 200))
    got = {r.source_url: r for r in P.parse_pages(table, sources).collect()}
    assert set(got) == {"u0", "u2", "u4", "u8"}
    assert (got["u0"].title_raw, got["u0"].year, got["u0"].asking_price, got["u0"].currency) == ("1971 Porsche 911 T", 1971, 12500.0, "GBP")
    assert (got["u4"].title_raw, got["u4"].trim, got["u4"].asking_price, got["u4"].seller_type_raw) == ("1990 Porsche 911", "Targa", 51000.0, "private")
    assert got["u2"].currency == "USD" and got["u2"].price_type == "auction_final"
    assert set(r.source_url for r in P.parse_pages(table).collect()) == {"u2", "u4", "u8"}
    outcomes = {r.url: r.outcome for r in P.page_outcomes(table, sources).collect()}
    assert len(outcomes) == 13
    assert {k: v for k, v in outcomes.items() if v == "listing"} == {"u0": "listing", "u8": "listing"}
    assert outcomes["u3"] == "removed" and outcomes["u2"] == outcomes["u4"] == outcomes["u7"] == "fetch_error"
    assert {outcomes[f"u{k}"] for k in (1, 5, 6, 9, 10, 11, 12)} == {"extraction_error"}


def test_one_scan_one_python_stage_one_json_parse(spark, tmp_path):
    pages(spark, ("bat", "<h1>1984 Porsche 911</h1>", 200)).write.parquet(str(tmp_path / "p"))
    rows = P.routed(P.parse_pages(spark.read.parquet(str(tmp_path / "p"))))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("ArrowEvalPython") == 1
    assert "Union" not in plan and "Exchange" not in plan
    assert plan.count("parseJson") + plan.count("parse_json(") == 1


def test_a_replay_reads_what_changed(spark, tmp_path):
    table = pages(spark, *[("bat", f"<h1>19{70 + k} Porsche 911 T</h1>", 200) for k in range(4)], ("carsandbids", "<h1>1984 Porsche 911</h1>", 200),
                  ("carsandbids", "<p>none</p>", 200), ("ebay", "{}", 500))
    old = P.Source(P.bat, P.BAT | {"slots": P.BAT["slots"] | {"title": Pick(("h5",))}})
    P.extracted_pages(table, P.SOURCES | {"bat": old}).write.parquet(str(tmp_path / "v0"))
    stored = spark.read.parquet(str(tmp_path / "v0"))
    assert stored.where("found").count() == 1 and stored.count() == 7
    assert sorted(r.url for r in P.replay_due(stored, table).collect()) == ["u0", "u1", "u2", "u3"]
    P.replayed(stored, table).write.parquet(str(tmp_path / "v1"))
    after = spark.read.parquet(str(tmp_path / "v1"))
    full = P.extracted_pages(table)
    assert sorted(map(str, after.drop("again").collect())) == sorted(map(str, full.collect()))
    assert {r.source for r in after.where("again").collect()} == {"bat"}
    assert P.replay_due(after, table).count() == 0  # pages without a record are not read again either
    newer = table.withColumn("fetched_at", F.when(F.col("page_id") == 4, F.col("fetched_at") + F.expr("interval 1 day")).otherwise(F.col("fetched_at")))
    assert [r.url for r in P.replay_due(after, newer).collect()] == ["u4"]
    assert P.replayed(after, newer).where("again").count() == 1 and P.replayed(after, newer).count() == 7
    assert P.fingerprint(P.SOURCES["bat"]) == P.fingerprint(P.Source(P.bat, P.BAT)) != P.fingerprint(old)
