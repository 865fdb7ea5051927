"""The page stream gives the same tables however its pages are split into micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from bandwise.operators.merge import mark_removed, one_per_key, upsert_listings
from bandwise.operators.normalizing import normalize_records
from bandwise.schemas import HISTORY_TYPE
from bandwise.sources.parsing import parse_pages, routed
from bandwise.streaming.pipelines import PageIngest

PAGE = "source string, url string, fetched_at timestamp, content string, content_type string, status_code int"


def _page(url, day, status, price, sold=False):
    end = f'<div class="auction-result">${price}</div>' if sold else f'<span class="bid-amount">${price}</span>'
    body = (f'<h1 class="listing-title">1988 Roadcar {url}</h1>{end}<time datetime="2024-05-02T10:00:00Z"></time>'
            '<ul><li>Mileage: 41,000</li></ul>')
    return ("pcarmarket", url, dt.datetime(2024, 5, day), body if status == 200 else "", "html", status)


PAGES = [
    _page("a", 1, 200, 50_000), _page("a", 3, 200, 47_000), _page("a", 2, 200, 49_000),  # newest ask wins
    _page("b", 1, 200, 30_000), _page("b", 2, 404, 0),  # gone
    _page("c", 1, 200, 31_000), _page("c", 2, 404, 0), _page("c", 3, 200, 29_000),  # gone and back
    _page("d", 1, 200, 60_000, True), _page("d", 2, 200, 61_000, True),  # a sale is written once
    _page("e", 1, 404, 0), _page("f", 1, 500, 0), _page(None, 1, 200, 1_000), _page("a", 3, 200, 47_000),
]


def _tables(ingest):
    listings = {(r.source_url, r.asking_price, r.listing_status, r.created_at.day) for r in ingest.listings().collect()}
    return listings, {(r.source_url, r.final_price) for r in ingest.comps().collect()}


def test_any_split_gives_the_same_tables(spark, tmp_path):
    want = ({("a", 47_000.0, "active", 1), ("b", 30_000.0, "removed", 1), ("c", 29_000.0, "active", 1)}, {("d", 60_000.0)})
    for name, split in (("one", [PAGES]), ("two", [PAGES[1::2], PAGES[::2]]), ("late", [PAGES[7:], PAGES[:7]])):
        ingest, folder = PageIngest(spark, str(tmp_path / name)), str(tmp_path / f"{name}-in")
        for part in split:
            spark.createDataFrame(part, PAGE).coalesce(1).write.mode("append").parquet(folder)
            ingest.run(spark.readStream.schema(PAGE).parquet(folder))
        assert _tables(ingest) == want
        ingest.run(spark.readStream.schema(PAGE).parquet(folder))  # nothing new
        ingest.process(spark.createDataFrame(split[-1], PAGE), len(split) - 1)  # a retried batch
        assert _tables(ingest) == want


def test_history_equals_repeated_upserts(spark, tmp_path):
    """Histories, prices and times of the stream are those of one batch upsert per moment, in the order of the fetches."""
    shown = spark.createDataFrame([p for p in PAGES if p[1]] + [
        _page("a", 5, 404, 0), _page("a", 6, 200, 47_000), _page("a", 7, 404, 0), _page("a", 8, 200, 45_000),
        _page("g", 1, 404, 0), _page("g", 2, 200, 9_000), _page("g", 4, 200, 9_500), _page("g", 9, 200, 9_000)], PAGE)
    ingest = PageIngest(spark, str(tmp_path / "s"))
    for k, part in enumerate(shown.randomSplit([1.0, 1.0], 3)):
        ingest.process(part, k)
    columns = ["source", "source_url", "asking_price", "updated_at", "price_history"]
    got = {r.source_url: tuple(r) for r in ingest.listings().select(*columns).collect()}

    stored = spark.createDataFrame([], f"source string, source_url string, asking_price double, "
                                       f"listing_status string, updated_at timestamp, price_history {HISTORY_TYPE}")
    records = normalize_records(routed(parse_pages(shown.where("status_code <> 404")))).where("route = 'listing'").select(
        "source", "source_url", "asking_price", "scrape_ts")
    records = spark.createDataFrame(records.collect(), records.schema)
    for day in range(1, 10):
        now = dt.datetime(2024, 5, day)
        pages = shown.where(F.col("fetched_at") == F.lit(now))
        seen = records.where(F.col("scrape_ts") == F.lit(now))
        batch = one_per_key(seen, ["asking_price"]).select("source", "source_url", "asking_price").withColumns(
            {"listing_status": F.lit("active"), "updated_at": F.lit(now)})
        stored = upsert_listings(stored, batch, now).drop("action")
        stored = mark_removed(stored, pages.where("status_code = 404").select("source", F.col("url").alias("source_url")), now)
        stored = spark.createDataFrame(stored.collect(), stored.schema)
    want = {r.source_url: tuple(r) for r in stored.select(*columns).collect()}
    assert got == want
    assert [e.price for e in got["a"][4]] == [50_000.0, 49_000.0, 47_000.0] and len(got["g"][4]) == 2


def test_run_counters(spark, tmp_path):
    ingest = PageIngest(spark, str(tmp_path / "r"))
    ingest.process(spark.createDataFrame(PAGES[:7], PAGE), 0)
    ingest.process(spark.createDataFrame(PAGES[7:], PAGE), 1)
    ingest.process(spark.createDataFrame(PAGES[7:], PAGE), 1)  # a retried batch counts once
    rows = {r.batch: r for r in ingest.runs().collect()}
    assert tuple(rows[0])[2:8] == (7, 5, 3, 2, 0, 0)
    # c and a again, d new and again; e is gone, f failed, one has no address
    assert tuple(rows[1])[2:8] == (7, 4, 1, 3, 2, 0)
    assert all(r.duration_s > 0 for r in rows.values())
