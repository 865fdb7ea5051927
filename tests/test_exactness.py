"""Values at the edges: cents, dates, rounding, foreign page parts, whole rankings, repeated drains."""

import datetime as dt

from pyspark.sql import functions as F

from bandwise.functions.deltas import pct_of
from bandwise.functions.normalize import lenient_date
from bandwise.operators.bands import band_table
from bandwise.operators.search import ranked_by_steps
from bandwise.schemas import RAW_PAGE_SCHEMA
from bandwise.sources import parsing as P
from bandwise.sources.links import page_links

AT = dt.datetime(2025, 3, 15, 12)


def test_bands_of_double_prices_keep_their_cents(spark):
    rows = [("g", "b", "t", dt.date(2025, 3, 1), p, 0.9) for p in (0.29, 4.35, 1136.10)]
    comps = spark.createDataFrame(rows, "generation string, body_style string, transmission string, sale_date date, "
                                        "sale_price double, confidence_score double")
    band = band_table(comps, dt.date(2025, 3, 15), min_size=1).first()
    assert (float(band["min_price"]), float(band["median_price"]), float(band["max_price"])) == (0.29, 4.35, 1136.10)


def test_unpadded_dates_and_single_rounding(spark):
    one = spark.range(1)
    assert one.select(lenient_date(F.lit("2025-3-4"))).first()[0] == dt.date(2025, 3, 4)
    assert one.select(pct_of(F.lit(100.04999999), F.lit(100.0))).first()[0] == 0.0


def _page(spark, body):
    return spark.createDataFrame([("pcarmarket", "u", AT, f"<h1>1992 Porsche 911 Turbo</h1>{body}", "html", 200)], RAW_PAGE_SCHEMA)


def test_a_foreign_sold_box_does_not_end_a_live_auction(spark):
    body = ('<span class="badge">Live</span><b class="current-bid">$39,500</b>'
            '<div class="related"><span class="badge">Sold $8,888</span></div>')
    row = P.parse_pages(_page(spark, body)).first()
    assert (row["is_completed"], row["final_price"], row["asking_price"]) == (False, None, 39500.0)


def test_a_badge_holds_its_own_price_and_texts_stay_whole(spark):
    body = ('<span class="badge">Sold for $52,250</span><p>Deposit $500</p>'
            f'<div class="description">{"long story " * 400}the end</div>')
    row = P.parse_pages(_page(spark, body)).first()
    assert (row["is_completed"], row["final_price"]) == (True, 52250.0)
    assert row["description_raw"].endswith("the end")


def test_links_in_every_quoting(spark):
    html = ("<a href='/item/1'>x</a><A HREF=/item/2>x</A><a class=k href=\"/item/3?q=1\">x</a><a href = '/item/4#z'>x</a>")
    found = page_links(spark.createDataFrame([("http://s.example/p", html)], "url string, html string"), "/item/")
    assert sorted(r["link"] for r in found.collect()) == [f"http://s.example/item/{k}" for k in (1, 2, 3, 4)]


def test_ranks_by_steps_are_whole(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 100).alias("s"), "id")
    got = {(r["k"], r["id"]): r["place"] for r in ranked_by_steps(df, ["k"], ["s"], [F.col("id")], "place").collect()}
    for k in range(3):
        assert [got[k, i] for i in range(k, 1000, 3)] == list(range(1, len(range(k, 1000, 3)) + 1))
