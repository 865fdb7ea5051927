"""Reads: filters, orders, pages, ranks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bandwise import adapters
from bandwise.operators import search as S
from bandwise.plans import oracle_sql as O
from bandwise.plans.alert_queries import stored_alerts
from bandwise.plans.band_queries import as_of, written_bands, view
from bandwise.plans.registry import query
from bandwise.schemas import CLUSTER_KEYS

# The driver's tables hold brands and types where the domain has its own codes.
OPEN = {k: v for k, v in S.DOMAINS.items() if k not in CLUSTER_KEYS}

_F1 = f"""WITH {O.LISTINGS}, hits AS (SELECT * FROM listings WHERE listing_status = 'active'
  AND generation = 'Brand#7' AND source = 'ebay' AND year BETWEEN 1970 AND 1990
  AND asking_price BETWEEN 950 AND 1900)"""


def _listing_hits(spark, sf):
    return S.search_listings(
        adapters.listings(spark, sf), generation="Brand#7", source="ebay", year_min=1970,
        year_max=1990, price_min=950, price_max=1900, domains=OPEN,
    )


@query("f1_listing_search", f"{_F1} SELECT id, year, asking_price FROM hits")
def listing_search(spark, sf):
    return _listing_hits(spark, sf).select("id", "year", "asking_price")


@query("a5_search_total", f"{_F1} SELECT count(*) AS total FROM hits")
def search_total(spark, sf):
    return S.total(_listing_hits(spark, sf))


@query("t1_listing_page", f"""WITH {O.LISTINGS}
SELECT id, created_at, asking_price FROM listings WHERE listing_status = 'active'
ORDER BY created_at DESC, id LIMIT 50 OFFSET 100""")
def listing_page(spark, sf):
    active = S.search_listings(adapters.listings(spark, sf))
    return S.page(active, S.listings_order(), 50, 100).select("id", "created_at", "asking_price")


_F2 = f"""WITH {O.COMPS}, hits AS (SELECT * FROM comps WHERE body_style = 'PROMO'
  AND transmission = 'R' AND source = 'bat' AND sale_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'
  AND sale_price BETWEEN 1000 AND 1800)"""


def _comp_hits(spark, sf):
    return S.search_comps(
        adapters.comps(spark, sf), body_style="PROMO", transmission="R", source="bat",
        sold_from=dt.date(1998, 1, 1), sold_to=dt.date(2000, 12, 31), price_min=1000,
        price_max=1800, domains=OPEN,
    )


@query("f2_comp_search", f"{_F2} SELECT id, sale_date, sale_price FROM hits")
def comp_search(spark, sf):
    return _comp_hits(spark, sf).select("id", "sale_date", "sale_price")


@query("t2_comp_page", f"""WITH {O.COMPS}
SELECT id, sale_date, sale_price FROM comps
ORDER BY sale_date DESC NULLS LAST, id LIMIT 200 OFFSET 50""")
def comp_page(spark, sf):
    found = S.search_comps(adapters.comps(spark, sf))
    return S.page(found, S.comps_order(), 200, 50).select("id", "sale_date", "sale_price")


@query("f3_band_list", O.with_bands("""
SELECT cluster_key, comp_count, median_price FROM bands
WHERE transmission = 'N' AND insufficient_data"""))
def band_list(spark, sf):
    thin = S.list_bands(written_bands(spark, sf), transmission="N", insufficient=True, domains=OPEN)
    return thin.select("cluster_key", "comp_count", "median_price")


@query("t3_bands_by_key", O.with_bands(
    "SELECT cluster_key, comp_count, insufficient_data FROM bands ORDER BY cluster_key"))
def bands_by_key(spark, sf):
    return written_bands(spark, sf).select(
        "cluster_key", "comp_count", "insufficient_data"
    ).orderBy("cluster_key")


@query("f4_alert_list", O.with_alerts("""
SELECT alert_type, listing_id, severity, status FROM stored
WHERE status = 'read' AND severity = 'watch' AND alert_type = 'underpriced'"""))
def alert_list(spark, sf):
    found = S.search_alerts(
        stored_alerts(spark, sf), status="read", severity="watch", alert_type="underpriced"
    )
    return found.select("alert_type", "listing_id", "severity", "status")


@query("t4_alert_page", O.with_alerts("""
SELECT alert_type, listing_id, triggered_at FROM stored WHERE status = 'open'
ORDER BY triggered_at DESC, listing_id, alert_type LIMIT 50"""))
def alert_page(spark, sf):
    order = [F.col("triggered_at").desc(), F.col("listing_id").asc(), F.col("alert_type").asc()]
    found = S.page(S.search_alerts(stored_alerts(spark, sf)), order)
    return found.select("alert_type", "listing_id", "triggered_at")


@query("f5_point_lookup", f"""WITH {O.LISTINGS}, newest AS (SELECT max(id) AS m FROM listings)
SELECT id, source_url, asking_price FROM listings, newest WHERE id = m""")
def point_lookup(spark, sf):
    rows = adapters.listings(spark, sf)
    wanted = rows.agg(F.max("id").alias("m")).first()["m"]
    return S.by_id(rows, wanted).select("id", "source_url", "asking_price")


@query("f6_validated_search", f"""WITH {O.LISTINGS}
SELECT id, listing_status FROM listings WHERE listing_status = 'sold' AND source = 'pcarmarket'""")
def validated_search(spark, sf):
    """Values are checked against their domain first; an empty string means no filter."""
    rows = adapters.listings(spark, sf)
    try:
        S.search_listings(rows, status="gone")
        raise AssertionError("an unknown status must be refused")
    except ValueError:
        pass
    found = S.search_listings(rows, status="sold", source="pcarmarket", generation="")
    return found.select("id", "listing_status")


@query("f7_extended_search", O.with_alerts("""
SELECT id, mileage, delta_pct FROM askview WHERE listing_status = 'active' AND mileage <= 60000
  AND normalization_confidence >= 0.93 AND delta_pct <= -10"""))
def extended_search(spark, sf):
    found = S.search_listings(
        view(spark, sf), max_mileage=60_000, min_confidence=0.93, underpriced_only=True
    )
    return found.select("id", "mileage", "delta_pct")


@query("f7_recent_comps", f"""WITH {O.AS_OF}, {O.COMPS}
SELECT id, price_type, sale_date FROM comps, today WHERE price_type = 'dealer_ask'
  AND sale_date BETWEEN d - 90 AND d AND conf100 >= 92""")
def recent_comps(spark, sf):
    """The documented comp filters: price type, minimum confidence, last 90 days."""
    day = as_of(spark, sf)
    found = S.search_comps(
        adapters.comps(spark, sf), price_type="dealer_ask", sold_from=day - dt.timedelta(days=90),
        sold_to=day, min_confidence=0.92,
    )
    return found.select("id", "price_type", "sale_date")


@query("t5_alert_digest_order", O.with_alerts("""
SELECT alert_type, listing_id, severity, row_number() OVER (ORDER BY
  CASE severity WHEN 'act' THEN 0 WHEN 'watch' THEN 1 WHEN 'info' THEN 2 ELSE 9 END,
  triggered_at DESC, listing_id, alert_type) AS position FROM stored WHERE status = 'open'"""))
def alert_digest_order(spark, sf):
    rows = S.search_alerts(stored_alerts(spark, sf)).withColumn("tier", S.severity_rank(F.col("severity")))
    rows = rows.withColumn("age", -F.floor(F.unix_seconds(F.col("triggered_at").cast("timestamp")) / 3600))
    # A nightly run stamps all its alerts alike: one stamp is cut again by the heads of listing ids.
    rows = rows.withColumn("age", -F.unix_micros(F.col("triggered_at").cast("timestamp")))
    rows = rows.withColumn("head", F.substring("listing_id", 1, 4))
    ranked = S.ranked_by_steps(
        rows, [], ["tier", "age", "head"], [F.col("listing_id").asc(), F.col("alert_type").asc()], "position")
    return ranked.select("alert_type", "listing_id", "severity", "position")


@query("t7_cheapest_in_cluster", O.with_alerts("""
SELECT id, generation, body_style, transmission, delta_pct,
  row_number() OVER (PARTITION BY generation, body_style, transmission
    ORDER BY delta_pct NULLS LAST, id) AS cheapness_rank
FROM askview WHERE delta_pct IS NOT NULL"""))
def cheapest_in_cluster(spark, sf):
    ranked = S.cheapest_in_cluster(view(spark, sf), CLUSTER_KEYS)
    return ranked.select("id", *CLUSTER_KEYS, "delta_pct", "cheapness_rank")


@query("t9_last_history_entry", f"""WITH {O.LISTINGS}
SELECT id, old_price AS last_price, CAST(ship_day - 7 AS VARCHAR) AS last_ts FROM listings""")
def last_history_entry(spark, sf):
    last = F.try_element_at("price_history", F.lit(-1))
    return adapters.listings(spark, sf).select(
        "id", last["price"].alias("last_price"), last["ts"].alias("last_ts")
    )
