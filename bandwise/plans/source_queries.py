"""Archive, link discovery, file exchange and the streaming jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bandwise import adapters as A
from bandwise.functions import dictionaries as D
from bandwise.functions.dom import Pick
from bandwise.operators.normalizing import normalize_records
from bandwise.plans import oracle_sql as O
from bandwise.plans.band_queries import written_bands
from bandwise.plans.extract_queries import PAGES, expected
from bandwise.plans.merge_queries import _CHANGES, _LOG
from bandwise.plans.normalize_queries import ADS, sql_classes, sql_generation
from bandwise.plans.registry import query
from bandwise.session import run_folder
from bandwise.sources import archive, files, links, snapshots
from bandwise.sources import parsing as P
from bandwise.streaming import pipelines as S
from bandwise.streaming.keyed_state import KeyedPrices

_SLUG = """left(trim(regexp_replace(regexp_replace({u}, 'https?://', '', 'g'), '[^a-zA-Z0-9._-]', '_', 'g'), '_'), 120)
  || '_' || left(md5({u}), 8)"""


@query("src1_snapshot_scan", f"""WITH {PAGES} SELECT source, day AS fetch_date,
  CASE WHEN source = 'ebay' THEN 'json' ELSE 'html' END AS content_type, count(*) AS pages,
  min({_SLUG.format(u='source_url')}) AS first_slug FROM f GROUP BY ALL""")
def snapshot_scan(spark, sf):
    """Source, day, key and type of every archived page, read off its archive path."""
    pages = A.auction_pages(spark, sf)
    path = snapshots.archive_path("/archive", F.col("source"), F.col("fetched_at"), F.col("url"),
                                  F.col("content_type"))
    return pages.select(*snapshots.path_parts(path)).groupBy(
        "source", "fetch_date", "content_type"
    ).agg(F.count("*").alias("pages"), F.min("slug").alias("first_slug"))


@query("src2_snapshot_sink", f"WITH {PAGES} SELECT source, count(*) AS pages FROM f WHERE turn <> 3 GROUP BY 1")
def snapshot_sink(spark, sf):
    """Write the archive by source and month, skip empty pages, read it back."""
    return _archive(spark, sf).groupBy("source").agg(F.count("*").alias("pages"))


def _archive(spark, sf, **narrow):
    folder = S.run_folder(spark, "archive")
    snapshots.write_snapshots(A.auction_pages(spark, sf), folder, "month")  # seven years at once
    return snapshots.read_snapshots(spark, folder, **narrow)


@query("src1_archive_scan", f"""WITH {PAGES} SELECT source, day AS fetch_date, content_type, count(*) AS pages,
  min(slug) AS first_slug FROM (SELECT *, {_SLUG.format(u='source_url')} AS slug,
  CASE WHEN source = 'ebay' THEN 'json' ELSE 'html' END AS content_type FROM f WHERE turn <> 3) GROUP BY ALL""")
def archive_scan(spark, sf):
    """What the written archive holds per source and day."""
    return _archive(spark, sf).groupBy("source", "fetch_date", "content_type").agg(
        F.count("*").alias("pages"), F.min("slug").alias("first_slug"))


_DAYS = f"""WITH {PAGES} SELECT source, day AS fetch_date, content_type, count(*) AS pages,
  min(slug) AS first_slug FROM (SELECT *, {_SLUG.format(u='source_url')} AS slug,
  CASE WHEN source = 'ebay' THEN 'json' ELSE 'html' END AS content_type FROM f WHERE turn <> 3) GROUP BY ALL"""


def _day_archive(spark, sf):
    folder = run_folder(spark, "days")
    archive.write_pages(A.auction_pages(spark, sf), folder)
    return archive.read_pages(spark, folder)


@query("src2_day_archive", _DAYS)
def day_archive(spark, sf):
    """The archive by source and day as a data source: written, read back, counted."""
    return _day_archive(spark, sf).groupBy("source", "fetch_date", "content_type").agg(
        F.count("*").alias("pages"), F.min(snapshots.url_slug(F.col("url"))).alias("first_slug"))


_SINCE = dt.date(1996, 1, 1)


@query("src1_source_days", f"""WITH {PAGES} SELECT source_url, day AS fetch_date, {_SLUG.format(u='source_url')} AS slug
FROM f WHERE turn <> 3 AND source = 'bat' AND day >= DATE '{_SINCE}'""")
def source_days(spark, sf):
    """One source from a day on: the scan plans the pieces of these days only."""
    rows = _day_archive(spark, sf).where((F.col("source") == "bat") & (F.col("fetch_date") >= F.lit(_SINCE)))
    return rows.select(F.col("url").alias("source_url"), "fetch_date", snapshots.url_slug(F.col("url")).alias("slug"))




@query("src1_source_scan", f"""WITH {PAGES} SELECT source_url, day AS fetch_date, {_SLUG.format(u='source_url')} AS slug
FROM f WHERE turn <> 3 AND source = 'bat' AND day >= DATE '{_SINCE}'""")
def source_scan(spark, sf):
    """The archive of one source from a day on, which reads only its folders."""
    rows = _archive(spark, sf, source="bat", since=_SINCE)
    return rows.select(F.col("url").alias("source_url"), "fetch_date", "slug")


@query("src3_url_slugs", f"SELECT page_id, {_SLUG.format(u='url')} AS slug FROM pages")
def url_slugs(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", snapshots.url_slug(F.col("url")).alias("slug"))


def _pages_and_archive(spark, sf):
    pages = A.table(spark, sf, "pages").select(
        "page_id", "url", F.when(F.col("url").startswith("https"), F.lit("2025-01-02").cast("date"))
        .otherwise(F.lit("2025-01-01").cast("date")).alias("fetch_date"))
    archive = pages.select(snapshots.url_slug(F.col("url")).alias("slug"), F.lit("2025-01-01").cast("date")
                           .alias("fetch_date"))
    return pages, archive


@query("src4_new_pages", "SELECT page_id FROM pages WHERE url LIKE 'https%'")
def new_pages(spark, sf):
    """Pages without a snapshot of the same day."""
    return snapshots.not_yet_archived(*_pages_and_archive(spark, sf)).select("page_id")


@query("src4_seen_pages", "SELECT page_id FROM pages WHERE url NOT LIKE 'https%'")
def seen_pages(spark, sf):
    return snapshots.already_archived(*_pages_and_archive(spark, sf)).select("page_id")


_LINKS = r"""l AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site,
  unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages),
c AS (SELECT site, rtrim(regexp_replace(CASE WHEN href LIKE '/%' THEN site || href ELSE href END, '[?#].*$', ''), '/')
  AS link FROM l)"""
ITEM = r"^https?://[^/]+/[a-z0-9-]+/?$"


@query("src7_page_links", f"WITH {_LINKS} SELECT DISTINCT site, link FROM c WHERE regexp_matches(link, '{ITEM}')")
def page_links(spark, sf):
    return links.page_links(A.table(spark, sf, "pages"), ITEM)


@query("src8_search_links", """SELECT 'https://www.ebay.com/itm/' || o_orderkey AS link FROM orders
UNION ALL SELECT 'https://www.ebay.com/itm/' || (o_orderkey + 1000000000) FROM orders""")
def search_links(spark, sf):
    """Item links from nested JSON search responses, two items each."""
    k = F.col("o_orderkey")
    body = F.concat(
        F.lit('{"findItemsResponse": [{"searchResult": [{"item": [{"itemId": ["'), k.cast("string"),
        F.lit('"]}, {"itemId": ["'), (k + 1_000_000_000).cast("string"), F.lit('"]}, {"title": ["x"]}]}]}]}'))
    pages = A.table(spark, sf, "orders").select(body.alias("body"))
    return links.search_result_links(pages, "https://www.ebay.com/itm/")


_SECTIONS = f"""WITH {_LINKS}, a AS (SELECT link FROM c WHERE site LIKE 'https:%'
  UNION SELECT link FROM c WHERE site LIKE 'http:%')"""


def _sections(spark, sf):
    pages = A.table(spark, sf, "pages")
    return [links.page_links(pages.where(F.col("url").startswith(s)), r"^https?://.+").select("link")
            for s in ("https:", "http:")]


@query("so1_link_union", f"{_SECTIONS} SELECT link FROM a")
def link_union(spark, sf):
    return links.union_links(*_sections(spark, sf))


@query("src9_limited_links", f"{_SECTIONS} SELECT link FROM a ORDER BY link LIMIT 100")
def limited_links(spark, sf):
    """The first hundred of the union, in order."""
    return links.union_links(*_sections(spark, sf), limit=100)


@query("so2_thin_keys", O.with_bands("""SELECT cluster_key, comp_count FROM bands WHERE generation || ':' ||
  body_style || ':' || transmission IN (SELECT generation || ':' || body_style || ':' || transmission
  FROM narrow WHERE n < 5)"""))
def thin_keys(spark, sf):
    """Bands whose primary window was thin, by membership of their key."""
    bands = written_bands(spark, sf)
    thin = bands.where(F.col("window_days") == 180).select("cluster_key")
    return bands.join(thin, "cluster_key", "left_semi").select("cluster_key", "comp_count")


@query("src10_csv_exchange", O.with_bands("SELECT cluster_key, comp_count, median_price FROM bands"))
def csv_exchange(spark, sf):
    """Bands out to CSV and back in with a declared schema."""
    folder = S.run_folder(spark, "csv")
    bands = written_bands(spark, sf).select("cluster_key", "comp_count", "median_price")
    files.export_csv(bands, folder)
    return files.read_csv(spark, folder, bands.schema)


@query("src11_manual_import", f"""WITH {ADS}, m AS (SELECT *, ' ' || coalesce(description_raw, '') AS words FROM ads)
SELECT source_url, year, {sql_generation('year', 'words')} AS generation, description_raw,
  {sql_classes("coalesce(nullif(transmission_raw, ''), words)", D.TRANSMISSION_PATTERNS)} AS transmission FROM m""")
def manual_import(spark, sf):
    """Hand-collected records through CSV files into the normalization."""
    folder = S.run_folder(spark, "manual")
    none = F.lit(None).cast("string")
    sheet = A.ads(spark, sf).select(
        "source_url", "year", none.alias("generation"), F.col("body_style_raw").alias("body_style"),
        none.alias("trim"), F.col("transmission_raw").alias("transmission"), "exterior_color_raw", "mileage",
        F.col("final_price").cast("double").alias("asking_price"), none.alias("currency"),
        "description_raw", "listing_date",
        F.col("seller_type_raw").alias("seller_type"), none.alias("location"))
    files.export_csv(sheet, folder)
    records = normalize_records(files.import_manual(spark, folder))
    return records.select("source_url", "year", "generation", "description_raw", "transmission")


@query("src12_replay", expected("CASE WHEN y BETWEEN 1965 AND 1999 OR (strict AND y BETWEEN 1960 AND 1999) THEN y END AS year"))
def replay(spark, sf):
    """Extraction over an archive with an older, emptied snapshot of every page."""
    pages = A.auction_pages(spark, sf)
    older = pages.withColumn("fetched_at", F.col("fetched_at") - F.expr("interval 1 day")).withColumn(
        "content", F.lit("<h1>1970 old</h1>"))
    latest = snapshots.latest_snapshots(pages.unionByName(older))
    return P.parse_pages(latest, columns=("source_url", "year"))


@query("src12_versioned_replay", expected(
    "CASE WHEN y BETWEEN 1965 AND 1999 OR (strict AND y BETWEEN 1960 AND 1999) THEN y END AS year, source = 'bat' AS again"))
def versioned_replay(spark, sf):
    """A replay after one source's rules changed (it looked for titles elsewhere): only its pages are read again."""
    old = P.Source(P.bat, P.BAT | {"slots": P.BAT["slots"] | {"title": Pick(("h5",), text="tight")}})
    folder, pages = run_folder(spark, "replay"), A.auction_pages(spark, sf)
    P.extracted_pages(pages, P.SOURCES | {"bat": old}).write.parquet(folder)
    rows = P.replayed(spark.read.parquet(folder), pages)
    return rows.where("found").select("source_url", "year", "again")


def _tracked(spark, sf):
    tracker = S.PriceTracker(spark, S.run_folder(spark, "tracker"))
    stream = S.table_stream(spark, sf, "events").select(
        F.col("user_id").alias("listing_key"), F.col("ts").cast("timestamp").alias("scrape_ts"),
        "event_id", F.round("value", 2).cast("decimal(10,2)").alias("price"),
        F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status_code"))
    return tracker, tracker.run(stream)


@query("st1_incremental_prices", f"""WITH {_LOG} SELECT listing_key, event_id, scrape_ts, c / 100.0 AS price FROM log
WHERE status_code = 200 QUALIFY row_number() OVER (PARTITION BY listing_key ORDER BY scrape_ts DESC, event_id DESC) = 1""")
def incremental_prices(spark, sf):
    """Last price per listing after streaming the snapshot log through versioned state."""
    tracker, last = _tracked(spark, sf)
    return tracker.prices(last)


@query("p2_keyed_prices", f"""WITH {_LOG} SELECT listing_key, event_id, scrape_ts, c / 100.0 AS price FROM log
WHERE status_code = 200 QUALIFY row_number() OVER (PARTITION BY listing_key ORDER BY scrape_ts DESC, event_id DESC) = 1""")
def keyed_prices(spark, sf):
    """Last price per listing from the engine's keyed state, after the log came in three micro-batches that do not
    follow its time."""
    root = S.run_folder(spark, "keyed")
    log = A.snapshot_log(spark, sf).select("listing_key", "scrape_ts", "event_id", "price", "status_code")
    log.repartition(3, "event_id").write.parquet(f"{root}/in")
    keyed = KeyedPrices(spark, root)
    keyed.run(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
    return keyed.prices()


@query("st1_page_pipeline", f"""WITH {PAGES} SELECT source, source_url,
  CASE WHEN state <> 'O' THEN 'comp' ELSE 'listing' END AS kind, miles AS mileage, vin, paint AS exterior_color_raw,
  CAST(price AS DOUBLE) AS price, CASE WHEN state <> 'O' THEN day END AS sale_date,
  CASE WHEN state = 'O' THEN CASE WHEN k % 7 = 0 THEN 'removed' ELSE 'active' END END AS listing_status
FROM g WHERE status_code <> 404""")
def page_pipeline(spark, sf):
    """Pages as a stream through parsing, routing, normalization and the keyed merge. Every seventh
    page is gone a day later; it arrives first, since only fetch times count."""
    root = S.run_folder(spark, "pages")
    pages = A.auction_pages(spark, sf)
    again = pages.where(F.col("page_id") % 7 == 0).withColumns({
        "fetched_at": F.col("fetched_at") + F.expr("interval 1 day"), "status_code": F.lit(404),
        "content": F.lit("")})
    archive.write_pages(again, f"{root}/archive", empty=True)
    archive.write_pages(pages, f"{root}/archive", empty=True)
    ingest = S.PageIngest(spark, root)
    ingest.run(archive.follow_pages(spark, f"{root}/archive").select(pages.columns))
    shared = ["source", "source_url", "mileage", "vin", "exterior_color_raw"]
    listings = ingest.listings().select(
        *shared, F.lit("listing").alias("kind"), F.col("asking_price").alias("price"), "sale_date", "listing_status")
    comps = ingest.comps().select(
        *shared, F.lit("comp").alias("kind"), F.col("final_price").alias("price"), "sale_date",
        F.lit(None).cast("string").alias("listing_status"))
    return listings.unionByName(comps)


@query("st1_page_price_changes", f"""WITH {_LOG}, p AS (SELECT *, lag(scrape_ts) OVER w AS old_ts,
  sum(CASE WHEN status_code = 200 THEN 1 ELSE 0 END) OVER w AS nth FROM log
  WINDOW w AS (PARTITION BY listing_key ORDER BY scrape_ts, event_id)),
asks AS (SELECT *, lag(c) OVER (PARTITION BY listing_key ORDER BY scrape_ts, event_id) AS old FROM p WHERE status_code = 200)
SELECT 'market.example/' || listing_key AS source_url, scrape_ts, CAST(nullif(old, 0) AS DOUBLE) AS old_price, old_ts,
  CAST(c AS DOUBLE) AS new_price FROM asks WHERE nth > 1 AND c <> 0 AND c IS DISTINCT FROM old""")
def page_price_changes(spark, sf):
    """Every sighting of the log as a page; the page stream keeps the history of the asks."""
    root, log = S.run_folder(spark, "asks"), A.snapshot_log(spark, sf)
    page = F.concat(
        F.lit('<h1 class="listing-title">1988 Roadcar</h1><span class="bid-amount">$'),
        (F.col("price") * 100).cast("long").cast("string"), F.lit("</span>"))
    pages = log.select(
        F.col("event_id").alias("page_id"), F.lit("pcarmarket").alias("source"), F.concat(F.lit("market.example/"), "listing_key").alias("url"),
        F.col("scrape_ts").alias("fetched_at"), F.when(F.col("status_code") == 200, page).otherwise("").alias("content"),
        F.lit("html").alias("content_type"), "status_code")
    archive.write_pages(pages, f"{root}/archive", empty=True)
    ingest = S.PageIngest(spark, root)
    ingest.run(archive.follow_pages(spark, f"{root}/archive").select(pages.columns))
    return ingest.price_changes().select("source_url", "scrape_ts", "old_price", "old_ts", "new_price")


@query("st2_streaming_price_drops", f"""{_CHANGES}
SELECT listing_key, event_id, scrape_ts, old_c / 100.0 AS old_price, c / 100.0 AS new_price FROM changes
WHERE old_c > 0 AND c > 0 AND (old_c - c) * 100 >= 5 * old_c""")
def streaming_price_drops(spark, sf):
    """The same drops as the batch job finds."""
    tracker, _ = _tracked(spark, sf)
    return tracker.drops()


@query("st3_streaming_dedup", "SELECT DISTINCT event_type AS alert_type, user_id AS listing_id FROM events")
def streaming_dedup(spark, sf):
    """One alert per type and listing within the watermark horizon."""
    alerts = S.table_stream(spark, sf, "events").select(
        F.col("event_type").alias("alert_type"), F.col("user_id").alias("listing_id"),
        F.col("ts").cast("timestamp").alias("ts"))
    unique = S.unique_alerts(alerts, ["alert_type", "listing_id"], "ts", "60 days")
    return S.drain_to_table(unique, S.run_folder(spark, "dedup")).select("alert_type", "listing_id")


@query("st4_streaming_daily_metrics", """SELECT date_trunc('day', ts) AS day, count(*) AS pages,
  count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1""")
def streaming_daily_metrics(spark, sf):
    log = S.table_stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status_code"))
    return S.drain_daily(S.daily_metrics(log, "ts"), S.run_folder(spark, "daily"))


@query("st5_stream_band_join", O.with_all("""SELECT l.id, b.median_price, CASE WHEN b.median_price <> 0 THEN """
       + O.pct("l.asking_price", "b.median_price") + """ END AS delta_pct FROM listings l
  LEFT JOIN bands b USING (generation, body_style, transmission)"""))
def stream_band_join(spark, sf):
    """Asks arriving as a stream, priced against the current bands."""
    lines = S.table_stream(spark, sf, "lineitem")
    asks = A.listings_from(lines, A.table(spark, sf, "part"))
    priced = S.priced_stream(asks, written_bands(spark, sf)).select("id", "median_price", "delta_pct")
    return S.drain_to_table(priced, S.run_folder(spark, "priced"))


@query("st6_late_rows", f"""WITH {_LOG}, h AS (SELECT *, max(scrape_ts) OVER (PARTITION BY listing_key) AS newest
  FROM log WHERE status_code = 200) SELECT listing_key, count(*) AS late FROM h GROUP BY 1""")
def late_rows(spark, sf):
    """Replaying the whole log into a tracker that already holds it: every row is late, no price
    changes."""
    tracker, last = _tracked(spark, sf)
    tracker.process(A.snapshot_log(spark, sf), last + 1)
    again = spark.read.schema(S.STATE_SCHEMA).parquet(f"{tracker.root}/late/batch={last + 1}")
    return again.groupBy("listing_key").agg(F.count("*").alias("late"))
