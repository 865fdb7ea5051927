"""Keyed merges, change logs, quality rules and linkage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bandwise import adapters as A
from bandwise.operators import bands as B
from bandwise.operators import linkage as L
from bandwise.operators import merge as M
from bandwise.operators import quality as Q
from bandwise.operators.bucketed import BucketedTable
from bandwise.operators.normalizing import normalize_records
from bandwise.operators.skew import latest_per_key
from bandwise.plans import oracle_sql as O
from bandwise.plans.band_queries import as_of
from bandwise.plans.normalize_queries import _NORMALIZED, ADS, lit
from bandwise.plans.registry import query
from bandwise.session import run_folder

CUT = dt.date(1999, 1, 1)
NOW = dt.datetime(2002, 1, 1, tzinfo=dt.timezone.utc)

_LATEST = """QUALIFY row_number() OVER (PARTITION BY source, source_url
  ORDER BY created_at DESC, id DESC) = 1"""
_SPLIT = f"""
stored AS (SELECT * FROM listings WHERE listing_date < DATE '{CUT}' {_LATEST}),
batch AS (SELECT * FROM listings WHERE listing_date >= DATE '{CUT}' {_LATEST})"""


def split_listings(spark, sf):
    """(stored table, incoming batch): the asks before and after a cut day, one per key."""
    rows = A.listings(spark, sf).select(
        "source", "source_url", "id", "created_at", "asking_price", "mileage", "listing_status",
        "listing_date",
    )
    order = ["created_at", "id"]
    stored = M.one_per_key(rows.where(F.col("listing_date") < F.lit(CUT)), order)
    stored = stored.withColumn("price_history", F.array().cast(M.HISTORY_TYPE)).withColumn(
        "updated_at", F.col("created_at"))
    batch = M.one_per_key(rows.where(F.col("listing_date") >= F.lit(CUT)), order)
    return stored, batch.drop("listing_date")


@query("q5_one_per_key", f"""WITH {O.LISTINGS}
SELECT source, source_url, id, CAST(asking_price AS DOUBLE) AS asking_price FROM listings {_LATEST}""")
def one_per_key(spark, sf):
    rows = A.listings(spark, sf).select("source", "source_url", "id", "created_at", "asking_price")
    latest = M.one_per_key(rows, ["created_at", "id"])
    return latest.select("source", "source_url", "id", F.col("asking_price").cast("double"))


_MERGED = f"""WITH {O.LISTINGS}, {_SPLIT},
merged AS (SELECT coalesce(s.source, b.source) AS source, coalesce(s.source_url, b.source_url) AS source_url,
  coalesce(s.id, b.id) AS id, coalesce(b.cents, s.cents) / 100.0 AS asking_price,
  CASE WHEN b.id IS NULL THEN s.mileage ELSE b.mileage END AS mileage,
  coalesce(s.listing_status, b.listing_status) AS listing_status,
  coalesce(s.created_at, b.created_at) AS created_at, s.cents AS old_cents, b.cents AS new_cents,
  s.created_at AS old_at,
  CASE WHEN s.id IS NOT NULL AND b.id IS NOT NULL THEN 'updated' WHEN b.id IS NOT NULL THEN 'inserted'
    ELSE 'untouched' END AS action
  FROM stored s FULL JOIN batch b ON s.source = b.source AND s.source_url = b.source_url)"""


@query("u1_listing_upsert", f"""{_MERGED}
SELECT source, source_url, id, asking_price, mileage, listing_status, created_at, action FROM merged""")
def listing_upsert(spark, sf):
    merged = M.upsert_listings(*split_listings(spark, sf), NOW)
    return merged.select("source", "source_url", "id", "asking_price", "mileage", "listing_status",
                         "created_at", "action")


def _table(spark, name):
    folder = run_folder(spark, name)
    return BucketedTable(spark, folder.rsplit("/", 1)[1].replace("-", "_"), folder, buckets=8)


_UPSERTED = ["source", "source_url", "id", "asking_price", "mileage", "listing_status", "created_at", "action"]


@query("u1_bucketed_upsert", f"{_MERGED} SELECT {', '.join(_UPSERTED)} FROM merged")
def bucketed_upsert(spark, sf):
    """The same merge into a stored table in buckets of the key: only the batch is shuffled."""
    stored, batch = split_listings(spark, sf)
    table = _table(spark, "listings")
    table.load(stored)
    return table.merge(batch, lambda old, new: M.upsert_listings(old, new, NOW)).select(*_UPSERTED)


@query("u2_history_append", f"""{_MERGED}
SELECT source_url, CAST(old_cents / 100.0 AS DOUBLE) AS old_price,
  strftime(old_at, '%Y-%m-%d %H:%M:%S') AS old_ts FROM merged
WHERE action = 'updated' AND old_cents <> new_cents""")
def history_append(spark, sf):
    """History entries that the upsert adds."""
    merged = M.upsert_listings(*split_listings(spark, sf), NOW)
    last = F.try_element_at("price_history", F.lit(-1))
    return merged.where(F.size("price_history") > 0).select(
        "source_url", last["price"].alias("old_price"), last["ts"].alias("old_ts"))


_COMP_LATEST = """QUALIFY row_number() OVER (PARTITION BY source, source_url
  ORDER BY sale_date DESC, id DESC) = 1"""


_COMP_MERGED = f"""WITH {O.COMPS},
s AS (SELECT * FROM comps WHERE sale_date < DATE '{CUT}' {_COMP_LATEST}),
b AS (SELECT * FROM comps WHERE sale_date >= DATE '{CUT}' {_COMP_LATEST})
SELECT coalesce(s.source_url, b.source_url) AS source_url, coalesce(s.id, b.id) AS id,
  coalesce(s.cents, b.cents) / 100.0 AS sale_price, coalesce(b.conf100, s.conf100) / 100.0 AS confidence_score,
  CASE WHEN s.id IS NOT NULL AND b.id IS NOT NULL THEN 'updated' WHEN b.id IS NOT NULL THEN 'inserted'
    ELSE 'untouched' END AS action FROM s FULL JOIN b USING (source, source_url)"""


@query("u3_comp_upsert", _COMP_MERGED)
def comp_upsert(spark, sf):
    return M.upsert_comps(*split_comps(spark, sf)).select(
        "source_url", "id", "sale_price", "confidence_score", "action")


def split_comps(spark, sf):
    """(stored comps, incoming batch): the sales before and after the cut day, one per key."""
    rows = A.comps(spark, sf).select("source", "source_url", "id", "sale_price", "sale_date",
                                     "confidence_score")
    order = ["sale_date", "id"]
    stored = M.one_per_key(rows.where(F.col("sale_date") < F.lit(CUT)), order)
    return stored, M.one_per_key(rows.where(F.col("sale_date") >= F.lit(CUT)), order)


@query("u3_bucketed_upsert", _COMP_MERGED)
def bucketed_comp_upsert(spark, sf):
    """Comps merged into a table in buckets of the key."""
    stored, batch = split_comps(spark, sf)
    table = _table(spark, "comps")
    table.load(stored)
    return table.merge(batch, M.upsert_comps).select("source_url", "id", "sale_price", "confidence_score", "action")


_GONE = "gone AS (SELECT DISTINCT source, source_url FROM batch WHERE listing_status = 'removed')"


@query("u4_mark_removed", f"""WITH {O.LISTINGS}, {_SPLIT}, {_GONE}
SELECT s.source_url, CASE WHEN g.source_url IS NOT NULL THEN 'removed' ELSE listing_status END AS listing_status,
  g.source_url IS NOT NULL AS touched
FROM stored s LEFT JOIN gone g ON g.source = s.source AND g.source_url = s.source_url""")
def mark_removed(spark, sf):
    stored, batch = split_listings(spark, sf)
    gone = batch.where(F.col("listing_status") == "removed")
    done = M.mark_removed(stored, gone, NOW)
    return done.select("source_url", "listing_status", (F.col("updated_at") == F.lit(NOW)).alias("touched"))


@query("u5_run_metrics", f"""{_MERGED}, o AS (SELECT source, action AS outcome FROM merged WHERE action <> 'untouched'
  UNION ALL SELECT ['bat','carsandbids','ebay','pcarmarket'][CAST(user_id % 4 AS INTEGER) + 1],
    CASE WHEN value > 100 THEN 'fetch_error' ELSE 'extraction_error' END
  FROM events WHERE event_type = 'error')
SELECT source, count(*) FILTER (WHERE outcome <> 'fetch_error') AS pages_fetched,
  count(*) FILTER (WHERE outcome IN ('inserted', 'updated')) AS records_extracted,
  count(*) FILTER (WHERE outcome = 'inserted') AS records_inserted,
  count(*) FILTER (WHERE outcome = 'updated') AS records_updated,
  count(*) FILTER (WHERE outcome IN ('fetch_error', 'extraction_error')) AS extraction_errors,
  0 AS normalization_errors, CAST(90 AS DOUBLE) AS duration_s FROM o GROUP BY 1""")
def run_metrics(spark, sf):
    """Run log of a merge: its actions, plus the failed fetches of the event log."""
    merged = M.upsert_listings(*split_listings(spark, sf), NOW)
    acted = merged.where(F.col("action") != "untouched").select("source", F.col("action").alias("outcome"))
    failed = A.table(spark, sf, "events").where(F.col("event_type") == "error").select(
        A.pick(A.SITES, F.col("user_id")).alias("source"),
        F.when(F.col("value") > 100, "fetch_error").otherwise("extraction_error").alias("outcome"),
    )
    return M.run_metrics(acted.unionByName(failed), NOW, NOW + dt.timedelta(seconds=90)).drop("run_at")


_LOG = """log AS (SELECT user_id AS listing_key, event_id, ts AS scrape_ts,
  CAST(round(value * 100) AS BIGINT) AS c, CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status_code
  FROM events)"""


@query("u7_relists", f"""WITH {_LOG}, p AS (SELECT *, lag(scrape_ts) OVER w AS removed_ts,
  lag(status_code) OVER w AS before FROM log WINDOW w AS (PARTITION BY listing_key ORDER BY scrape_ts, event_id))
SELECT listing_key, event_id, scrape_ts, removed_ts FROM p
WHERE status_code = 200 AND before = 404 AND scrape_ts - removed_ts > INTERVAL 12 HOUR""")
def relists(spark, sf):
    """Listings seen again more than 12 hours after a removal (the documented gap is 7 days; the
    event log spans one month)."""
    return M.relists(A.snapshot_log(spark, sf), dt.timedelta(hours=12))


_SIGHTINGS = """log AS (SELECT o_custkey AS listing_key, o_orderkey AS event_id, CAST(o_orderdate AS TIMESTAMP) AS scrape_ts,
  CASE WHEN o_orderstatus = 'F' THEN 200 WHEN o_orderkey % 3 = 0 THEN 404 ELSE 200 END AS status_code FROM orders),
p AS (SELECT *, lag(scrape_ts) OVER w AS removed_ts, lag(status_code) OVER w AS before FROM log
  WINDOW w AS (PARTITION BY listing_key ORDER BY scrape_ts, event_id)),
relisted AS (SELECT listing_key, event_id, scrape_ts, removed_ts FROM p
  WHERE status_code = 200 AND before = 404 AND scrape_ts - removed_ts > INTERVAL 7 DAY)"""


def sightings(spark, sf):
    """Sightings over seven years, from the orders: the customer's number is the listing, and a third of the
    orders that are not filled count as removals."""
    gone = (F.col("o_orderstatus") != "F") & (F.col("o_orderkey") % 3 == 0)
    return A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("listing_key"), F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").cast("timestamp").alias("scrape_ts"), F.when(gone, 404).otherwise(200).alias("status_code"))


RELIST_GAP = dt.timedelta(days=7)


@query("u7_relists_after_week", f"WITH {_SIGHTINGS} SELECT * FROM relisted")
def relists_after_week(spark, sf):
    """Listings seen again more than the documented 7 days after a removal."""
    return M.relists(sightings(spark, sf), RELIST_GAP)


_KNOWN_AT = dt.datetime(1998, 1, 1, tzinfo=dt.timezone.utc)


@query("u7_relist_status", f"""WITH {_SIGHTINGS}, stored AS (SELECT listing_key, scrape_ts AS updated_at,
  CASE WHEN status_code = 404 THEN 'removed' ELSE 'active' END AS listing_status FROM log
  WHERE scrape_ts < TIMESTAMP '{_KNOWN_AT:%Y-%m-%d}'
  QUALIFY row_number() OVER (PARTITION BY listing_key ORDER BY scrape_ts DESC, event_id DESC) = 1),
again AS (SELECT listing_key, max(scrape_ts) AS back_at FROM relisted GROUP BY 1)
SELECT s.listing_key, CASE WHEN listing_status = 'removed' AND back_at > updated_at THEN 'relist' ELSE listing_status END
  AS listing_status, CASE WHEN listing_status = 'removed' AND back_at > updated_at THEN back_at ELSE updated_at END AS updated_at
FROM stored s LEFT JOIN again USING (listing_key)""")
def relist_status(spark, sf):
    """The listing table as known on a day, after all sightings: removed listings that came back are relists."""
    log = sightings(spark, sf)
    newest = latest_per_key(log.where(F.col("scrape_ts") < F.lit(_KNOWN_AT)), ["listing_key"], ["scrape_ts", "event_id"])
    stored = newest.select(
        "listing_key", F.when(F.col("status_code") == 404, "removed").otherwise("active").alias("listing_status"),
        F.col("scrape_ts").alias("updated_at"))
    return M.mark_relisted(stored, M.relists(log, RELIST_GAP))


_CHANGES = f"""WITH {_LOG}, p AS (SELECT *, lag(c) OVER w AS old_c, lag(scrape_ts) OVER w AS old_ts
  FROM log WHERE status_code = 200 WINDOW w AS (PARTITION BY listing_key ORDER BY scrape_ts, event_id)),
changes AS (SELECT listing_key, event_id, scrape_ts, old_c, old_ts, c FROM p
  WHERE old_c IS NULL OR old_c <> c)"""


@query("u8_price_history", f"""{_CHANGES}
SELECT listing_key, event_id, scrape_ts, old_c / 100.0 AS old_price, old_ts, c / 100.0 AS new_price FROM changes""")
def price_history(spark, sf):
    """Price history rebuilt from the snapshot log, one row per change."""
    return M.price_changes(A.snapshot_log(spark, sf))


@query("r5_price_drops_from_log", f"""{_CHANGES}
SELECT listing_key, event_id, old_c / 100.0 AS old_price, c / 100.0 AS new_price FROM changes
WHERE old_c > 0 AND c > 0 AND (old_c - c) * 100 >= 5 * old_c""")
def price_drops_from_log(spark, sf):
    from bandwise.operators.alerts import is_price_drop

    changes = M.price_changes(A.snapshot_log(spark, sf))
    return changes.where(is_price_drop(F.col("old_price"), F.col("new_price"))).select(
        "listing_key", "event_id", "old_price", "new_price")


@query("u9_promoted_comps", f"""WITH {O.LISTINGS}, {O.COMPS},
closed AS (SELECT source, source_url, id, cents / 100.0 AS final_price, listing_date AS sale_date FROM listings
  {_LATEST})
SELECT c.source_url, c.id, c.final_price, c.sale_date FROM closed c JOIN listings l ON l.id = c.id
WHERE l.listing_status = 'sold' AND NOT EXISTS (SELECT 1 FROM comps k
  WHERE k.source = c.source AND k.source_url = c.source_url)""")
def promoted_comps(spark, sf):
    """Sold listings that the comps do not hold yet."""
    latest = M.one_per_key(
        A.listings(spark, sf).select(
            "source", "source_url", "id", "created_at", "listing_status",
            F.col("asking_price").alias("final_price"), F.col("listing_date").alias("sale_date")),
        ["created_at", "id"])
    fresh = M.promote_closed(latest, A.comps(spark, sf))
    return fresh.select("source_url", "id", "final_price", "sale_date")


def _violations_sql(rules):
    items = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in rules)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), '; ')"


_YEAR_RULES = [("year missing", "year IS NULL"), ("year out of range", "year NOT BETWEEN 1965 AND 1998")]


@query("q1_quarantine", f"""{_NORMALIZED}, v AS (SELECT doc_id, {_violations_sql(_YEAR_RULES)} AS violations FROM scored)
SELECT doc_id, violations FROM v WHERE violations <> ''""")
def quarantine(spark, sf):
    """Normalized ads that the listing table would refuse, with the reasons."""
    _, bad = Q.split_by_rules(normalize_records(A.ads(spark, sf)), Q.listing_rules())
    return bad.select("doc_id", F.array_join("violations", "; ").alias("violations"))


@query("q1_valid_rows", f"""{_NORMALIZED}
SELECT source, count(*) AS valid FROM scored WHERE year BETWEEN 1965 AND 1998 GROUP BY 1""")
def valid_rows(spark, sf):
    good, _ = Q.split_by_rules(normalize_records(A.ads(spark, sf)), Q.listing_rules())
    return good.groupBy("source").agg(F.count("*").alias("valid"))


_COMP_RULES = [
    ("sale price missing", "sale_price IS NULL"), ("sale price not positive", "sale_price <= 0"),
    ("sale date missing", "sale_date IS NULL"),
    ("confidence out of range", "confidence_score NOT BETWEEN 0 AND 1"),
]


@query("q1_comp_constraints", f"""WITH {O.LISTINGS}, c AS (SELECT id,
  CASE WHEN listing_status IN ('sold', 'ended') THEN cents END AS sale_price,
  CASE WHEN listing_status = 'sold' THEN listing_date END AS sale_date,
  normalization_confidence AS confidence_score FROM listings),
v AS (SELECT id, {_violations_sql(_COMP_RULES)} AS violations FROM c)
SELECT id, violations FROM v WHERE violations <> ''""")
def comp_constraints(spark, sf):
    """Asks offered as comps that the comp table refuses: without a sale price or a sale date."""
    status = F.col("listing_status")
    offered = A.listings(spark, sf).select(
        "id", F.when(status.isin("sold", "ended"), F.col("asking_price")).alias("sale_price"),
        F.when(status == "sold", F.col("listing_date")).alias("sale_date"),
        F.col("normalization_confidence").alias("confidence_score"))
    _, bad = Q.split_by_rules(offered, Q.comp_rules())
    return bad.select("id", F.array_join("violations", "; ").alias("violations"))


_ENUM_RULES = [
    ("body_style unknown", f"lower(body_style_raw) NOT IN ({', '.join(map(lit, Q.S.BODY_STYLES))})"),
    ("drivetrain unknown", "drivetrain_raw NOT IN ('rwd', 'awd')"),
    ("seller_type unknown", "seller_type_raw NOT IN ('dealer', 'private', 'auction_house')"),
]


@query("q2_enum_violations", f"""WITH {ADS}, v AS (SELECT doc_id, {_violations_sql(_ENUM_RULES)} AS violations FROM ads)
SELECT doc_id, violations FROM v WHERE violations <> ''""")
def enum_violations(spark, sf):
    """Raw values outside their enumerations."""
    raw = A.ads(spark, sf).select(
        "doc_id", F.lower("body_style_raw").alias("body_style"),
        F.col("drivetrain_raw").alias("drivetrain"), F.col("seller_type_raw").alias("seller_type"))
    judged = Q.with_violations(raw, Q.enum_rules(raw)).where(F.size("violations") > 0)
    order = ["body_style unknown", "drivetrain unknown", "seller_type unknown"]
    kept = F.filter(F.array(*[F.lit(o) for o in order]), lambda o: F.array_contains("violations", o))
    return judged.select("doc_id", F.array_join(kept, "; ").alias("violations"))


_RUNS = """runs AS (SELECT ['bat','carsandbids','ebay','pcarmarket'][CAST(user_id % 4 AS INTEGER) + 1] AS source,
  CAST(ts AS DATE) AS run_day, count(*) AS pages_fetched, count(*) FILTER (WHERE event_type = 'error') AS errors
  FROM events GROUP BY ALL)"""


def daily_runs(spark, sf):
    """Run log by source and day from the event log."""
    return A.table(spark, sf, "events").groupBy(
        A.pick(A.SITES, F.col("user_id")).alias("source"), F.col("ts").cast("date").alias("run_day")
    ).agg(F.count("*").alias("pages_fetched"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("q4_error_spikes", f"""WITH {_RUNS}, r AS (SELECT *, round(errors / pages_fetched, 6) AS error_rate FROM runs),
t AS (SELECT *, round(avg(error_rate) OVER (PARTITION BY source ORDER BY run_day
  ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS usual_rate FROM r)
SELECT source, run_day, error_rate, usual_rate FROM t WHERE error_rate > usual_rate + 0.05""")
def error_spikes(spark, sf):
    return Q.error_spikes(daily_runs(spark, sf))


@query("a11_run_health", f"""WITH {_RUNS}
SELECT source, count(*) AS runs, max(run_day) AS last_run, CAST(sum(pages_fetched) AS BIGINT) AS pages_fetched,
  CAST(sum(errors) AS BIGINT) AS errors, max(errors) AS worst_errors FROM runs GROUP BY 1""")
def run_health(spark, sf):
    return Q.run_health(daily_runs(spark, sf))


_MODELS = "models(generation, a, b, name, trims, weight) AS (VALUES " + ", ".join(
    f"({lit(g)}, {a}, {b}, {lit(n)}, [{', '.join(map(lit, t))}], {w})"
    for g, a, b, n, t, _, w in L.CANONICAL_MODELS) + ")"


@query("j7_models_by_year", f"""WITH {_MODELS}
SELECT o_orderkey, year(o_orderdate) AS year, m.generation AS model_generation, name AS common_name
FROM orders LEFT JOIN models m ON year(o_orderdate) BETWEEN a AND b""")
def models_by_year(spark, sf):
    """Order years against the model ranges; 1994 belongs to two, later ones to none."""
    orders = A.table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    joined = L.with_models_by_year(orders, L.canonical_models(spark))
    return joined.select("o_orderkey", "year", "model_generation", "common_name")


@query("src6_seed_models", f"""WITH {_MODELS}, have AS (SELECT DISTINCT m.generation FROM orders
  JOIN models m ON year(o_orderdate) = a)
SELECT m.generation, a AS years_start, b AS years_end, name AS common_name, h.generation IS NULL AS seeded
FROM models m LEFT JOIN have h USING (generation)""")
def seed_models(spark, sf):
    """Idempotent seed: models already on file (those the order years start) stay as they are."""
    models = L.canonical_models(spark)
    years = A.table(spark, sf, "orders").select(F.year("o_orderdate").alias("years_start")).distinct()
    have = models.join(years, "years_start", "left_semi").withColumn("seeded", F.lit(False))
    done = L.seed_models(have, models.withColumn("seeded", F.lit(True)))
    return done.select("generation", "years_start", "years_end", "common_name", "seeded")


@query("j8_vin_duplicates", f"""WITH {O.LISTINGS}, f AS (SELECT id, vin,
  first_value(id) OVER (PARTITION BY vin ORDER BY created_at, id) AS possible_duplicate_id
  FROM listings WHERE vin IS NOT NULL) SELECT * FROM f WHERE id <> possible_duplicate_id""")
def vin_duplicates(spark, sf):
    return L.vin_duplicates(A.listings(spark, sf)).select("id", "vin", "possible_duplicate_id")


def _similar_sql(keys):
    same = " AND ".join(f"s.{k} = r.{k}" for k in keys)
    return f"""WITH {O.LISTINGS}, p AS (SELECT * FROM listings WHERE vin IS NULL)
    SELECT r.id, min(s.listing_date) AS duplicate_date FROM p r JOIN p s ON {same}
      AND abs(s.mileage - r.mileage) <= 500 AND s.listing_date BETWEEN r.listing_date - 60 AND r.listing_date
      AND (s.listing_date, s.mileage, s.id) < (r.listing_date, r.mileage, r.id)
    GROUP BY r.id"""


@query("j9_similar_duplicates", _similar_sql(L.DUPLICATE_KEYS))
def similar_duplicates(spark, sf):
    return L.similar_duplicates(A.listings(spark, sf)).select("id", "duplicate_date")


@query("j9_similar_duplicates_wide", _similar_sql(["transmission", "exterior_color_canonical"]))
def similar_duplicates_wide(spark, sf):
    """The same with two equal columns only: few, very large groups."""
    keys = ["transmission", "exterior_color_canonical"]
    return L.similar_duplicates(A.listings(spark, sf), keys).select("id", "duplicate_date")


@query("j10_known_trims", f"""WITH {ADS}, {_MODELS}
SELECT doc_id, trim_text AS trim, generation FROM ads JOIN models ON list_contains(trims, trim_text)
  AND year BETWEEN a AND b""")
def known_trims(spark, sf):
    """Ads whose trim is a known one of a model of their year."""
    models = L.canonical_models(spark)
    ads = A.ads(spark, sf).select("doc_id", "year", A.pick(A.TRIMS, F.col("doc_id")).alias("trim"))
    dated = L.with_models_by_year(ads, models).withColumnRenamed("model_generation", "generation")
    return L.with_known_trims(dated, models, "generation", "trim").select("doc_id", "trim", "generation")


@query("j11_bands_without_duplicates", f"""WITH {O.AS_OF}, {O.COMPS}, first_ AS (SELECT *, vin IS NOT NULL AND
  row_number() OVER (PARTITION BY vin ORDER BY sale_date, id) > 1 AS dup FROM comps)
SELECT generation || ':' || body_style || ':' || transmission AS cluster_key, count(*) AS comp_count,
  round(quantile_cont(CAST(sale_price AS DOUBLE), 0.5), 4) AS median_price
FROM first_, today WHERE NOT dup AND sale_date >= d - 180 GROUP BY 1""")
def bands_without_duplicates(spark, sf):
    """Bands over comps without those that repeat an older VIN."""
    comps = A.comps(spark, sf)
    unique = B.without_confirmed_duplicates(comps, L.vin_duplicates(comps))
    bands = B.single_window_bands(unique, as_of(spark, sf), 180)
    return bands.select("cluster_key", "comp_count", "median_price")


_RATES = """rates AS (SELECT ['USD','EUR','GBP'][CAST(o_custkey % 3 AS INTEGER) + 1] AS currency,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS rate_date,
  CAST(min(CAST(round(o_totalprice) AS BIGINT)) % 1000 + 9000 AS BIGINT) AS rate4 FROM orders
  GROUP BY ALL)"""


@query("j12_currency_asof", f"""WITH {O.COMPS}, {_RATES}
SELECT c.id, c.currency, CASE WHEN c.currency = 'USD' THEN 10000 ELSE rate4 END / 10000.0 AS used_rate,
  (c.cents * CASE WHEN c.currency = 'USD' THEN 10000 ELSE rate4 END + 5000) // 10000 / 100.0 AS sale_price_usd
FROM comps c ASOF LEFT JOIN rates r ON r.currency = c.currency AND r.rate_date <= c.sale_date""")
def currency_asof(spark, sf):
    """Sale prices converted at the monthly rate in force on the sale date; the rates come from
    the orders."""
    orders = A.table(spark, sf, "orders")
    rates = orders.groupBy(
        A.pick(("USD", "EUR", "GBP"), F.col("o_custkey")).alias("currency"),
        F.trunc("o_orderdate", "month").alias("rate_date"),
    ).agg(
        ((F.min(F.round("o_totalprice").cast("long")) % 1000 + 9000) / 10000)
        .cast("decimal(10,4)").alias("rate"))
    converted = L.convert_prices(A.comps(spark, sf), rates, as_of(spark, sf))
    return converted.select("id", "currency", "used_rate", "sale_price_usd")
