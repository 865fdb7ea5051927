"""Bands, their joins with listings, and the delta modes."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from bandwise import adapters
from bandwise.functions import deltas
from bandwise.operators import bands as B
from bandwise.operators.alerts import underpriced_severity
from bandwise.operators.enrich import ask_view, with_band, with_band_by_key
from bandwise.plans import oracle_sql as O
from bandwise.plans.registry import query
from bandwise.operators.histograms import DailyHistograms
from bandwise.schemas import CLUSTER_KEYS, THIN_WINDOW_DAYS
from bandwise.session import latest_date, run_folder


_newest: dict[tuple[str, str], dt.date] = {}


def as_of(spark, sf):
    """The newest day of the table, looked up once per session and folder."""
    run = (spark.sparkContext.applicationId, sf)
    if run not in _newest:
        _newest[run] = latest_date(adapters.table(spark, sf, "lineitem"), "l_shipdate")
    return _newest[run]


def current_bands(spark, sf, **options):
    return B.band_table(adapters.comps(spark, sf), as_of(spark, sf), **options)


_written: dict[tuple[str, str], str] = {}


def written_bands(spark, sf):
    """Today's band table as the nightly run leaves it: daily counts and bands are written once per
    session and folder, readers only read the bands."""
    run = (spark.sparkContext.applicationId, sf)
    if run not in _written:
        root, day = run_folder(spark, "bands"), as_of(spark, sf)
        counts = DailyHistograms(spark, f"{root}/counts")
        counts.add(adapters.comps(spark, sf), "first", since=day - dt.timedelta(days=THIN_WINDOW_DAYS))
        counts.bands(day).write.parquet(f"{root}/bands")
        _written[run] = f"{root}/bands"
    return spark.read.parquet(_written[run])


def _one_window_sql(days):
    return f"""WITH {O.AS_OF}, {O.COMPS},
    s AS ({O.band_stats('generation, body_style, transmission', 'comps', days=days)})
    SELECT generation || ':' || body_style || ':' || transmission AS cluster_key, generation,
      body_style, transmission, {days} AS window_days, n AS comp_count, round(p50, 4) AS median_price,
      round(p25, 4) AS p25_price, round(p75, 4) AS p75_price, lo / 100.0 AS min_price,
      hi / 100.0 AS max_price, round(CAST(c AS DOUBLE) / 100 / n, 6) AS avg_confidence,
      n < 5 AS insufficient_data, d AS computed_for FROM s, today"""


@query("a1_price_bands", _one_window_sql(90))
def price_bands(spark, sf):
    return B.single_window_bands(adapters.comps(spark, sf), as_of(spark, sf))


@query("a2_widened_bands", O.with_bands("SELECT * FROM bands"))
def widened_bands(spark, sf):
    return current_bands(spark, sf)


_A3 = O.with_bands("""
SELECT generation || ':' || body_style || ':' || transmission AS cluster_key, 180 AS window_days,
  n AS comp_count, round(p50, 4) AS median_price, n < 5 AS insufficient_data FROM wide w
WHERE NOT EXISTS (SELECT 1 FROM narrow n WHERE n.generation = w.generation
  AND n.body_style = w.body_style AND n.transmission = w.transmission AND n.n >= 5)
UNION ALL
SELECT cluster_key, window_days, comp_count, median_price, insufficient_data FROM bands
WHERE window_days = 90""")


@query("a3_wide_only_bands", _A3)
def wide_only_bands(spark, sf):
    """Bands with the commented intent: clusters seen only in the wide window are kept."""
    return current_bands(spark, sf, include_wide_only=True).select(
        "cluster_key", "window_days", "comp_count", "median_price", "insufficient_data"
    )


@query("a4_rebuild_summary", O.with_bands("""
SELECT count(*) AS total, count(*) AS updated,
  count(*) FILTER (WHERE insufficient_data) AS insufficient_data FROM bands"""))
def rebuild_summary(spark, sf):
    return B.band_summary(current_bands(spark, sf))


@query("a8_sufficiency_split", O.with_bands("""
SELECT insufficient_data, count(*) AS clusters, CAST(sum(comp_count) AS BIGINT) AS comps
FROM bands GROUP BY 1"""))
def sufficiency_split(spark, sf):
    return B.sufficiency_split(current_bands(spark, sf))


def _weighted_sql():
    return f"""WITH {O.AS_OF}, {O.COMPS},
    weighted AS (SELECT *, CASE WHEN year >= 1995 THEN 12 ELSE 10 END AS wt FROM comps),
    unit AS (SELECT w.*, unnest(range(CASE WHEN price_type = 'auction_final' THEN 2 * wt ELSE wt END))
             FROM weighted w, today WHERE sale_date >= d - 180),
    s AS (SELECT generation, body_style, transmission,
      quantile_cont(CAST(sale_price AS DOUBLE), 0.5) AS p50,
      quantile_cont(CAST(sale_price AS DOUBLE), 0.25) AS p25,
      quantile_cont(CAST(sale_price AS DOUBLE), 0.75) AS p75 FROM unit GROUP BY ALL),
    k AS (SELECT generation, body_style, transmission, count(*) AS n FROM comps, today
      WHERE sale_date >= d - 180 GROUP BY ALL)
    SELECT generation || ':' || body_style || ':' || transmission AS cluster_key,
      k.n AS comp_count, round(p50, 4) AS median_price, round(p25, 4) AS p25_price,
      round(p75, 4) AS p75_price FROM s JOIN k USING (generation, body_style, transmission)"""


@query("a9_weighted_bands", _weighted_sql())
def weighted_bands(spark, sf):
    """Percentiles where each comp counts by its model's weight, sales double against asks."""
    tenths = F.when(F.col("year") >= 1995, 12).otherwise(10)
    bands = B.band_table(
        adapters.comps(spark, sf), as_of(spark, sf), window_days=180, thin_window_days=180,
        weight=B.price_type_weight(tenths),
    )
    return bands.select("cluster_key", "comp_count", "median_price", "p25_price", "p75_price")


_A10 = f"""WITH {O.AS_OF}, {O.COMPS},
s AS ({O.band_stats('generation, body_style, transmission', 'comps',
                    where='conf100 >= 95', days=180)})
SELECT generation || ':' || body_style || ':' || transmission AS cluster_key, n AS comp_count,
  round(p50, 4) AS median_price FROM s"""


@query("a10_confidence_gated_bands", _A10)
def confidence_gated_bands(spark, sf):
    sure = adapters.comps(spark, sf).where(F.col("confidence_score") >= 0.95)
    bands = B.single_window_bands(sure, as_of(spark, sf), 180)
    return bands.select("cluster_key", "comp_count", "median_price")


def _rollup_sql():
    parts = []
    for n in range(3, -1, -1):
        names = ["generation", "body_style", "transmission"]
        cols = ", ".join(f"coalesce({k}, '*')" if i < n else "'*'" for i, k in enumerate(names))
        group = f"GROUP BY {', '.join(names[:n])}" if n else ""
        parts.append(f"""SELECT concat_ws(':', {cols}) AS cluster_key, count(*) AS comp_count,
          round(quantile_cont(CAST(sale_price AS DOUBLE), 0.5), 4) AS median_price,
          round(quantile_cont(CAST(sale_price AS DOUBLE), 0.25), 4) AS p25_price,
          round(quantile_cont(CAST(sale_price AS DOUBLE), 0.75), 4) AS p75_price
          FROM comps, today WHERE sale_date >= d - 180 {group}""")
    return f"WITH {O.AS_OF}, {O.COMPS} " + " UNION ALL ".join(parts)


@query("a12_rollup_bands", _rollup_sql())
def rollup_bands(spark, sf):
    """Bands of every coarser level too, for clusters that stay thin."""
    bands = B.band_table(
        adapters.comps(spark, sf), as_of(spark, sf), window_days=180, thin_window_days=180,
        levels=B.rollup_levels(),
    )
    return bands.select("cluster_key", "comp_count", "median_price", "p25_price", "p75_price")


@query("a13_outlier_sales", O.with_bands("""
SELECT c.id, c.cents / 100.0 AS sale_price,
  CASE WHEN c.cents / 100.0 < p25_price - (p75_price - p25_price) * 1.5 THEN 'low'
       WHEN c.cents / 100.0 > p75_price + (p75_price - p25_price) * 1.5 THEN 'high'
       WHEN p25_price IS NOT NULL THEN 'none' END AS outlier
FROM comps c LEFT JOIN bands b USING (generation, body_style, transmission), today
WHERE sale_date >= d - 180"""))
def outlier_sales(spark, sf):
    day = as_of(spark, sf)
    recent = adapters.comps(spark, sf).where(F.col("sale_date") >= F.date_sub(F.lit(day), 180))
    joined = with_band(recent, written_bands(spark, sf))
    return B.flag_outliers(joined, "sale_price").select("id", "sale_price", "outlier")


@query("a14_generation_medians", f"""WITH {O.COMPS}
SELECT generation, count(*) AS comp_count,
  round(quantile_cont(CAST(sale_price AS DOUBLE), 0.5), 4) AS median_price
FROM comps GROUP BY 1""")
def generation_medians(spark, sf):
    bands = B.single_window_bands_by(adapters.comps(spark, sf), as_of(spark, sf), ["generation"])
    return bands.select("generation", "comp_count", "median_price")


@query("u6_band_upsert", O.with_bands(f""",
old AS (SELECT generation || ':' || body_style || ':' || transmission AS cluster_key,
    n AS comp_count, round(p50, 4) AS median_price FROM (
    SELECT generation, body_style, transmission, count(*) AS n,
      quantile_cont(CAST(sale_price AS DOUBLE), 0.5) AS p50 FROM comps, today
    WHERE sale_date >= d - 365 - 90 AND sale_date <= d - 365 GROUP BY ALL))
SELECT cluster_key, comp_count, median_price, FALSE AS carried_over FROM bands
UNION ALL SELECT cluster_key, comp_count, median_price, TRUE FROM old
WHERE cluster_key NOT IN (SELECT cluster_key FROM bands)"""))
def band_upsert(spark, sf):
    """Today's bands over those of a year ago; keys not rebuilt today stay behind."""
    day = as_of(spark, sf)
    comps = adapters.comps(spark, sf)
    year_ago = day - dt.timedelta(days=365)
    before = B.single_window_bands(comps.where(F.col("sale_date") <= F.lit(year_ago)), year_ago)
    columns = ["cluster_key", "comp_count", "median_price"]
    return B.upsert_bands(before.select(*columns), current_bands(spark, sf).select(*columns))


def asks(spark, sf):
    return adapters.listings(spark, sf).where(F.col("listing_status").isin("active", "relist"))


def view(spark, sf, mode="alert_view"):
    """The ask view: active and relisted asks with band and delta."""
    return ask_view(asks(spark, sf), written_bands(spark, sf), mode)


_JOINED = "id, median_price, comp_count, insufficient_data"


@query("j1_band_join", O.with_alerts(f"SELECT {_JOINED} FROM askview"))
def band_join(spark, sf):
    return view(spark, sf).select("id", "median_price", "comp_count", "insufficient_data")


@query("j2_band_join_by_key", O.with_alerts("""
SELECT id, generation || ':' || body_style || ':' || transmission AS cluster_key, median_price,
  comp_count FROM askview"""))
def band_join_by_key(spark, sf):
    joined = with_band_by_key(asks(spark, sf), written_bands(spark, sf))
    return joined.select("id", "cluster_key", "median_price", "comp_count")


@query("j3_band_lookup", O.with_alerts("""
SELECT id, generation, body_style, transmission, p25_price, median_price, p75_price FROM askview
WHERE median_price IS NOT NULL"""))
def band_lookup(spark, sf):
    """Each listing's own cluster band, only where one exists."""
    joined = with_band(asks(spark, sf), written_bands(spark, sf))
    return joined.where(F.col("median_price").isNotNull()).select(
        "id", *CLUSTER_KEYS, "p25_price", "median_price", "p75_price"
    )


def _delta_query(mode):
    def run(spark, sf):
        return view(spark, sf, mode).select("id", "delta_pct")

    run.__name__ = f"delta_{mode}"
    run.__doc__ = f"Ask versus median, mode {mode}."
    return run


query("e1_delta_alert_view", O.with_alerts("SELECT id, delta_pct FROM askview"))(
    _delta_query("alert_view"))
query("e2_delta_ddl_view", O.with_alerts(
    "SELECT id, CASE WHEN median_price > 0 THEN delta_pct END AS delta_pct FROM askview"))(
    _delta_query("ddl_view"))


@query("e3_delta_read_view", O.with_alerts("""
SELECT id, CASE WHEN NOT insufficient_data AND median_price <> 0 THEN median_price END AS cluster_median,
  CASE WHEN NOT insufficient_data AND median_price <> 0 AND asking_price <> 0 THEN delta_pct END AS delta_pct
FROM askview"""))
def delta_read_view(spark, sf):
    """Ask versus median as reads show it: hidden while the band is insufficient."""
    return view(spark, sf, "api").select(
        "id",
        deltas.shown_median(F.col("median_price"), F.col("insufficient_data")).alias("cluster_median"),
        "delta_pct",
    )


@query("e4_delta_p25", O.with_alerts(f"""
SELECT id, CASE WHEN p25_price <> 0 THEN {O.pct('asking_price', 'p25_price')} END AS delta_p25_pct
FROM askview"""))
def delta_p25(spark, sf):
    return view(spark, sf).select(
        "id", deltas.pct_of(F.col("asking_price"), F.col("p25_price")).alias("delta_p25_pct")
    )


@query("e5_days_on_market", f"""WITH {O.AS_OF}, {O.LISTINGS}
SELECT id, CAST(date_diff('day', listing_date, d) AS INTEGER) AS days_on_market
FROM listings, today WHERE listing_status = 'active'""")
def days_on_market(spark, sf):
    active = adapters.listings(spark, sf).where(F.col("listing_status") == "active")
    return active.select(
        "id", deltas.days_on_market(as_of(spark, sf), F.col("listing_date")).alias("days_on_market")
    )


@query("e6_delta_buckets", O.with_alerts("""
SELECT CASE WHEN delta_pct IS NULL THEN 'no data' WHEN delta_pct <= -15 THEN 'deal'
  WHEN delta_pct < 0 THEN 'below' WHEN delta_pct > 15 THEN 'far above' ELSE 'above' END AS bucket,
  count(*) AS asks FROM askview GROUP BY 1"""))
def delta_buckets(spark, sf):
    bucket = deltas.delta_bucket(F.col("delta_pct")).alias("bucket")
    return view(spark, sf).groupBy(bucket).agg(F.count("*").alias("asks"))


def _position_sql(name):
    return (f"CASE WHEN p25_price <> 0 AND median_price <> 0 AND p75_price <> 0 AND min_price <> 0 "
            f"AND max_price <> 0 THEN CAST(round(CAST(({name} - CAST(min_price AS DOUBLE)) / "
            f"coalesce(nullif(CAST(max_price AS DOUBLE) - CAST(min_price AS DOUBLE), 0), 1) * 100 "
            f"AS DECIMAL(18,6)), 1) AS DOUBLE) END")


@query("e7_band_positions", O.with_bands(f"""
SELECT cluster_key, {_position_sql('p25_price')} AS p25_at, {_position_sql('median_price')} AS median_at,
  {_position_sql('p75_price')} AS p75_at FROM bands"""))
def band_positions(spark, sf):
    """Where p25, median and p75 lie between the cheapest and dearest comp, in percent."""
    p25, p50, p75 = F.col("p25_price"), F.col("median_price"), F.col("p75_price")
    low, high = F.col("min_price"), F.col("max_price")

    def at(v, name):
        return deltas.band_position(v, low, high, p25, p50, p75).alias(name)

    return current_bands(spark, sf).select(
        "cluster_key", at(p25, "p25_at"), at(p50, "median_at"), at(p75, "p75_at")
    )


@query("e8_relative_times", """
WITH now_ AS (SELECT date_trunc('hour', max(ts)) + INTERVAL 1 HOUR AS n FROM events),
a AS (SELECT event_id, CAST(floor(epoch(n)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS s
      FROM events, now_)
SELECT event_id, CASE WHEN s // 3600 < 1 THEN (s // 60) || 'm ago'
  WHEN s // 3600 < 24 THEN (s // 3600) || 'h ago' ELSE (s // 3600 // 24) || 'd ago' END AS age
FROM a""")
def relative_times(spark, sf):
    log = adapters.snapshot_log(spark, sf)
    newest = log.agg(F.max("scrape_ts").alias("m")).first()["m"]
    now = newest.replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=1)
    return log.select("event_id", deltas.relative_time(now, F.col("scrape_ts")).alias("age"))


@query("flagship_underpriced_asks", O.with_alerts("""
SELECT id, source_url, generation || ':' || body_style || ':' || transmission AS cluster_key,
  CAST(asking_price AS DOUBLE) AS asking_price, median_price, comp_count, delta_pct,
  CASE WHEN delta_pct <= -25 THEN 'act' ELSE 'watch' END AS severity
FROM askview WHERE NOT insufficient_data AND delta_pct <= -15"""))
def underpriced_asks(spark, sf):
    """Current asks at least 15 % below the median of recent comparable sales."""
    hits = view(spark, sf).where(~F.col("insufficient_data") & (F.col("delta_pct") <= -15.0))
    return hits.select(
        "id", "source_url", F.concat_ws(":", *CLUSTER_KEYS).alias("cluster_key"),
        F.col("asking_price").cast("double").alias("asking_price"), "median_price", "comp_count",
        "delta_pct", underpriced_severity(F.col("delta_pct")).alias("severity"),
    )


def _three_days_sql():
    parts, ctes = [], [O.COMPS]
    for back in (2, 1, 0):
        text = f"today AS (SELECT CAST(max(l_shipdate) AS DATE) - {back} AS d FROM lineitem), {O.BANDS}"
        text = text.replace("sale_date >= d", "sale_date <= d AND sale_date >= d")
        for name in ("today", "narrow", "wide", "bands"):
            text = re.sub(rf"\b{name}\b", f"{name}{back}", text)
        ctes.append(text)
        parts.append(f"SELECT * FROM bands{back}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query("u6_incremental_bands", _three_days_sql())
def incremental_bands(spark, sf):
    """Bands of three successive days. Each run counts the comps of its new day only; the counts of days
    that left the window are not read."""
    day, comps = as_of(spark, sf), adapters.comps(spark, sf)
    first = day - dt.timedelta(days=2)
    counts = DailyHistograms(spark, f"{run_folder(spark, 'daily')}/counts")
    counts.add(comps, "first", since=first - dt.timedelta(days=THIN_WINDOW_DAYS), until=first)
    tables = [counts.bands(first)]
    for back in (1, 0):
        new = day - dt.timedelta(days=back)
        counts.add(comps, f"{new}", since=new, until=new)
        tables.append(counts.bands(new))
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def _borrowed_sql():
    names = ["generation", "body_style", "transmission"]
    levels, choice = [], []
    for n, level in enumerate(B.LATTICE):
        cols = ", ".join(k if k in level else f"'*' AS {k}" for k in names)
        group = f"GROUP BY {', '.join(level)}" if level else ""
        levels.append(f"""SELECT {n} AS rank, '{'+'.join(level) or 'all'}' AS level, {cols}, count(*) AS n,
          quantile_cont(CAST(sale_price AS DOUBLE), 0.5) AS p50 FROM comps, today WHERE sale_date >= d - 90 {group} HAVING count(*) >= 5""")
        on = " AND ".join(f"l{n}.{k} = {'a.' + k if k in level else chr(39) + '*' + chr(39)}" for k in names)
        choice.append(f"LEFT JOIN levels l{n} ON l{n}.rank = {n} AND {on}")
    first = ", ".join(f"l{n}.level" for n in range(len(B.LATTICE)))
    size = " ".join(f"WHEN l{n}.level IS NOT NULL THEN l{n}.n" for n in range(len(B.LATTICE)))
    mid = " ".join(f"WHEN l{n}.level IS NOT NULL THEN l{n}.p50" for n in range(len(B.LATTICE)))
    return f"""WITH {O.AS_OF}, {O.COMPS}, {O.LISTINGS}, levels AS MATERIALIZED ({' UNION ALL '.join(levels)}),
    f AS (SELECT a.id, a.asking_price, coalesce({first}) AS level, CASE {size} END AS comp_count, CASE {mid} END AS p50
      FROM (SELECT * FROM listings WHERE listing_status IN ('active', 'relist')) a {' '.join(choice)})
    SELECT id, level, comp_count, round(p50, 4) AS median_price, {O.pct('asking_price', 'round(p50, 4)')} AS delta_pct FROM f"""


@query("a12_borrowed_bands", _borrowed_sql())
def borrowed(spark, sf):
    """Asks against the finest level with enough comps in 90 days: a thin cluster borrows from a coarser one."""
    bands = B.band_table(
        adapters.comps(spark, sf), as_of(spark, sf), thin_window_days=90, levels=[list(x) for x in B.LATTICE])
    found = B.borrowed_bands(asks(spark, sf), bands)
    delta = deltas.ask_vs_median(F.col("asking_price"), F.col("median_price"), F.lit(False), "alert_view")
    return found.select("id", "level", "comp_count", "median_price", delta.alias("delta_pct"))
