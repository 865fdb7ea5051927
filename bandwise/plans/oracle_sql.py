"""Common table expressions of the oracle: the same roles over the same tables in SQL."""

from __future__ import annotations

SHARED = """
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
  ['bat','carsandbids','ebay','pcarmarket'][(l_orderkey % 4) + 1] AS source,
  'https://market.example/item/' || l_orderkey || '-' || l_linenumber AS source_url,
  CAST(l_orderkey % 34 + 1965 AS INTEGER) AS year,
  p_brand AS generation, p_type AS body_style, l_returnflag AS transmission,
  split_part(p_name, ' ', 1) AS exterior_color_canonical,
  CAST(CAST(l_quantity AS INTEGER) * 2000 + l_suppkey % 700 AS INTEGER) AS mileage,
  ['USD','EUR','GBP'][(l_orderkey % 3) + 1] AS currency,
  CASE WHEN l_linenumber <= 3 THEN 'WP0ZZZ' || lpad(CAST(l_partkey AS VARCHAR), 11, '0') END AS vin,
  CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS cents,
  CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(l_shipdate AS DATE) AS ship_day,
  CAST(round((1 - l_discount) * 100) AS BIGINT) AS conf100, round(p_retailprice, 2) AS old_price
"""

COMPS = f"""
comps AS MATERIALIZED (SELECT *, cents / 100.0 AS sale_price, ship_day AS sale_date,
  CASE WHEN tax < 6 THEN 'auction_final' WHEN tax = 6 THEN 'dealer_ask'
       WHEN tax = 7 THEN 'private_ask' ELSE 'estimate' END AS price_type,
  conf100 / 100.0 AS confidence_score
  FROM (SELECT {SHARED} FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F'))
"""

LISTINGS = f"""
listings AS MATERIALIZED (SELECT *, cents / 100.0 AS asking_price, ship_day AS listing_date,
  CASE WHEN tax = 0 THEN 'removed' WHEN tax = 1 THEN 'ended' WHEN tax = 2 THEN 'sold'
       WHEN tax = 3 THEN 'relist' ELSE 'active' END AS listing_status,
  conf100 / 100.0 AS normalization_confidence, CAST(ship_day AS TIMESTAMP) AS created_at
  FROM (SELECT {SHARED} FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O'))
"""

AS_OF = "today AS (SELECT CAST(max(l_shipdate) AS DATE) AS d FROM lineitem)"


def band_stats(keys: str, source: str, where: str = "TRUE", days: int = 180) -> str:
    """Single-window statistics, the textbook way."""
    return f"""SELECT {keys}, count(*) AS n, quantile_cont(CAST(sale_price AS DOUBLE), 0.5) AS p50,
      quantile_cont(CAST(sale_price AS DOUBLE), 0.25) AS p25,
      quantile_cont(CAST(sale_price AS DOUBLE), 0.75) AS p75,
      min(cents) AS lo, max(cents) AS hi, sum(conf100) AS c
      FROM {source}, today WHERE sale_date >= d - {days} AND {where} GROUP BY {keys}"""


BANDS = f"""
narrow AS ({band_stats('generation, body_style, transmission', 'comps', days=90)}),
wide AS ({band_stats('generation, body_style, transmission', 'comps', days=180)}),
bands AS MATERIALIZED (SELECT s.generation || ':' || s.body_style || ':' || s.transmission AS cluster_key,
    s.generation, s.body_style, s.transmission, s.window_days, s.n AS comp_count,
    round(s.p50, 4) AS median_price, round(s.p25, 4) AS p25_price, round(s.p75, 4) AS p75_price,
    s.lo / 100.0 AS min_price, s.hi / 100.0 AS max_price,
    round(CAST(s.c AS DOUBLE) / 100 / s.n, 6) AS avg_confidence,
    s.n < 5 AS insufficient_data, today.d AS computed_for
  FROM (SELECT n.*, 90 AS window_days FROM narrow n WHERE n.n >= 5
        UNION ALL
        SELECT w.*, 180 AS window_days FROM wide w
        JOIN narrow n USING (generation, body_style, transmission) WHERE n.n < 5) s, today)
"""


def with_bands(body: str) -> str:
    return f"WITH {AS_OF}, {COMPS}, {BANDS} {body}"


def with_listings(body: str) -> str:
    return f"WITH {AS_OF}, {LISTINGS} {body}"


def with_all(body: str) -> str:
    return f"WITH {AS_OF}, {COMPS}, {LISTINGS}, {BANDS} {body}"


MONEY = "('$' || format('{:,}', CAST(round_even(CAST(%s AS DOUBLE), 0) AS BIGINT)))"


def money(expr: str) -> str:
    return MONEY % expr


def pct(value: str, base: str) -> str:
    v, b = f"CAST({value} AS DOUBLE)", f"CAST({base} AS DOUBLE)"
    return f"CAST(round(CAST(({v} - {b}) / {b} * 100 AS DECIMAL(18,6)), 1) AS DOUBLE)"


VIEW = f"""
askview AS MATERIALIZED (SELECT l.*, b.median_price, b.p25_price, b.p75_price, b.min_price, b.max_price,
    b.comp_count, b.insufficient_data,
    CASE WHEN b.median_price <> 0 THEN {pct('l.asking_price', 'b.median_price')} END AS delta_pct
  FROM listings l LEFT JOIN bands b USING (generation, body_style, transmission)
  WHERE l.listing_status IN ('active', 'relist'))
"""

CANDIDATES = f"""
cand AS MATERIALIZED (
  SELECT id AS listing_id, 'new_listing' AS alert_type, 'info' AS severity,
    'New listing: ' || source_url || ' — asking ' || {money('asking_price')} AS reason,
    CAST(NULL AS DOUBLE) AS delta_pct, normalization_confidence AS conf, created_at
  FROM askview, today WHERE created_at >= CAST(d AS TIMESTAMP) - INTERVAL 24 HOUR
  UNION ALL
  SELECT id, 'relist', 'info', 'Relist detected: ' || source_url, NULL,
    normalization_confidence, created_at FROM askview WHERE listing_status = 'relist'
  UNION ALL
  SELECT id, 'insufficient_data_warning', 'info',
    'Cluster has too few comps to validate price of ' || {money('asking_price')} || ' — ' || source_url,
    NULL, normalization_confidence, created_at FROM askview WHERE insufficient_data
  UNION ALL
  SELECT id, 'underpriced', CASE WHEN delta_pct <= -25 THEN 'act' ELSE 'watch' END,
    'Asking ' || {money('asking_price')} || ' is ' || format('{{:.1f}}', abs(delta_pct)) ||
    '% below cluster median ' || {money('median_price')} || ' — ' || source_url,
    delta_pct, normalization_confidence, created_at
  FROM askview WHERE NOT coalesce(insufficient_data, FALSE) AND delta_pct <= -15
  UNION ALL
  SELECT id, 'price_drop', 'watch',
    'Price dropped ' || format('{{:.1f}}', (old_price - cents / 100.0::DOUBLE) / old_price * 100) ||
    '% from ' || {money('old_price')} || ' → ' || {money('asking_price')} || ' — ' || source_url,
    -((old_price - CAST(asking_price AS DOUBLE)) / old_price * 100), normalization_confidence, created_at
  FROM askview
  WHERE (CAST(round(old_price * 100) AS BIGINT) - cents) * 100 >= 5 * CAST(round(old_price * 100) AS BIGINT)
),
stored AS MATERIALIZED (SELECT listing_id, alert_type, severity, reason, delta_pct,
    CASE WHEN conf >= 0.97 THEN 'open' WHEN conf >= 0.94 THEN 'read' ELSE 'dismissed' END AS status,
    created_at AS triggered_at
  FROM cand, today WHERE created_at < CAST(d AS TIMESTAMP) - INTERVAL 30 DAY)
"""


def with_alerts(body: str) -> str:
    return with_all("").rstrip() + f", {VIEW}, {CANDIDATES} {body}"
