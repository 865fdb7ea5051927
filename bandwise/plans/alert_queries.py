"""Alert rules and what follows from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bandwise import adapters
from bandwise.operators import alerts as A
from bandwise.plans import oracle_sql as O
from bandwise.plans.band_queries import as_of, current_bands, view
from bandwise.plans.registry import query
from bandwise.schemas import CLUSTER_KEYS

ALERT = ["alert_type", "listing_id", "severity", "reason", "delta_pct"]
_ALERT = "alert_type, listing_id, severity, reason, delta_pct"


def now(spark, sf) -> dt.datetime:
    return dt.datetime.combine(as_of(spark, sf), dt.time(), dt.timezone.utc)


def candidates(spark, sf, asked=None):
    return A.candidate_alerts(asked or view(spark, sf), now(spark, sf))


def stored_alerts(spark, sf, asked=None):
    """Alerts on file: those of listings older than 30 days, with a status by confidence. A
    caller that has the ask view already passes it, so its bands are built once; what the status
    needs travels with the alert."""
    moment = now(spark, sf)
    old = F.col("created_at") < F.lit(moment - dt.timedelta(days=30))
    conf = F.col("normalization_confidence")
    made = A.candidate_alerts(
        (asked or view(spark, sf)).where(old), moment, carry=("normalization_confidence", "created_at"))
    return made.withColumn(
        "status", F.when(conf >= 0.97, "open").when(conf >= 0.94, "read").otherwise("dismissed"),
    ).withColumn("triggered_at", F.col("created_at")).drop("normalization_confidence", "created_at")


@query("r6_alert_rules", O.with_alerts(f"SELECT {_ALERT} FROM cand"))
def alert_rules(spark, sf):
    """Every rule in one pass, before deduplication, with the reason texts."""
    return candidates(spark, sf).select(*ALERT)


def _one_rule(name, alert_type):
    sql = O.with_alerts(
        f"SELECT listing_id, severity, delta_pct FROM cand WHERE alert_type = '{alert_type}'")

    def run(spark, sf):
        rows = candidates(spark, sf).where(F.col("alert_type") == alert_type)
        return rows.select("listing_id", "severity", "delta_pct")

    run.__name__ = name
    run.__doc__ = f"Only the {alert_type} rule."
    query(name, sql)(run)


_one_rule("r1_new_listings", "new_listing")
_one_rule("r2_relists", "relist")
_one_rule("r3_thin_cluster_warnings", "insufficient_data_warning")
_one_rule("r4_underpriced", "underpriced")
_one_rule("r5_price_drops", "price_drop")


@query("r5_new_price_drops", O.with_alerts("""
, drops AS (SELECT listing_id, c.delta_pct, CAST(l.ship_day - 7 AS VARCHAR) AS state, conf, c.created_at
  FROM cand c JOIN listings l ON l.id = c.listing_id WHERE alert_type = 'price_drop'),
told AS (SELECT listing_id, CASE WHEN conf >= 0.94 THEN state ELSE '2000-01-01' END AS state
  FROM drops, today WHERE created_at < CAST(d AS TIMESTAMP) - INTERVAL 30 DAY)
SELECT listing_id, state, delta_pct FROM drops ANTI JOIN told USING (listing_id, state)"""))
def new_price_drops(spark, sf):
    """Price drops whose state, the time of the last history entry, was not alerted yet: a dismissed alert stays quiet
    until the history grows. On file are old listings; those of low confidence were alerted for an earlier state."""
    moment = now(spark, sf)
    asked = view(spark, sf).withColumn("state", F.try_element_at("price_history", F.lit(-1))["ts"])
    drops = A.candidate_alerts(asked, moment, carry=("state", "normalization_confidence", "created_at")).where(
        F.col("alert_type") == "price_drop")
    told = drops.where(F.col("created_at") < F.lit(moment - dt.timedelta(days=30))).withColumn(
        "state", F.when(F.col("normalization_confidence") >= 0.94, F.col("state")).otherwise("2000-01-01"))
    return A.new_price_drops(drops, told, "state").select("listing_id", "state", "delta_pct")


@query("r7_reason_texts", O.with_alerts("""
SELECT alert_type, count(*) AS alerts, count(DISTINCT reason) AS texts,
  min(reason) AS first_text, max(reason) AS last_text FROM cand GROUP BY 1"""))
def reason_texts(spark, sf):
    return candidates(spark, sf).groupBy("alert_type").agg(
        F.count("*").alias("alerts"), F.countDistinct("reason").alias("texts"),
        F.min("reason").alias("first_text"), F.max("reason").alias("last_text"),
    )


_BLOCKING = ", blocking AS MATERIALIZED (SELECT DISTINCT alert_type, listing_id FROM stored WHERE status IN ('open', 'read'))"
_FRESH = O.with_alerts(f"{_BLOCKING} SELECT {_ALERT} FROM cand ANTI JOIN blocking USING (alert_type, listing_id)")


@query("r8_deduplicated_alerts", _FRESH)
def deduplicated_alerts(spark, sf):
    """Alerts that no open or read one of the same type and listing blocks."""
    asked = view(spark, sf)
    fresh = A.new_alerts(candidates(spark, sf, asked), stored_alerts(spark, sf, asked))
    return fresh.select(*ALERT)


@query("j5_blocked_alerts", O.with_alerts(
    f"{_BLOCKING} SELECT alert_type, listing_id FROM cand SEMI JOIN blocking USING (alert_type, listing_id)"))
def blocked_alerts(spark, sf):
    asked = view(spark, sf)
    blocked = A.skipped_alerts(candidates(spark, sf, asked), stored_alerts(spark, sf, asked))
    return blocked.select("alert_type", "listing_id")


@query("a6_alert_run_counters", O.with_alerts(f"""{_BLOCKING}
SELECT 'checked' AS outcome, count(*) AS n FROM askview
UNION ALL
SELECT CASE WHEN b.listing_id IS NOT NULL THEN 'skipped_dedup' ELSE 'created' END, count(*)
FROM cand LEFT JOIN blocking b USING (alert_type, listing_id) GROUP BY 1"""))
def alert_run_counters(spark, sf):
    asked = view(spark, sf)
    return A.run_counters(asked, candidates(spark, sf, asked), stored_alerts(spark, sf, asked))


@query("r9_status_transitions", O.with_alerts("""
, asked AS (SELECT alert_type, listing_id, status, CASE WHEN severity = 'act' THEN 'dismissed'
    WHEN alert_type = 'relist' THEN 'read' WHEN alert_type = 'price_drop' THEN 'closed'
    ELSE 'open' END AS new_status FROM stored),
judged AS (SELECT *, CASE WHEN new_status NOT IN ('open','read','dismissed') THEN 'invalid status'
    WHEN (status, new_status) IN (('open','read'),('open','dismissed'),('read','dismissed'))
    THEN 'applied' ELSE 'rejected' END AS verdict FROM asked)
SELECT status AS status_before, new_status, verdict,
  CASE WHEN verdict = 'applied' THEN new_status ELSE status END AS status_after, count(*) AS n
FROM judged GROUP BY ALL"""))
def status_transitions(spark, sf):
    alerts = stored_alerts(spark, sf)
    requests = alerts.select(
        "id",
        F.when(F.col("severity") == "act", "dismissed")
        .when(F.col("alert_type") == "relist", "read")
        .when(F.col("alert_type") == "price_drop", "closed")
        .otherwise("open").alias("new_status"),
    )
    return A.apply_transitions(alerts, requests).groupBy(
        F.col("status").alias("status_before"), "new_status", "verdict", "status_after"
    ).agg(F.count("*").alias("n"))


@query("r10_dismiss_all", O.with_alerts("""
SELECT status IN ('open', 'read') AS dismissed_now, 'dismissed' AS status, count(*) AS n
FROM stored GROUP BY 1"""))
def dismiss_all(spark, sf):
    done = A.dismiss_all(stored_alerts(spark, sf))
    return done.groupBy("dismissed_now", "status").agg(F.count("*").alias("n"))


@query("r11_pending_notifications", O.with_alerts("""
SELECT alert_type, listing_id, severity FROM stored
WHERE status = 'open' AND severity IN ('watch', 'act')"""))
def pending_notifications(spark, sf):
    pending = A.pending_notifications(stored_alerts(spark, sf))
    return pending.select("alert_type", "listing_id", "severity")


@query("a7_severity_counts", O.with_alerts("""
SELECT count(*) FILTER (WHERE severity = 'act') AS act_count, count(*) AS total FROM stored
WHERE status = 'open' AND severity IN ('watch', 'act')"""))
def severity_counts(spark, sf):
    return A.severity_counts(A.pending_notifications(stored_alerts(spark, sf)))


@query("r12_digest_subject", O.with_alerts("""
, k AS (SELECT count(*) FILTER (WHERE severity = 'act') AS a, count(*) AS t FROM stored
  WHERE status = 'open' AND severity IN ('watch', 'act'))
SELECT CASE WHEN a > 0 THEN '🚨 Market watch — ' || a || ' ACT alert' ||
    CASE WHEN a > 1 THEN 's' ELSE '' END || ' + ' || (t - a) || ' more'
  ELSE 'Market watch — ' || t || ' new alert' || CASE WHEN t > 1 THEN 's' ELSE '' END END AS subject
FROM k"""))
def digest_subject(spark, sf):
    return A.digest_subject(A.pending_notifications(stored_alerts(spark, sf)))


@query("r12_digest_lines", O.with_alerts("""
SELECT '[' || upper(severity) || '] ' || alert_type || ': ' || reason AS line FROM stored
WHERE status = 'open' AND severity IN ('watch', 'act')"""))
def digest_lines(spark, sf):
    return A.digest_lines(A.pending_notifications(stored_alerts(spark, sf)))


@query("t6_digest_sections", O.with_alerts("""
, p AS (SELECT *, sha256(concat_ws(chr(31), alert_type, listing_id,
    strftime(d, '%Y-%m-%d') || 'T00:00:00+00:00')) AS id FROM stored, today
  WHERE status = 'open' AND severity IN ('watch', 'act'))
SELECT '[' || upper(severity) || '] ' || alert_type || ': ' || reason AS line,
  row_number() OVER (ORDER BY CASE severity WHEN 'act' THEN 0 ELSE 1 END, triggered_at DESC, id)
  AS position FROM p QUALIFY position <= 47"""))
def digest_sections(spark, sf):
    sections = A.digest_sections(A.pending_notifications(stored_alerts(spark, sf)))
    return sections.select(A.digest_line().alias("line"), "position")


@query("r13_stamp_notified", O.with_alerts("""
SELECT status, status = 'open' AS stamped, count(*) AS n FROM stored GROUP BY 1"""))
def stamp_notified(spark, sf):
    stamped = A.stamp_notified(stored_alerts(spark, sf), now(spark, sf))
    return stamped.groupBy("status", F.col("notified_at").isNotNull().alias("stamped")).agg(
        F.count("*").alias("n"))


@query("r14_young_underpriced", O.with_alerts("""
SELECT listing_id, severity, delta_pct FROM cand, today WHERE alert_type = 'underpriced'
  AND created_at > CAST(d AS TIMESTAMP) - INTERVAL 3 DAY"""))
def young_underpriced(spark, sf):
    """The documented variant: underpriced only while the listing is younger than three days."""
    rows = A.candidate_alerts(view(spark, sf), now(spark, sf), max_age_days=3)
    return rows.where(F.col("alert_type") == "underpriced").select(
        "listing_id", "severity", "delta_pct"
    )


_CRITERIA = """
criteria AS (SELECT s_suppkey AS criteria_id,
  CASE WHEN s_nationkey % 2 = 0 THEN 'Brand#' || (s_suppkey % 25 + 1) END AS generation,
  CASE WHEN s_nationkey % 3 = 0 THEN 'PROMO' END AS body_style,
  CASE WHEN s_acctbal > 0 THEN 'R' END AS transmission FROM supplier)"""


@query("r14_saved_criteria", f"""WITH {O.AS_OF}, {O.LISTINGS}, {_CRITERIA}
SELECT l.id AS listing_id, c.criteria_id FROM listings l, today, criteria c
WHERE l.created_at >= CAST(d AS TIMESTAMP) - INTERVAL 7 DAY
  AND coalesce(c.generation = l.generation, TRUE) AND coalesce(c.body_style = l.body_style, TRUE)
  AND coalesce(c.transmission = l.transmission, TRUE)""")
def saved_criteria(spark, sf):
    """New listings of the last week against saved criteria (suppliers as the savers)."""
    criteria = adapters.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("criteria_id"),
        F.when(F.col("s_nationkey") % 2 == 0,
               F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")))
        .alias("generation"),
        F.when(F.col("s_nationkey") % 3 == 0, "PROMO").alias("body_style"),
        F.when(F.col("s_acctbal") > 0, "R").alias("transmission"),
    )
    week = F.lit(now(spark, sf) - dt.timedelta(days=7))
    recent = adapters.listings(spark, sf).where(F.col("created_at") >= week)
    return A.match_saved_criteria(recent, criteria, CLUSTER_KEYS)


@query("j4_listings_with_alerts", O.with_alerts("""
SELECT v.id, s.alert_type, s.severity, s.status FROM askview v
LEFT JOIN stored s ON s.listing_id = v.id AND s.status <> 'dismissed'"""))
def listings_with_alerts(spark, sf):
    asked = view(spark, sf)
    joined = A.with_open_alerts(asked, stored_alerts(spark, sf, asked))
    return joined.select("id", "alert_type", "severity", "status")


@query("j4_nested_alerts", O.with_alerts("""
SELECT v.id, string_agg(s.alert_type || '/' || s.severity || '/' || s.status, ' ' ORDER BY s.alert_type) AS alerts
FROM askview v LEFT JOIN stored s ON s.listing_id = v.id AND s.status <> 'dismissed' GROUP BY v.id"""))
def nested_alerts(spark, sf):
    """The same as the listing page shows it: one row per listing with its alerts nested, here written out."""
    asked = view(spark, sf)
    nested = A.nest_alerts(asked, stored_alerts(spark, sf, asked))
    texts = F.transform("alerts", lambda a: F.concat_ws("/", a["alert_type"], a["severity"], a["status"]))
    return nested.select("id", F.array_join(texts, " ").alias("alerts"))
