"""Alert rules, deduplication, status changes and digests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise import schemas as S
from bandwise.operators.search import DIGEST_SECTIONS, alerts_order

ALLOWED_TRANSITIONS = (("open", "read"), ("open", "dismissed"), ("read", "dismissed"))
BLOCKING = ("open", "read")
NOTIFIED_SEVERITIES = ("watch", "act")


def _present(value: Column) -> Column:
    """Neither null nor zero."""
    return F.coalesce(value != 0, F.lit(False))


def _money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value.cast("double"), 0))


def is_new(created_at: Column, as_of: dt.datetime, hours: int = S.NEW_LISTING_HOURS) -> Column:
    """Created within the last `hours`; text is parsed leniently, unparsable is not new."""
    moment = F.try_to_timestamp(created_at.cast("string"))
    return F.coalesce(moment >= F.lit(as_of - dt.timedelta(hours=hours)), F.lit(False))


def last_price(history: Column) -> Column:
    return F.try_element_at(history, F.lit(-1))["price"]


def is_price_drop(old: Column, new: Column, pct: float = S.PRICE_DROP_PCT) -> Column:
    """A fall of at least pct percent. Compared as decimals, so exactly pct percent counts."""
    old, new = old.cast("decimal(14,2)"), new.cast("decimal(14,2)")
    hit = (old > 0) & (old > new) & ((old - new) * 100 >= old * F.lit(pct).cast("decimal(6,2)"))
    return F.coalesce(hit & _present(new), F.lit(False))


def underpriced_severity(delta: Column, act_pct: float = S.ACT_PCT) -> Column:
    return F.when(delta <= act_pct, "act").otherwise("watch")


def _alert(alert_type: str, severity, reason: Column, delta: Column | None = None) -> Column:
    return F.struct(
        F.lit(alert_type).alias("alert_type"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        reason.alias("reason"),
        (F.lit(None) if delta is None else delta).cast("double").alias("delta_pct"),
    )


def candidate_alerts(
    view: DataFrame,
    as_of: dt.datetime,
    *,
    underpriced_pct: float = S.UNDERPRICED_PCT,
    act_pct: float = S.ACT_PCT,
    drop_pct: float = S.PRICE_DROP_PCT,
    max_age_days: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """All rules in one pass over the ask view: each row becomes zero or more alerts, with the columns to `carry`.

    The view carries id, source_url, listing_status, asking_price, delta_pct, median_price,
    insufficient_data, price_history and created_at. `max_age_days` limits the underpriced rule
    to young listings.
    """
    ask, url, delta = F.col("asking_price"), F.col("source_url"), F.col("delta_pct")
    dash = F.lit(" — ")
    thin = _present(ask) & F.coalesce(F.col("insufficient_data"), F.lit(False))
    cheap = ~thin & F.coalesce(delta <= underpriced_pct, F.lit(False))
    if max_age_days is not None:
        cheap = cheap & (F.col("created_at") > F.lit(as_of - dt.timedelta(days=max_age_days)))
    old = last_price(F.col("price_history"))
    old_d, ask_d = old.cast("double"), ask.cast("double")
    drop = (old_d - ask_d) / old_d * 100

    # fixed values: the wording of the reasons
    new_text = F.concat(F.lit("New listing: "), url)
    rules = [
        F.when(
            is_new(F.col("created_at"), as_of),
            _alert("new_listing", "info",
                   F.when(_present(ask), F.concat(new_text, dash, F.lit("asking "), _money(ask)))
                   .otherwise(new_text)),
        ),
        F.when(
            F.col("listing_status") == "relist",
            _alert("relist", "info", F.concat(F.lit("Relist detected: "), url)),
        ),
        F.when(
            thin,
            _alert("insufficient_data_warning", "info",
                   F.concat(F.lit("Cluster has too few comps to validate price of "),
                            _money(ask), dash, url)),
        ),
        F.when(
            cheap,
            _alert("underpriced", underpriced_severity(delta, act_pct),
                   F.concat(F.lit("Asking "), _money(ask), F.lit(" is "),
                            F.format_number(F.abs(delta), 1),
                            F.lit("% below cluster median "), _money(F.col("median_price")),
                            dash, url),
                   delta),
        ),
        F.when(
            is_price_drop(old, ask, drop_pct),
            _alert("price_drop", "watch",
                   F.concat(F.lit("Price dropped "), F.format_number(drop, 1), F.lit("% from "),
                            _money(old), F.lit(" → "), _money(ask), dash, url),
                   -drop),
        ),
    ]
    return view.select(
        F.col("id").alias("listing_id"),
        *carry,
        F.explode(F.array_compact(F.array(*rules))).alias("a"),
    ).select(
        F.sha2(F.concat_ws("\x1f", "a.alert_type", "listing_id", F.lit(as_of.isoformat())), 256)
        .alias("id"),
        "listing_id",
        "a.*",
        F.lit("open").alias("status"),
        F.lit(as_of).alias("triggered_at"),
        F.lit(None).cast("timestamp").alias("notified_at"),
        *carry,
    )


def _blocking(existing: DataFrame) -> DataFrame:
    return existing.where(F.col("status").isin(*BLOCKING)).select("alert_type", "listing_id")


def new_alerts(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates without an open or read alert of the same type and listing."""
    return candidates.join(_blocking(existing), ["alert_type", "listing_id"], "left_anti")


def skipped_alerts(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    return candidates.join(_blocking(existing), ["alert_type", "listing_id"], "left_semi")


def new_price_drops(candidates: DataFrame, existing: DataFrame, state: str) -> DataFrame:
    """Option: dedup by (type, listing, state) whatever the status, so a dismissed alert stays
    quiet until the underlying state (say, the last history time) changes."""
    seen = existing.select("alert_type", "listing_id", state).distinct()
    return candidates.join(seen, ["alert_type", "listing_id", state], "left_anti")


def run_counters(view: DataFrame, candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Checked, created and skipped of a run, one row per outcome."""
    blocked = _blocking(existing).distinct().withColumn("blocked", F.lit(True))
    outcome = candidates.join(blocked, ["alert_type", "listing_id"], "left").select(
        F.when(F.col("blocked"), "skipped_dedup").otherwise("created").alias("outcome")
    )
    checked = view.select(F.lit("checked").alias("outcome"))
    return outcome.unionByName(checked).groupBy("outcome").agg(F.count("*").alias("n"))


def apply_transitions(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested status changes (id, new_status) with a verdict each: applied, rejected or
    unknown alert. The allowed pairs are a fixed three-row set, so they fold into a predicate."""
    allowed = F.lit(False)
    for old, new in ALLOWED_TRANSITIONS:
        allowed = allowed | ((F.col("status") == old) & (F.col("new_status") == new))
    return (
        requests.join(alerts.select("id", "status"), "id", "left")
        .withColumn(
            "verdict",
            F.when(F.col("status").isNull(), "not found")
            .when(~F.col("new_status").isin(*S.ALERT_STATUSES), "invalid status")
            .when(allowed, "applied")
            .otherwise("rejected"),
        )
        .withColumn(
            "status_after",
            F.when(F.col("verdict") == "applied", F.col("new_status")).otherwise(F.col("status")),
        )
    )


def dismiss_all(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn(
        "dismissed_now", F.col("status").isin(*BLOCKING)
    ).withColumn("status", F.when(F.col("dismissed_now"), "dismissed").otherwise(F.col("status")))


def pending_notifications(alerts: DataFrame) -> DataFrame:
    return alerts.where(
        F.col("notified_at").isNull()
        & (F.col("status") == "open")
        & F.col("severity").isin(*NOTIFIED_SEVERITIES)
    )


def stamp_notified(alerts: DataFrame, moment: dt.datetime) -> DataFrame:
    """Stamp the whole unnotified open batch, informational alerts included."""
    batch = F.col("notified_at").isNull() & (F.col("status") == "open")
    return alerts.withColumn(
        "notified_at", F.when(batch, F.lit(moment)).otherwise(F.col("notified_at"))
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count_if(F.col("severity") == "act").alias("act_count"),
        F.count("*").alias("total"),
    )


def digest_subject(alerts: DataFrame, label: str = "Market watch") -> DataFrame:
    """One-row subject of a digest."""
    plural = F.when(F.col("act_count") > 1, "s").otherwise("")
    return severity_counts(alerts).select(
        F.when(
            F.col("act_count") > 0,
            F.concat(F.lit(f"🚨 {label} — "), F.col("act_count").cast("string"),
                     F.lit(" ACT alert"), plural, F.lit(" + "),
                     (F.col("total") - F.col("act_count")).cast("string"), F.lit(" more")),
        ).otherwise(
            F.concat(F.lit(f"{label} — "), F.col("total").cast("string"), F.lit(" new alert"),
                     F.when(F.col("total") > 1, "s").otherwise("")),
        ).alias("subject")
    )


def digest_line() -> Column:
    return F.concat(
        F.lit("["), F.upper("severity"), F.lit("] "), F.col("alert_type"), F.lit(": "),
        F.col("reason"),
    )


def digest_lines(alerts: DataFrame) -> DataFrame:
    """The body of a digest, one line per row in digest order. The sort is Spark's range
    partitioned one, and the lines go out through a text sink; no row holds the whole body."""
    return alerts.orderBy(*alerts_order()).select(digest_line().alias("line"))


def digest_sections(alerts: DataFrame, cap: int = DIGEST_SECTIONS) -> DataFrame:
    """The first `cap` alerts in digest order, numbered: a chat message holds no more."""
    top = alerts.orderBy(*alerts_order()).limit(cap)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*alerts_order())))


def with_open_alerts(listings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Listings with their non-dismissed alerts, one row per alert (null for none). A listing
    has at most one such alert per type."""
    live = alerts.where(F.col("status") != "dismissed").select(
        F.col("listing_id").alias("id"), "alert_type", "severity", "status"
    )
    return listings.join(live, "id", "left")


def nest_alerts(listings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Listings with an array of their non-dismissed alerts (at most one per alert type)."""
    per_listing = (
        alerts.where(F.col("status") != "dismissed")
        .groupBy(F.col("listing_id").alias("id"))
        .agg(F.sort_array(F.collect_set(F.struct("alert_type", "severity", "status"))).alias("alerts"))
    )
    return listings.join(per_listing, "id", "left")


def match_saved_criteria(listings: DataFrame, criteria: DataFrame, columns) -> DataFrame:
    """Listings against saved criteria, where a null criterion column accepts anything.

    Instead of a condition join over all pairs, each listing is repeated once per subset of the
    columns that some criterion names, with the others blanked, which makes it an equi-join.
    """
    blank = F.lit("*")
    named = [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)]
    masks = criteria.select(sum(named, F.lit(0)).alias("mask")).distinct()  # 2 ** len(columns) at most
    variants = [
        F.struct(*[
            (F.coalesce(F.col(c), F.lit("")) if row["mask"] >> i & 1 else blank).alias(c)
            for i, c in enumerate(columns)
        ])
        for row in masks.collect()
    ] or [F.struct(*[blank.alias(c) for c in columns])]
    expanded = listings.select(
        F.col("id").alias("listing_id"), F.explode(F.array(*variants)).alias("v")
    ).select("listing_id", *[F.col(f"v.{c}").alias(c) for c in columns])
    wanted = criteria.select(
        "criteria_id", *[F.coalesce(F.col(c), blank).alias(c) for c in columns]
    )
    return expanded.join(wanted, list(columns)).select("listing_id", "criteria_id")
