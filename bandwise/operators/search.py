"""Filtered, ordered and paged reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise import schemas as S

MAX_PAGE = 200
DIGEST_SECTIONS = 47

DOMAINS: Mapping[str, tuple[str, ...]] = {
    "listing_status": S.LISTING_STATUSES,
    "generation": S.GENERATIONS,
    "body_style": S.BODY_STYLES,
    "transmission": S.TRANSMISSIONS,
    "source": S.SOURCES,
    "price_type": S.PRICE_TYPES,
    "status": S.ALERT_STATUSES,
    "severity": S.SEVERITIES,
    "alert_type": S.ALERT_TYPES,
}


def _equal(df: DataFrame, wanted: Mapping[str, str | None], domains) -> DataFrame:
    """Equality filters; an empty value means no filter, an unknown one is refused."""
    for column, value in wanted.items():
        if not value:
            continue
        domain = domains.get(column)
        if domain is not None and value not in domain:
            raise ValueError(f"Invalid {column} {value!r}")
        df = df.where(F.col(column) == value)
    return df


def _between(df: DataFrame, column: str, low, high) -> DataFrame:
    if low is not None:
        df = df.where(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(column) <= F.lit(high))
    return df


def search_listings(
    df: DataFrame,
    *,
    status: str | None = "active",
    generation=None, body_style=None, transmission=None, source=None,
    year_min=None, year_max=None, price_min=None, price_max=None,
    max_mileage=None, min_confidence=None, underpriced_only: bool = False,
    domains: Mapping[str, tuple[str, ...]] = DOMAINS,
) -> DataFrame:
    """Listing search. Ranges are inclusive and a null never passes one."""
    df = _equal(
        df,
        {"listing_status": status, "generation": generation, "body_style": body_style,
         "transmission": transmission, "source": source},
        domains,
    )
    df = _between(df, "year", year_min, year_max)
    df = _between(df, "asking_price", price_min, price_max)
    df = _between(df, "mileage", None, max_mileage)
    df = _between(df, "normalization_confidence", min_confidence, None)
    if underpriced_only:
        df = df.where(F.col("delta_pct") <= -10)
    return df


def search_comps(
    df: DataFrame,
    *,
    generation=None, body_style=None, transmission=None, source=None, price_type=None,
    sold_from=None, sold_to=None, price_min=None, price_max=None, min_confidence=None,
    domains: Mapping[str, tuple[str, ...]] = DOMAINS,
) -> DataFrame:
    df = _equal(
        df,
        {"generation": generation, "body_style": body_style, "transmission": transmission,
         "source": source, "price_type": price_type},
        domains,
    )
    df = _between(df, "sale_date", sold_from, sold_to)
    df = _between(df, "sale_price", price_min, price_max)
    return _between(df, "confidence_score", min_confidence, None)


def list_bands(
    bands: DataFrame,
    *,
    generation=None, body_style=None, transmission=None, insufficient: bool | None = None,
    domains: Mapping[str, tuple[str, ...]] = DOMAINS,
) -> DataFrame:
    bands = _equal(
        bands,
        {"generation": generation, "body_style": body_style, "transmission": transmission},
        domains,
    )
    if insufficient is not None:
        bands = bands.where(F.col("insufficient_data") == insufficient)
    return bands


def search_alerts(
    alerts: DataFrame,
    *,
    status: str | None = "open", severity=None, alert_type=None, listing_id=None,
    domains: Mapping[str, tuple[str, ...]] = DOMAINS,
) -> DataFrame:
    alerts = _equal(
        alerts, {"status": status, "severity": severity, "alert_type": alert_type}, domains
    )
    return alerts if listing_id is None else alerts.where(F.col("listing_id") == listing_id)


def by_id(df: DataFrame, value: str, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == value)


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page; every task keeps only its own best offset+limit rows."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1-{MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def listings_order() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").asc()]


def comps_order() -> list[Column]:
    return [F.col("sale_date").desc_nulls_last(), F.col("created_at").desc(), F.col("id").asc()]


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "act", 0).when(severity == "watch", 1).when(severity == "info", 2)
        .otherwise(9)
    )


def alerts_order() -> list[Column]:
    """Digest order: act first, then watch, then info; newest first within a tier."""
    return [
        severity_rank(F.col("severity")).asc(), F.col("triggered_at").desc_nulls_last(),
        F.col("id").asc(),
    ]


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def ranked_by_steps(df: DataFrame, keys, steps, order: list[Column], name: str) -> DataFrame:
    """Add `name`: the place of each row, from 1, within `keys` by the columns `steps` and then `order`.

    Counts per (keys, steps), combined before their shuffle, give each step its first place; only the rows
    of one step are ordered together, so a hot key is spread over its steps.
    """
    counts = df.groupBy(*keys, *steps).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(*steps).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        *[F.col(c).alias(f"_f{c}") for c in (*keys, *steps)],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy(*keys, *steps).orderBy(*order)
    placed = df.withColumn("_row", F.row_number().over(within))
    on = F.lit(True)
    for c in (*keys, *steps):
        on = on & placed[c].eqNullSafe(firsts[f"_f{c}"])
    return placed.join(firsts, on).withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop(
        "_row", "_before", *[f"_f{c}" for c in (*keys, *steps)])


def cheapest_in_cluster(view: DataFrame, keys) -> DataFrame:
    """All asks of each cluster ranked from the cheapest, relative to the cluster's median."""
    known = view.where(F.col("delta_pct").isNotNull())
    return ranked_by_steps(known, list(keys), ["delta_pct"], [F.col("id").asc()], "cheapness_rank")
