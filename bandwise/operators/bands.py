"""Exact percentile price bands per cluster, with widening of thin clusters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.schemas import CLUSTER_KEYS, MIN_CLUSTER_SIZE, THIN_WINDOW_DAYS, WINDOW_DAYS

# Cents per coarse bucket = 2**BUCKET_BITS; bounds the rows of one (cluster, bucket).
BUCKET_BITS = 14
QUANTILES = {"p25_price": 0.25, "median_price": 0.50, "p75_price": 0.75}


def _price_histogram(
    comps: DataFrame,
    keys: Sequence[str],
    narrow_from: dt.date,
    wide_from: dt.date,
    weight: Column | None,
    price: str,
) -> DataFrame:
    usable = F.col("sale_date") >= F.lit(wide_from)
    for key in keys:
        usable = usable & F.col(key).isNotNull()
    rows = comps.where(usable & F.col(price).isNotNull()).select(
        *keys,
        F.round(F.col(price).cast("decimal(18,4)") * 100).cast("long").alias("cents"),
        (F.col("sale_date") >= F.lit(narrow_from)).alias("narrow"),
        F.col("confidence_score").cast("decimal(6,4)").alias("conf"),
        (F.lit(1) if weight is None else weight).cast("long").alias("weight"),
    )

    def total(value, name):
        return F.coalesce(F.sum(value), F.lit(0)).alias(name)

    hist = rows.groupBy(*keys, "cents").agg(
        F.count_if("narrow").alias("rows_narrow"),
        F.count("*").alias("rows_wide"),
        total(F.when(F.col("narrow"), F.col("weight")), "weight_narrow"),
        total(F.col("weight"), "weight_wide"),
        total(F.when(F.col("narrow"), F.col("conf")), "conf_narrow"),
        total(F.col("conf"), "conf_wide"),
        F.count(F.when(F.col("narrow"), F.col("conf"))).alias("nconf_narrow"),
        F.count("conf").alias("nconf_wide"),
    )
    # Always true. It names every measure, so both uses of the histogram keep the same columns
    # and Spark reads and shuffles the comps once (ReusedExchange in the plan).
    measures = [c for c in hist.columns if c not in (*keys, "cents")]
    touched = sum((F.abs(F.col(c)) for c in measures[1:]), F.abs(F.col(measures[0])))
    return hist.where(touched >= 0)


def _chosen(name: str) -> Column:
    return F.when(F.col("use_wide"), F.col(f"{name}_wide")).otherwise(F.col(f"{name}_narrow"))


def band_table(
    comps: DataFrame,
    as_of: dt.date,
    *,
    window_days: int = WINDOW_DAYS,
    thin_window_days: int = THIN_WINDOW_DAYS,
    min_size: int = MIN_CLUSTER_SIZE,
    keys: Sequence[str] = CLUSTER_KEYS,
    include_wide_only: bool = False,
    weight: Column | None = None,
    levels: Sequence[Sequence[str]] | None = None,
    price: str = "sale_price",
) -> DataFrame:
    """Price bands over the comps of the last `window_days`; a cluster with fewer than
    `min_size` of them takes the `thin_window_days` window instead.

    Percentiles are exact (linear interpolation) and no task ever holds a whole cluster. Prices
    are whole cents, so comps first shrink to counts per (cluster, price); those are counted
    per coarse price bucket; the running bucket totals of a cluster say which buckets hold the
    wanted ranks; and only these few buckets are ranked price by price.

    `levels` (lists of keys) adds coarser groupings; a key left out of a level reads '*'.
    """
    narrow_from = as_of - dt.timedelta(days=window_days)
    wide_from = as_of - dt.timedelta(days=max(window_days, thin_window_days))
    return bands_of_histogram(
        _price_histogram(comps, keys, narrow_from, wide_from, weight, price), as_of,
        window_days=window_days, thin_window_days=thin_window_days, min_size=min_size, keys=keys,
        include_wide_only=include_wide_only, levels=levels,
    )


def bands_of_histogram(
    hist: DataFrame,
    as_of: dt.date,
    *,
    window_days: int = WINDOW_DAYS,
    thin_window_days: int = THIN_WINDOW_DAYS,
    min_size: int = MIN_CLUSTER_SIZE,
    keys: Sequence[str] = CLUSTER_KEYS,
    include_wide_only: bool = False,
    levels: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """The band table from counts per (cluster, cents): rows, weight, conf and nconf of the narrow
    and the wide window, one row per cluster and price."""
    measures = [c for c in hist.columns if c not in (*keys, "cents")]
    if levels is not None:
        sets = [[F.col(k) for k in level] + [F.col("cents")] for level in levels]
        hist = (
            hist.groupingSets(sets, *[F.col(k) for k in keys], F.col("cents"))
            .agg(*[F.sum(m).alias(m) for m in measures])
            .select(*[F.coalesce(F.col(k), F.lit("*")).alias(k) for k in keys], "cents", *measures)
        )
    hist = hist.withColumn("bucket", F.shiftright("cents", BUCKET_BITS))
    # the join below would add this filter to one of the two uses only
    hist = hist.where(F.col("bucket").isNotNull())

    buckets = hist.groupBy(*keys, "bucket").agg(
        *[F.sum(m).alias(m) for m in measures],
        F.min(F.when(F.col("rows_narrow") > 0, F.col("cents"))).alias("min_narrow"),
        F.max(F.when(F.col("rows_narrow") > 0, F.col("cents"))).alias("max_narrow"),
        F.min("cents").alias("min_wide"),
        F.max("cents").alias("max_wide"),
    )
    cluster = Window.partitionBy(*keys)
    earlier = cluster.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    folds = {"rows": F.sum, "weight": F.sum, "conf": F.sum, "nconf": F.sum,
             "min": F.min, "max": F.max}
    sides = ("narrow", "wide")
    totals = buckets.select(
        *keys,
        "bucket",
        *[f"weight_{side}" for side in sides],
        *[fn(f"{name}_{side}").over(cluster).alias(f"{name}_total_{side}")
          for name, fn in folds.items() for side in sides],
        *[F.coalesce(F.sum(f"weight_{side}").over(earlier), F.lit(0)).alias(f"before_{side}")
          for side in sides],
    )
    totals = totals.withColumn("use_wide", F.col("rows_total_narrow") < min_size)
    totals = totals.select(
        *keys,
        "bucket",
        "use_wide",
        F.col("rows_total_narrow").alias("narrow_total"),
        _chosen("weight").alias("w"),
        _chosen("before").alias("before"),
        *[_chosen(f"{name}_total").alias(f"{name}_total") for name in folds],
    )
    if not include_wide_only:
        totals = totals.where(F.col("narrow_total") > 0)

    position = {n: F.lit(p) * (F.col("weight_total") - 1) for n, p in QUANTILES.items()}
    ranks = []
    for pos in position.values():
        ranks += [F.floor(pos), F.ceil(pos)]
    totals = totals.withColumn("ranks", F.array_distinct(F.array(*ranks)))
    carried = ["use_wide", "rows_total", "weight_total", "conf_total", "nconf_total",
               "min_total", "max_total"]
    wanted = (
        totals.withColumn(
            "hits",
            F.filter(
                "ranks",
                lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("w")),
            ),
        )
        .where(F.size("hits") > 0)
        .select(*keys, "bucket", "before", "hits", *carried)
    )

    within = Window.partitionBy(*keys, "bucket").orderBy("cents")
    ranked = (
        hist.join(wanted, [*keys, "bucket"])
        .withColumn("w", _chosen("weight"))
        .withColumn(
            "start",
            F.col("before")
            + F.sum("w").over(within.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("w"),
        )
        .withColumn(
            "rank",
            F.explode(
                F.filter(
                    "hits",
                    lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("w")),
                )
            ),
        )
    )
    at_rank = []
    for name, pos in position.items():
        at_rank += [
            F.max(F.when(F.col("rank") == F.floor(pos), F.col("cents"))).alias(f"{name}_lo"),
            F.max(F.when(F.col("rank") == F.ceil(pos), F.col("cents"))).alias(f"{name}_hi"),
        ]
    bands = ranked.groupBy(*keys, *carried).agg(*at_rank)

    def interpolated(name):
        share = position[name] - F.floor(position[name])
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return F.round((lo + (hi - lo) * share) / 100, 4).alias(name)

    return bands.select(
        F.concat_ws(":", *keys).alias("cluster_key"),
        *keys,
        F.when(F.col("use_wide"), thin_window_days).otherwise(window_days).alias("window_days"),
        F.col("rows_total").alias("comp_count"),
        *[interpolated(n) for n in ("median_price", "p25_price", "p75_price")],
        (F.col("min_total") / 100).alias("min_price"),
        (F.col("max_total") / 100).alias("max_price"),
        F.round(F.col("conf_total").cast("double") / F.col("nconf_total"), 6).alias("avg_confidence"),
        (F.col("rows_total") < min_size).alias("insufficient_data"),
        F.lit(as_of).alias("computed_for"),
    )


def single_window_bands(comps: DataFrame, as_of: dt.date, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Bands over one window only."""
    return band_table(comps, as_of, window_days=window_days, thin_window_days=window_days)


def single_window_bands_by(
    comps: DataFrame, as_of: dt.date, keys: Sequence[str], window_days: int = 36_500
) -> DataFrame:
    """Bands per other keys, by default over all history."""
    return band_table(
        comps, as_of, window_days=window_days, thin_window_days=window_days, keys=keys
    )


#: Where a thin cluster may borrow from, finest first.
LATTICE = (CLUSTER_KEYS, CLUSTER_KEYS[:2], (CLUSTER_KEYS[0], CLUSTER_KEYS[2]), CLUSTER_KEYS[:1], ())


def borrowed_bands(
    asks: DataFrame, bands: DataFrame, lattice: Sequence[Sequence[str]] = LATTICE,
    keys: Sequence[str] = CLUSTER_KEYS,
) -> DataFrame:
    """Asks with the finest band of the lattice that has enough comps, and the level it comes from.

    `bands` holds every level of the lattice (a key left out reads '*'). The level is settled once
    per cluster: its ancestors, one row per level, meet the sufficient bands in an equi-join, and
    the finest match wins; the asks then join on their own cluster. A key that is null is in no
    level that names it. An ask without any sufficient ancestor keeps nulls.
    """
    picked = ["level", "band_key", "comp_count", "median_price", "p25_price", "p75_price"]
    clusters = asks.select(*keys).distinct()
    ancestors = F.array(*[
        F.struct(
            F.lit(n).alias("rank"), F.lit("+".join(level) or "all").alias("level"),
            F.concat_ws(":", *[F.col(k) if k in level else F.lit("*") for k in keys]).alias("band_key"),
            _named(level).alias("named"),
        )
        for n, level in enumerate(lattice)
    ])
    wanted = clusters.select(*keys, F.explode(ancestors).alias("a")).select(*keys, "a.*").where("named")
    enough = bands.where(~F.col("insufficient_data")).select(
        F.col("cluster_key").alias("band_key"), "comp_count", "median_price", "p25_price", "p75_price")
    found = wanted.join(enough, "band_key").groupBy(*keys).agg(
        F.min_by(F.struct(*picked), "rank").alias("b"))
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "b.*")
    same = F.lit(True)
    for k in keys:
        same = same & asks[k].eqNullSafe(found[f"_{k}"])
    return asks.join(found, same, "left").drop(*[f"_{k}" for k in keys])


def _named(level: Sequence[str]) -> Column:
    named = F.lit(True)
    for k in level:
        named = named & F.col(k).isNotNull()
    return named


def rollup_levels(keys: Sequence[str] = CLUSTER_KEYS) -> list[list[str]]:
    return [list(keys[:n]) for n in range(len(keys), -1, -1)]


def band_summary(bands: DataFrame) -> DataFrame:
    """Run counters of a rebuild."""
    return bands.agg(
        F.count("*").alias("total"),
        F.count("*").alias("updated"),
        F.count_if("insufficient_data").alias("insufficient_data"),
    )


def sufficiency_split(bands: DataFrame) -> DataFrame:
    """How many clusters are sufficient or thin, and how many comps stand behind each."""
    return bands.groupBy("insufficient_data").agg(
        F.count("*").alias("clusters"), F.sum("comp_count").alias("comps")
    )


def upsert_bands(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Keyed overwrite: fresh bands replace stored ones, stored keys not rebuilt stay behind."""
    kept = stored.join(fresh.select("cluster_key"), "cluster_key", "left_anti")
    return kept.withColumn("carried_over", F.lit(True)).unionByName(
        fresh.withColumn("carried_over", F.lit(False))
    )


def without_confirmed_duplicates(comps: DataFrame, confirmed: DataFrame, key: str = "id") -> DataFrame:
    """Comps that take part in bands; the raw rows stay where they are."""
    return comps.join(confirmed.select(key).distinct(), key, "left_anti")


def price_type_weight(model_weight_tenths: Column) -> Column:
    """Integer band weight: the model weight in tenths, halved for prices that are not sales."""
    return F.when(F.col("price_type") == "auction_final", model_weight_tenths * 2).otherwise(
        model_weight_tenths
    )


def flag_outliers(rows: DataFrame, price: str) -> DataFrame:
    """Mark prices beyond 1.5 interquartile ranges of their band."""
    spread = (F.col("p75_price") - F.col("p25_price")) * 1.5
    return rows.withColumn(
        "outlier",
        F.when(F.col(price) < F.col("p25_price") - spread, "low")
        .when(F.col(price) > F.col("p75_price") + spread, "high")
        .when(F.col("p25_price").isNotNull() & F.col(price).isNotNull(), "none"),
    )
