"""Record linkage: reference models, duplicates, currency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwise.operators.skew import with_previous
from bandwise.schemas import CANONICAL_MODEL_SCHEMA, CANONICAL_MODELS

MILEAGE_BAND = 500
DATE_BAND = 60
DUPLICATE_KEYS = ("year", "generation", "transmission", "exterior_color_canonical")


def canonical_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(m) for m in CANONICAL_MODELS], CANONICAL_MODEL_SCHEMA)


def seed_models(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """Idempotent seed: only generations the table lacks are added."""
    return stored.unionByName(seed.join(stored.select("generation"), "generation", "left_anti")
                              .select(*stored.columns))


def with_models_by_year(rows: DataFrame, models: DataFrame, year: str = "year") -> DataFrame:
    """Year within a model's range; a year can belong to two models. The ranges span few years,
    so they are listed year by year and the range join becomes an equi-join."""
    by_year = models.select(
        F.explode(F.sequence("years_start", "years_end")).alias(year),
        F.col("generation").alias("model_generation"), "common_name", "weight_tenths",
    )
    return rows.join(by_year, year, "left")


def with_known_trims(rows: DataFrame, models: DataFrame, generation: str, trim: str) -> DataFrame:
    """Rows whose trim is a known one of their generation."""
    trims = models.select(
        F.col("generation").alias(generation), F.explode("known_trims").alias(trim)
    )
    return rows.join(trims, [generation, trim], "left_semi")


def vin_duplicates(rows: DataFrame) -> DataFrame:
    """Rows that share a VIN point to the oldest of them. The oldest comes from an aggregate
    with map-side combine, and only VINs seen twice take part in the join."""
    firsts = (
        rows.where(F.col("vin").isNotNull())
        .groupBy("vin")
        .agg(
            F.min_by("id", F.struct("created_at", "id")).alias("possible_duplicate_id"),
            F.count("*").alias("seen"),
        )
        .where(F.col("seen") > 1)
        .drop("seen")
    )
    return (
        rows.where(F.col("vin").isNotNull()).select("id", "vin").join(firsts, "vin")
        .where(F.col("id") != F.col("possible_duplicate_id"))
    )


def similar_duplicates(
    rows: DataFrame,
    keys: Sequence[str] = DUPLICATE_KEYS,
    *,
    mileage_band: int = MILEAGE_BAND,
    date_band: int = DATE_BAND,
) -> DataFrame:
    """Rows without VIN that an older row resembles: equal keys, mileage and date within their
    bands. Each gets the date of its oldest such row and the id of a matching row of that day.
    Older means earlier by (date, mileage, id).

    No pairs are formed. Mileage buckets are one wider than the band, so rows of one bucket
    always match on mileage; for the buckets next to it only the extreme mileage of a day
    decides. A bucket and date cell (as many days as the band holds) therefore shrinks to at
    most one summary per day, whatever its size. Every cell receives the summaries of its
    neighbours, and each row meets one bounded array. The array side has one row per cell, so
    AQE can split the rows of a hot cell over many tasks.
    """
    wanted = F.col("vin").isNull() & F.col("mileage").isNotNull() & F.col("listing_date").isNotNull()
    for key in keys:
        wanted = wanted & F.col(key).isNotNull()
    span = date_band + 1
    points = rows.where(wanted).select(
        "id", *keys, "mileage", "listing_date",
        F.floor(F.col("mileage") / (mileage_band + 1)).cast("long").alias("bucket"),
        F.unix_date("listing_date").alias("day"),
    ).withColumn("cell", F.floor(F.col("day") / span).cast("long"))

    by_mileage = F.struct("mileage", "id")
    daily = points.groupBy(*keys, "bucket", "cell", "day").agg(
        F.min("mileage").alias("lo"), F.min_by("id", by_mileage).alias("lo_id"),
        F.max("mileage").alias("hi"), F.max_by("id", by_mileage).alias("hi_id"),
    )
    shifts = F.explode(F.array(*[
        F.struct(F.lit(b).alias("bucket"), F.lit(c).alias("cell")) for b in (-1, 0, 1) for c in (0, 1)
    ]))
    # A summary sent to the bucket above lies below it, hence the minus.
    around = (
        daily.withColumn("to", shifts)
        .withColumn("bucket", F.col("bucket") + F.col("to.bucket"))
        .withColumn("cell", F.col("cell") + F.col("to.cell"))
        .withColumn("side", -F.col("to.bucket"))
        .groupBy(*keys, "bucket", "cell")
        .agg(F.collect_list(F.struct("day", "side", "lo", "lo_id", "hi", "hi_id")).alias("around"))
    )
    met = points.join(around, [*keys, "bucket", "cell"], "left")

    def resembles(e):
        earlier = (e["day"] < F.col("day")) & (e["day"] >= F.col("day") - date_band)
        near = (
            (e["side"] == 0)
            | ((e["side"] < 0) & (e["hi"] >= F.col("mileage") - mileage_band))
            | ((e["side"] > 0) & (e["lo"] <= F.col("mileage") + mileage_band))
        )
        return earlier & near

    oldest = F.array_min(F.transform(
        F.filter("around", resembles),
        lambda e: F.struct(
            e["day"].alias("day"), F.abs(e["side"]).alias("side"),
            F.when(e["side"] < 0, e["hi_id"]).otherwise(e["lo_id"]).alias("id"),
        ),
    ))
    met = met.withColumn("oldest", oldest).drop("around")
    # Same day: the row next below in mileage decides.
    same_day = with_previous(
        met, [*keys, "day"], F.col("bucket"), ["mileage", "id"], ["mileage", "id"], name="below"
    )
    close_below = F.col("below.mileage") >= F.col("mileage") - mileage_band
    return same_day.where(F.col("oldest").isNotNull() | close_below).select(
        "id",
        F.coalesce(F.date_from_unix_date("oldest.day"), F.col("listing_date")).alias("duplicate_date"),
        F.coalesce("oldest.id", "below.id").alias("possible_duplicate_id"),
    )


def daily_rates(rates: DataFrame, until) -> DataFrame:
    """Observed rates (currency, rate_date, rate) to one rate per currency and day: each holds
    until the next observation. The rate table is small (currencies times days)."""
    w = Window.partitionBy("currency").orderBy("rate_date")
    held_to = F.coalesce(F.date_sub(F.lead("rate_date").over(w), 1), F.lit(until))
    return (
        rates.withColumn("held_to", held_to)
        .where(F.col("held_to") >= F.col("rate_date"))
        .select("currency", F.explode(F.sequence("rate_date", "held_to")).alias("rate_date"), "rate")
    )


def convert_prices(comps: DataFrame, rates: DataFrame, until) -> DataFrame:
    """Sale prices in the base currency at the rate in force on the sale date: an as-of join,
    turned into an equi-join on (currency, day) so that no currency is one task's work."""
    per_day = daily_rates(rates, until).withColumnRenamed("rate_date", "sale_date")
    joined = comps.join(per_day, ["currency", "sale_date"], "left")
    rate = F.when(F.col("currency") == "USD", F.lit(1)).otherwise(F.col("rate"))
    return joined.withColumn("used_rate", rate.cast("decimal(10,4)")).withColumn(
        "sale_price_usd",
        F.round(F.col("sale_price") * F.col("used_rate"), 2),
    )
