"""Constraints as data: valid rows, quarantine with reasons, run health."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise import schemas as S

LISTING_ENUMS: Mapping[str, tuple[str, ...]] = {
    "source": S.SOURCES,
    "listing_status": S.LISTING_STATUSES,
    "generation": S.GENERATIONS,
    "body_style": S.BODY_STYLES,
    "transmission": S.TRANSMISSIONS,
    "drivetrain": S.DRIVETRAINS,
    "exterior_color_canonical": S.COLORS,
    "title_status": S.TITLE_STATUSES,
    "currency": S.CURRENCIES,
    "price_type": S.PRICE_TYPES,
    "seller_type": S.SELLER_TYPES,
}


def listing_rules() -> dict[str, Column]:
    """Rule name to violation. A null only violates the not-null rules."""
    score = F.col("normalization_confidence")
    return {
        "source missing": F.col("source").isNull(),
        "url missing": F.col("source_url").isNull(),
        "year missing": F.col("year").isNull(),
        "year out of range": ~F.col("year").between(S.YEAR_MIN, S.YEAR_MAX),
        "mileage negative": F.col("mileage") < 0,
        "confidence out of range": ~score.between(0, 1),
    }


def comp_rules() -> dict[str, Column]:
    return {
        "sale price missing": F.col("sale_price").isNull(),
        "sale price not positive": F.col("sale_price") <= 0,
        "sale date missing": F.col("sale_date").isNull(),
        "confidence out of range": ~F.col("confidence_score").between(0, 1),
    }


def enum_rules(df: DataFrame, enums: Mapping[str, tuple[str, ...]] = LISTING_ENUMS) -> dict[str, Column]:
    """Membership rules for the enumerated columns present."""
    return {
        f"{name} unknown": ~F.col(name).isin(*values)
        for name, values in enums.items()
        if name in df.columns
    }


def with_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return df.withColumn(
        "violations",
        F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()])),
    )


def split_by_rules(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    judged = with_violations(df, rules)
    clean = F.size("violations") == 0
    return judged.where(clean).drop("violations"), judged.where(~clean)


def run_health(runs: DataFrame) -> DataFrame:
    """Health of the runs per source."""
    return runs.groupBy("source").agg(
        F.count("*").alias("runs"),
        F.max("run_day").alias("last_run"),
        F.sum("pages_fetched").alias("pages_fetched"),
        F.sum("errors").alias("errors"),
        F.max("errors").alias("worst_errors"),
    )


def error_spikes(runs: DataFrame, trailing: int = 7, margin: float = 0.05) -> DataFrame:
    """Runs whose error rate lies clearly above the mean of the runs before. The run log has one
    row per source and run, so a source's window stays small."""
    before = Window.partitionBy("source").orderBy("run_day").rowsBetween(-trailing, -1)
    rate = F.col("errors") / F.col("pages_fetched")
    return (
        runs.withColumn("error_rate", F.round(rate, 6))
        .withColumn("usual_rate", F.round(F.avg("error_rate").over(before), 6))
        .where(F.col("error_rate") > F.col("usual_rate") + margin)
        .select("source", "run_day", "error_rate", "usual_rate")
    )
