"""The full normalization projection over parsed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions import normalize as N
from bandwise.functions.fuzzy import with_color


def normalize_records(parsed: DataFrame) -> DataFrame:
    """Parsed records to normalized ones: no shuffle, one pass.

    A raw field that is empty falls back to title plus description; one that is present but
    cannot be mapped does not. The text flags read the description alone.
    """
    title = F.coalesce("title_raw", F.lit(""))
    description = F.coalesce("description_raw", F.lit(""))
    combined = F.concat(title, F.lit(" "), description)

    def or_text(column):
        return F.coalesce(F.nullif(F.col(column), F.lit("")), combined)

    indexed, text = N.with_text_index(parsed, "description_raw")
    rows = with_color(
        indexed, F.nullif(F.col("exterior_color_raw"), F.lit("")),
        "exterior_color_canonical", "color_confidence",
    )
    rows = (
        rows.withColumn(
            "generation", F.when(F.col("year") != 0, N.generation(F.col("year"), combined))
        )
        .withColumn("body_style", N.body_style(or_text("body_style_raw")))
        .withColumn("transmission", N.transmission(or_text("transmission_raw")))
        .withColumn("drivetrain", N.drivetrain(F.col("drivetrain_raw")))
        .withColumn("matching_numbers", N.text_flag(text, "matching_numbers"))
        .withColumn("original_paint", N.text_flag(text, "original_paint"))
        .withColumn("service_history", N.text_flag(text, "service_history"))
        .withColumn("modification_flags", N.modification_flags(text))
        .withColumn("seller_type", N.seller_type(F.col("seller_type_raw")))
        .withColumn("listing_date", N.lenient_date(F.col("listing_date")))
        .withColumn("description_raw", F.nullif(F.col("description_raw"), F.lit("")))
        .withColumn("currency", F.coalesce("currency", F.lit("USD")))
    )
    return rows.withColumn(
        "normalization_confidence",
        N.confidence(
            F.col("year"), F.col("generation"), F.col("body_style"), F.col("transmission"),
            F.col("exterior_color_raw"), F.col("mileage"), F.col("exterior_color_canonical"),
            F.col("color_confidence"),
        ),
    ).drop(*N.TEXT_INDEX_COLUMNS)
