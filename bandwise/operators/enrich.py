"""Listings joined with their price band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions import deltas
from bandwise.schemas import CLUSTER_KEYS

BAND_COLUMNS = (
    "median_price", "p25_price", "p75_price", "min_price", "max_price", "comp_count",
    "insufficient_data",
)


def with_band(
    listings: DataFrame, bands: DataFrame, keys: Sequence[str] = CLUSTER_KEYS
) -> DataFrame:
    """Left join on the cluster columns; a null part never matches."""
    return listings.join(bands.select(*keys, *BAND_COLUMNS), list(keys), "left")


def with_band_by_key(listings: DataFrame, bands: DataFrame) -> DataFrame:
    """The same join through the concatenated cluster key (null part, null key, no match)."""
    g, b, t = CLUSTER_KEYS
    keyed = listings.withColumn(
        "cluster_key", F.concat(F.col(g), F.lit(":"), F.col(b), F.lit(":"), F.col(t))
    )
    return keyed.join(bands.select("cluster_key", *BAND_COLUMNS), "cluster_key", "left")


def ask_view(listings: DataFrame, bands: DataFrame, mode: str = "alert_view") -> DataFrame:
    """Listings with band columns and the ask-versus-median delta of the given mode."""
    return with_band(listings, bands).withColumn(
        "delta_pct",
        deltas.ask_vs_median(
            F.col("asking_price"), F.col("median_price"), F.col("insufficient_data"), mode
        ),
    )
