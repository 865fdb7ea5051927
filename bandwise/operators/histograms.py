"""Price counts per cluster and day, written once and added up into bands."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.operators.bands import bands_of_histogram
from bandwise.schemas import CLUSTER_KEYS, MIN_CLUSTER_SIZE, THIN_WINDOW_DAYS, WINDOW_DAYS

COUNTS = ("n", "weight", "conf", "nconf")


class DailyHistograms:
    """Counts per (cluster, day, cents) below `root`, one folder per run and day.

    Counts add up, so a run writes what is new, be it the comps of a new day or late ones of an old day, and a retried
    run overwrites its own folder. Bands are the sum over the days of their windows: days are folders, so those that
    left the window are not read. Sums of counts are exact, and so are the bands.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = CLUSTER_KEYS):
        self.spark, self.root, self.keys = spark, root, list(keys)

    def _schema(self) -> str:
        return ", ".join([*(f"{k} string" for k in self.keys), "cents bigint, n bigint, weight bigint, conf decimal(38,4), "
                          "nconf bigint, run string, day date"])

    def _write(self, counts: DataFrame, run: str) -> None:
        # days are split among tasks by size, so a busy day is several files and a quiet one a single small one
        counts.select(*self.keys, "cents", *COUNTS, "day").hint("rebalance", "day").write.mode("overwrite").partitionBy(
            "day").parquet(f"{self.root}/run={run}")

    def add(self, comps: DataFrame, run: str, since: dt.date | None = None, until: dt.date | None = None) -> None:
        """Count comps (those sold from `since` to `until`, where given) as run `run`. Comps without a price, a day or
        a full cluster key count nowhere."""
        for side, edge in ((">=", since), ("<=", until)):
            if edge is not None:
                comps = comps.where(F.expr(f"sale_date {side} date'{edge}'"))
        present = F.col("sale_price").isNotNull() & F.col("sale_date").isNotNull()
        for key in self.keys:
            present = present & F.col(key).isNotNull()
        rows = comps.where(present).select(
            *self.keys, F.col("sale_date").alias("day"),
            F.round(F.col("sale_price").cast("decimal(18,4)") * 100).cast("long").alias("cents"),
            F.col("confidence_score").cast("decimal(6,4)").alias("c"))
        conf = F.coalesce(F.sum("c"), F.lit(0)).cast("decimal(38,4)")
        self._write(rows.groupBy(*self.keys, "day", "cents").agg(
            F.count("*").alias("n"), F.count("*").alias("weight"), conf.alias("conf"), F.count("c").alias("nconf")), run)

    def counts(self, since: dt.date, until: dt.date) -> DataFrame:
        """The stored counts of some days."""
        stored = self.spark.read.schema(self._schema()).parquet(self.root)
        return stored.where(F.expr(f"day >= date'{since}' and day <= date'{until}'"))

    def bands(self, as_of: dt.date, *, window_days: int = WINDOW_DAYS, thin_window_days: int = THIN_WINDOW_DAYS,
              min_size: int = MIN_CLUSTER_SIZE, include_wide_only: bool = False) -> DataFrame:
        """The band table of a day: the same as a rebuild from all comps up to it."""
        narrow_from = as_of - dt.timedelta(days=window_days)
        wide_from = as_of - dt.timedelta(days=max(window_days, thin_window_days))
        names = {"n": "rows", "weight": "weight", "conf": "conf", "nconf": "nconf"}
        narrow = F.expr(f"day >= date'{narrow_from}'")

        def total(value: F.Column, name: str) -> F.Column:
            return F.coalesce(F.sum(value), F.lit(0)).alias(name)

        sums = [total(F.when(narrow, F.col(c)), f"{names[c]}_narrow") for c in COUNTS]
        sums += [total(F.col(c), f"{names[c]}_wide") for c in COUNTS]
        hist = self.counts(wide_from, as_of).groupBy(*self.keys, "cents").agg(*sums)
        return bands_of_histogram(hist, as_of, window_days=window_days, thin_window_days=thin_window_days,
                                  min_size=min_size, keys=self.keys, include_wide_only=include_wide_only)

    def compacted(self, root: str, since: dt.date, until: dt.date) -> DailyHistograms:
        """The same counts as one run in a new folder, without the days before `since`."""
        fresh = DailyHistograms(self.spark, root, self.keys)
        merged = self.counts(since, until).groupBy(*self.keys, "day", "cents").agg(
            *[F.sum(c).cast("decimal(38,4)" if c == "conf" else "bigint").alias(c) for c in COUNTS])
        fresh._write(merged, "base")
        return fresh
