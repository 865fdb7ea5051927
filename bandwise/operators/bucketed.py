"""Keyed tables stored in buckets of their key, so that a merge moves the batch and not the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from bandwise.schemas import NATURAL_KEY


class BucketedTable:
    """Versions of a keyed table, each bucketed and sorted by the key.

    A merge joins the newest version with a batch on the key. The stored side is read bucket by bucket and only the
    batch is shuffled, to the same buckets; the rows leave the join where they belong, so the next version is written
    without another shuffle. A failed merge leaves the newest version as it was. Choose `buckets` so that one fits a
    task at the table's full size.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, keys: Sequence[str] = NATURAL_KEY, buckets: int = 64):
        self.spark, self.name, self.folder, self.keys, self.buckets = spark, name, folder, list(keys), buckets
        self.version = -1
        while spark.catalog.tableExists(f"{name}_v{self.version + 1}"):
            self.version += 1

    def _write(self, rows: DataFrame) -> None:
        table = f"{self.name}_v{self.version + 1}"
        rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).mode("overwrite").option(
            "path", f"{self.folder}/{table}").saveAsTable(table)
        self.version += 1

    def load(self, rows: DataFrame) -> None:
        """The first version: one row per key, dealt to the buckets once."""
        self._write(rows.repartition(self.buckets, *self.keys))

    def rows(self) -> DataFrame:
        """The newest version."""
        return self.spark.table(f"{self.name}_v{self.version}").drop("action")

    def actions(self) -> DataFrame:
        """The newest version with what the last merge did to each row."""
        return self.spark.table(f"{self.name}_v{self.version}")

    def merge(self, batch: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """The next version: merged(stored, batch), which names the action taken per row."""
        self._write(merged(self.rows(), batch))
        return self.actions()
