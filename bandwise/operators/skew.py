"""Building blocks that stay flat when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by `order`. An aggregate with map-side combine, so a hot
    key shrinks to one row per task before the shuffle (a row_number window would not)."""
    payload = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def time_chunk(ts: str, seconds: int = 3600) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    values: Sequence[str],
    name: str = "prev",
) -> DataFrame:
    """Add struct `name`: `values` of the preceding row of the same key in `order`.

    Each key is cut into chunks that never decrease along the order (time slices, say), and
    lag() runs within a chunk, so a hot key is spread over many tasks. Rows are shuffled once by
    (key, chunk), and both uses below read that exchange. Only the first and last row of a chunk
    travel again, by key: among them, the row before a first one is the last of the nearest
    earlier chunk. Null keys are a key of their own.
    """
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    rows = (
        df.withColumn("_chunk", chunk).repartition(*keys, "_chunk")
        .withColumn("_before", F.lag(F.struct(*values)).over(w))
        .withColumn("_first", F.row_number().over(w) == 1)
        .withColumn("_last", F.lead(F.lit(True)).over(w).isNull())
    )
    ends = rows.where(F.col("_first") | F.col("_last")).withColumn(
        "_before",
        F.when(
            F.col("_first"),
            F.lag(F.struct(*values)).over(Window.partitionBy(*keys).orderBy("_chunk", F.col("_last"))),
        ).otherwise(F.col("_before")),
    )
    inner = rows.where(~F.col("_first") & ~F.col("_last"))
    return inner.unionByName(ends).withColumnRenamed("_before", name).drop("_chunk", "_first", "_last")
