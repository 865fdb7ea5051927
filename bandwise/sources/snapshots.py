"""The raw page archive: keys, scan, sink, replay."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.operators.skew import latest_per_key

SLUG_CAP = 120
#: Snapshots that one task of a replay sorts, some hundred MB of pages.
SNAPSHOTS_PER_TASK = 100_000
PATH = r"/([^/]+)/(\d{4}-\d{2}-\d{2})/([^/]+)\.(html|json)$"


def url_slug(url: Column) -> Column:
    """File-safe key of a URL: unsafe characters to "_", capped, with a short hash."""
    bare = F.regexp_replace(url, r"https?://", "")
    safe = F.btrim(F.regexp_replace(bare, r"[^a-zA-Z0-9._-]", "_"), F.lit("_"))
    return F.concat(F.left(safe, F.lit(SLUG_CAP)), F.lit("_"), F.left(F.md5(url), F.lit(8)))


def path_parts(path: Column) -> list[Column]:
    """Source, day, slug and type from an archive path source/day/slug.ext."""
    return [
        F.regexp_extract(path, PATH, 1).alias("source"),
        F.try_to_date(F.regexp_extract(path, PATH, 2)).alias("fetch_date"),
        F.regexp_extract(path, PATH, 3).alias("slug"),
        F.regexp_extract(path, PATH, 4).alias("content_type"),
    ]


def archive_path(base: str, source: Column, day: Column, url: Column, content_type: Column) -> Column:
    ext = F.when(content_type == "json", "json").otherwise("html")
    return F.concat(F.lit(base + "/"), source, F.lit("/"), F.date_format(day, "yyyy-MM-dd"),
                    F.lit("/"), url_slug(url), F.lit("."), ext)


def read_archive(spark: SparkSession, base: str) -> DataFrame:
    """Scan an archive of one file per page."""
    files = spark.read.text(f"{base}/*/*/*", wholetext=True)
    return files.select(
        F.col("value").alias("content"), F.col("_metadata.file_path").alias("snapshot_path"),
        *path_parts(F.col("_metadata.file_path")),
    )


def write_snapshots(pages: DataFrame, path: str, folder: str = "day") -> None:
    """Append non-empty pages to the columnar archive, laid out by source and time so that a
    source's job reads only its own folders. `folder` is the time one folder spans: "day" for a
    nightly run, "month" where years are loaded at once. Rows of a folder are brought together
    first, so it gets few files; adaptive execution splits a large folder by measured bytes."""
    day = F.col("fetched_at").cast("date")
    rows = pages.where(F.length("content") > 0).select(
        "*", day.alias("fetch_date"), url_slug(F.col("url")).alias("slug"),
        F.date_trunc(folder, day).cast("date").alias("folder_from"))
    rows.hint("rebalance", "source", "folder_from").write.mode("append").partitionBy(
        "source", "folder_from").parquet(path)


def read_snapshots(
    spark: SparkSession, path: str, source: str | None = None, since: dt.date | None = None
) -> DataFrame:
    """The columnar archive. A source and a first day narrow the folders and row groups read."""
    rows = spark.read.parquet(path)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if since is not None:
        # no folder spans more than a month
        rows = rows.where((F.col("folder_from") >= F.lit(since.replace(day=1)))
                          & (F.col("fetch_date") >= F.lit(since)))
    return rows.drop("folder_from")


def not_yet_archived(pages: DataFrame, archive: DataFrame) -> DataFrame:
    """Pages whose key has no snapshot of the same day."""
    keyed = pages.withColumn("slug", url_slug(F.col("url")))
    return keyed.join(archive.select("slug", "fetch_date"), ["slug", "fetch_date"], "left_anti")


def already_archived(pages: DataFrame, archive: DataFrame) -> DataFrame:
    keyed = pages.withColumn("slug", url_slug(F.col("url")))
    return keyed.join(archive.select("slug", "fetch_date"), ["slug", "fetch_date"], "left_semi")


def latest_snapshots(pages: DataFrame) -> DataFrame:
    """The newest snapshot per page, for replaying the extraction over the whole archive. Pages are sent once, to as many
    tasks as there are pages for, and each task sorts its own: what a task holds does not grow with the archive."""
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // SNAPSHOTS_PER_TASK))
    return latest_per_key(pages.repartition(tasks, "source", "url"), ["source", "url"], ["fetched_at", "page_id"])
