"""Session settings, reliable checkpoints and small driver-side scalars."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Extraction plans hold many aliases over large expressions; deriving extra filters from
    # them takes the optimizer minutes. Null filters that matter are written out instead.
    "spark.sql.constraintPropagation.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator here relies on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", name: str = "bandwise") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", os.environ.get("BANDWISE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        # call-site capture costs several driver round trips per column function
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch folder only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="bandwise-ckpt-")
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of one run in the shared checkpoint area."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def latest_date(df: DataFrame, column: str) -> dt.date:
    """Newest day in a column. One value comes back, so that later filters carry a literal
    which the parquet reader can push down."""
    return df.agg(F.max(F.col(column)).cast("date").alias("d")).first()["d"]
