"""What several operators share: written tables, ranks without a hot task, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A salted slice of a class holds about this many rows.
SLICE_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can read.

    Where the setting is missing, a local session gets a scratch folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="bandwise-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/bandwise-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there, and a lost executor costs only its own tasks."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ranked(df: DataFrame, classes: Sequence[str], order: Sequence[str], rows: int, name: str = "rank") -> DataFrame:
    """Add `name`: 0, 1, 2 ... within each class, without holding a class in one task.

    Each class is cut into slices by a hash of `order`, as many as `rows` (the row count of df) asks for. Counts per
    slice, combined before their shuffle, give every slice its first rank. Classes are compared null-safe.
    df is read twice, so it should be a written table. Ties in `order` are equal rows and take any of their ranks.
    """
    slices = max(1, -(-rows // SLICE_ROWS))
    df = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    keys = [*classes, "_slice"]
    firsts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*classes).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    firsts = firsts.select(*[F.col(k).alias(f"_f{k}") for k in keys], "_first")
    within = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn("_row", F.row_number().over(within).cast("long") - 1)
    met = [placed[k].eqNullSafe(firsts[f"_f{k}"]) for k in keys]
    on = met[0]
    for m in met[1:]:
        on = on & m
    return (placed.join(firsts, on).withColumn(name, F.col("_first") + F.col("_row"))
            .drop("_slice", "_row", "_first", *[f"_f{k}" for k in keys]))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph with edges (a, b): one row (node, component) for each node that
    has an edge; component is the smallest node reachable.

    Alternating large-star and small-star rounds: every node points at the least neighbour it knows, until a round
    changes nothing. Each round is one aggregate with map-side combine and one join that the engine may split, so a
    node with very many neighbours is no single task's work; rounds grow with the logarithm of the node count.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct())
    seen = None
    while True:
        # large star: the larger neighbours of a node move to the least of its neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: a node and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        n, total = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, total) == seen:
            break
        seen = (n, total)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
