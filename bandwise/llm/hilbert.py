"""Sharding along a Hilbert curve over metadata dimensions. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm.common import ranked, written

BITS = 5


def _steps(n: int) -> list[int]:
    """The curve's automaton for n dimensions: entry [(entry point * n + direction) * 2**n + corner] gives the
    corner's place on the curve and the next state, as place + 2**n * state."""
    side = (1 << n) - 1

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x >> k) | (x << (n - k))) & side

    def gray(w: int) -> int:
        return w ^ (w >> 1)

    place = {gray(w): w for w in range(side + 1)}
    out = []
    for entry in range(side + 1):
        for way in range(n):
            for corner in range(side + 1):
                w = place[turn(corner ^ entry, way + 1)]
                start = 0 if w == 0 else gray((w - 1) // 2 * 2)
                odd = w if w % 2 else w - 1
                step = 0 if w == 0 else ((odd ^ (odd + 1)).bit_length() - 1) % n
                nxt = (entry ^ turn(start, n - (way + 1) % n)) * n + (way + step + 1) % n
                out.append(w + (side + 1) * nxt)
    return out


def hilbert_index(dims: Sequence[Column], bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve; each dimension is a whole number below 2**bits."""
    n = len(dims)
    table = F.array(*[F.lit(x) for x in _steps(n)])
    corners = F.array(*[
        sum((F.shiftright(d.cast("int"), b).bitwiseAND(F.lit(1)) * (1 << k) for k, d in enumerate(dims)), F.lit(0))
        for b in range(bits - 1, -1, -1)])

    def step(state: Column, corner: Column) -> Column:
        found = F.element_at(table, state["s"] * (1 << n) + corner + 1)
        return F.struct((state["h"] * (1 << n) + found.bitwiseAND(F.lit((1 << n) - 1))).alias("h"),
                        F.shiftright(found, n).alias("s"))

    return F.aggregate(corners, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s")), step, lambda s: s["h"])


def bucketed(value: Column, bits: int = BITS) -> Column:
    """A category's dimension: its hash bucket, so that a filter on one value names one bucket."""
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))), F.lit(1 << bits)).cast("int")


def size_step(size: Column, bits: int = BITS) -> Column:
    """A size's dimension: three steps for two doublings, the last one open."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 1.5), F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                   categories: Sequence[str] = ("source", "lang")) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard, curve.

    Rows are ordered by the Hilbert index of (hash buckets of the categories, size step) and cut into `shards` runs of
    equal row counts, at most one apart (law `rows`); a run covers few cells, so a file's ranges of source, language
    and size are narrow and a reader can skip it. Cells are ranked in hashed slices, so a cell with most of the rows
    is no single task's. Null texts have size 1 and checksum 0; null categories count as empty; rows without an id
    and repeated rows are placed like others (equal rows may swap their slots). Of a very long text only its size and
    checksum are kept. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("crc"), *[bucketed(F.col(c)).alias(f"d{k}") for k, c in enumerate(categories)])
    dims = [F.col(f"d{k}") for k in range(len(categories))]
    rows = written(narrow.select("id", "size", "crc", hilbert_index([*dims, size_step(F.col("size"))]).alias("h")))
    total = rows.count()
    cells = rows.groupBy("h").agg(F.count("*").alias("n"))  # 2 ** (bits * dimensions) rows at most
    before = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("h"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"))
    placed = ranked(rows, ["h"], ["id", "size", "crc"], total).join(cells, "h")
    placed = placed.withColumn("pos", F.col("start") + F.col("rank"))
    placed = placed.withColumn("shard", F.expr(f"int((pos * {shards}) div {max(total, 1)})"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        (F.col("pos") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("h").alias("curve"))


def write_shards(docs: DataFrame, placed: DataFrame, folder: str, id_col: str = "doc_id") -> None:
    """The documents as one Parquet folder per shard, each file a run of the curve. Ids must be unique."""
    where = placed.select(id_col, F.col("shard").alias("_shard"), F.col("slot").alias("_slot"),
                          F.col("curve").alias("_curve"))
    (docs.join(where, id_col).repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
     .write.partitionBy("_shard").parquet(folder))
