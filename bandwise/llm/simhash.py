"""SimHash near-duplicates found by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import components, written

WORDS = 3
BITS = 64
MAX_BITS = 2
#: Segments of the ring; with at most 2 differing bits in 5 segments, some two neighbours are equal (budget 2 * 2/5 < 1).
SEGMENTS = (13, 13, 13, 13, 12)
#: Buckets over this size are linked through common midpoints instead of pairs; no link is lost either way.
PAIR_BUCKET = 64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hash of every word shingle; a text of fewer words is one shingle, of none no shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, "<u8")
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), dtype="<u8", count=max(1, len(found) - words + 1))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash over word shingles, as a signed integer; no word gives 0."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The same from the hashes of a text's shingles, repeats included."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # whole texts, in pieces, so that memory stays small
        piece = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) for every row; ids keep their type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, fp long")


def _segments(fp: Column) -> list[Column]:
    out, shift = [], 0
    for width in SEGMENTS:
        out.append(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        shift += width
    return out


def _chain_holds(a: Column, b: Column, start: Column) -> Column:
    """The pigeonring test: from segment `start` on, the differences of the first k segments stay within k * 2/5."""
    x = a.bitwiseXOR(b)
    counts = F.array(*[F.bit_count(s) for s in _segments(x)])
    n = len(SEGMENTS)
    running, holds = None, F.lit(True)
    for k in range(1, n + 1):
        here = F.element_at(counts, (F.pmod(start + (k - 1), F.lit(n)) + 1).cast("int"))
        running = here if running is None else running + here
        holds = holds & (running <= MAX_BITS * k // n)
    return holds


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints `fp` whose components are those of Hamming distance <= 2.

    Each fingerprint enters five tables, keyed by a pair of neighbouring segments. Buckets of up to PAIR_BUCKET
    members are joined with themselves: the chain test prunes, its last step is the full Hamming check. In a larger
    bucket the remaining differences lie in three segments: every member is joined to its own variants with one of
    these bits flipped, and members at distance 1 or 2 share a variant. Rows stay linear in the bucket.
    """
    rings = []
    n = len(SEGMENTS)
    segs = _segments(F.col("fp"))
    for i in range(n):
        rings.append(F.struct(F.lit(i).alias("ring"), (segs[i] * (1 << 13) + segs[(i + 1) % n]).alias("key")))
    rows = fps.select("fp", F.explode(F.array(*rings)).alias("r")).select("fp", "r.ring", "r.key")
    sizes = rows.groupBy("ring", "key").agg(F.count("*").alias("size")).where("size > 1")
    rows = written(rows.join(sizes, ["ring", "key"]))
    few = rows.where(F.col("size") <= PAIR_BUCKET).drop("size")
    x, y = few.alias("x"), few.alias("y")
    pairs = (x.join(y, (F.col("x.ring") == F.col("y.ring")) & (F.col("x.key") == F.col("y.key"))
                    & (F.col("x.fp") < F.col("y.fp"))
                    & _chain_holds(F.col("x.fp"), F.col("y.fp"), F.col("x.ring")))
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    masks, shift = [], 0
    for width in SEGMENTS:
        masks.append([(1 << b) - (1 << 64 if b == 63 else 0) for b in range(shift, shift + width)])
        shift += width
    free = F.array(*[F.array(*[F.lit(m).cast("long") for k in range(2, n) for m in masks[(i + k) % n]], F.lit(0).cast("long"))
                     for i in range(n)])
    variants = (rows.where(F.col("size") > PAIR_BUCKET)
                .withColumn("flip", F.explode(F.element_at(free, F.col("ring") + 1)))
                .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")))
    # a midpoint needs only its least member: the others are one link away from it
    least = variants.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").drop("z")
    hot = variants.join(least, "mid").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(hot).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links of
    at most 2 differing bits.

    Null and empty texts have fingerprint 0 and link like others. Equal texts and repeated rows share a fingerprint,
    hence a component. A row without an id is returned with its fingerprint and a null component_id, and links
    nothing. A very long text is read whole in its task and leaves as one fingerprint; an empty table gives no rows.
    Other columns, whatever their names, are ignored.
    """
    prints = written(with_fingerprints(docs, id_col, text_col))
    nodes = written(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("first")))
    linked = components(links(nodes.select("fp")))
    # the least id of each component of fingerprints
    groups = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    named = groups.join(least, "component").select("fp", "component_id")
    return (prints.join(named, "fp", "left")
            .select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")))
