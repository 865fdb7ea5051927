"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import components, written

WIDTH = 2.0
SEED = 20_221
#: Members of one block of a bucket; larger buckets are compared block by block, so a member is sent once for each
#: BLOCK members of its bucket.
BLOCK = 4096
#: Groups above this size are compared by tiles, of so many rows and columns of cosines.
LAGGED, TILE = 64, 512
#: Up to this bucket size, members that no sign sketch lies near are dropped before vectors travel.
SKETCHED = 256
#: Sign bits that spare far pairs of small buckets the exact check, and how many may differ (at cosine 0.9 the mean
#: is 18 and the deviation 4).
SKETCH_BITS, SKETCH_APART = 128, 38
MISS = 0.07


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection agrees for two vectors at this Euclidean distance."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(rows: int, cosine: float) -> tuple[int, int]:
    """(hashes per table, tables): about one far vector per bucket at this row count, and a chance of MISS at most
    that a pair just at the threshold shares no bucket."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(2 - 2 * cosine))
    hashes = max(8, math.ceil(math.log(max(rows, 2)) / -math.log(far)))
    return hashes, math.ceil(math.log(MISS) / math.log(1 - near ** hashes))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of doubles, shorter ones padded with zeros, scaled to length one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = int(lengths.max(initial=1))
    out = np.zeros((len(lengths), wide))
    out[np.arange(wide) < lengths[:, None]] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def hashed(vectors: DataFrame, hashes: int, tables: int) -> DataFrame:
    """(id, keys, s0, s1): a bucket key in each table and the sign sketch of every vector of (id, emb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple] = {}
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(lengths):
                rows = np.nonzero(lengths == dim)[0]
                if dim not in drawn:
                    rng = np.random.default_rng([SEED, int(dim)])
                    drawn[dim] = (rng.standard_normal((dim, tables * hashes)), rng.uniform(0, WIDTH, tables * hashes),
                                  rng.integers(1, 1 << 62, (tables, hashes)) * 2 + 1,
                                  rng.standard_normal((dim, SKETCH_BITS)))
                lines, shift, mix, signs = drawn[dim]
                unit = _matrix(lists.take(pa.array(rows)))
                cells = np.floor((unit @ lines + shift) / WIDTH).astype(np.int64).reshape(len(rows), tables, hashes)
                with np.errstate(over="ignore"):
                    keys = (cells * mix).sum(axis=2) * 31 + int(dim)
                sketch = np.packbits(unit @ signs > 0, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel())),
                    pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["id", "keys", "s0", "s1"])

    return vectors.mapInArrow(run, "id long, keys array<long>, s0 long, s1 long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member reachable for members 0..n-1 under links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, was):
            return root


def _compare(rows: pa.Table, cosine: float) -> pa.RecordBatch:
    """Exact checks inside every group of (ring, key, bi, bj), which follow each other; a pair counts only in the
    first table that it shares. Gives each member its number of links and the least member it reaches here."""
    ring, key = rows["ring"].to_numpy(), rows["key"].to_numpy()
    bi, bj, side = rows["bi"].to_numpy(), rows["bj"].to_numpy(), rows["side"].to_numpy()
    ids, weight = rows["id"].to_numpy(), rows["n"].to_numpy()
    unit = _matrix(rows["emb"])
    keys = rows["keys"].combine_chunks()
    keys = keys.flatten().to_numpy().reshape(len(ids), -1)
    change = (np.diff(ring) != 0) | (np.diff(key) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)
    group = np.concatenate([[0], np.cumsum(change)])
    links = np.zeros(len(ids), dtype=np.int64)
    left, right = [], []

    def linked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that meet here first and are near; counts them."""
        meet = (bi[i] == bj[i]) | (side[i] != side[j])
        i, j = i[meet], j[meet]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        i, j = i[near], j[near]
        first = (keys[i] == keys[j]).argmax(axis=1) == ring[i]
        i, j = i[first], j[first]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        return i, j

    starts = np.concatenate([[0], np.nonzero(change)[0] + 1, [len(ids)]])
    large = np.diff(starts) > LAGGED
    for lag in range(1, LAGGED):
        at = np.nonzero((group[lag:] == group[:-lag]) & ~large[group[lag:]])[0]
        if not len(at):
            break
        for part in np.array_split(at, len(at) // 20_000 + 1):
            i, j = linked(part, part + lag)
            left.append(i)
            right.append(j)
    for lo, hi in zip(starts[:-1][large], starts[1:][large], strict=True):
        for x in range(lo, hi, TILE):
            for y in range(x, hi, TILE):
                # the product's sums may round otherwise, so it only proposes
                i, j = np.nonzero(unit[x:min(x + TILE, hi)] @ unit[y:min(y + TILE, hi)].T >= cosine - 1e-9)
                up = i + x < j + y
                i, j = linked(i[up] + x, j[up] + y)
                # of a tile's links only a spanning forest is kept
                places = np.concatenate([np.arange(x, x + TILE), np.arange(y, y + TILE)])
                forest = _roots(2 * TILE, i - x, j - y + (TILE if y > x else 0))
                told = np.nonzero(forest != np.arange(2 * TILE))[0]
                left.append(places[told])
                right.append(places[forest[told]])
    a = np.concatenate([np.zeros(0, int), *left])
    b = np.concatenate([np.zeros(0, int), *right])
    root = _roots(len(ids), a, b)
    told = links > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[told]), pa.array(links[told]), pa.array(ids[root[told]])],
                                      ["id", "links", "root"])


def compared(members: DataFrame, cosine: float) -> DataFrame:
    """(id, links, root) of the rows dealt to groups of (ring, key, bi, bj)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            parts = [table[c].to_numpy() for c in ("ring", "key", "bi", "bj")]
            other = np.zeros(len(table), dtype=bool)
            for p in parts:
                other |= p != p[-1]
            cut = int(np.nonzero(other)[0][-1]) + 1 if other.any() else 0  # the last group may go on
            if cut:
                yield _compare(table.slice(0, cut), cosine)
            held = table.slice(cut).combine_chunks().to_batches()
        if held and sum(map(len, held)):
            yield _compare(pa.Table.from_batches(held), cosine)

    dealt = (members.repartition("ring", "key", "bi", "bj")
             .sortWithinPartitions("ring", "key", "bi", "bj", "id"))
    return dealt.mapInArrow(run, "id long, links long, root long")


def dealt(keyed: DataFrame) -> DataFrame:
    """(id, ring, key, bi, bj, side): which groups every row of `hashed` goes to. Buckets of one member go nowhere."""
    slots = keyed.select("id", "s0", "s1", F.posexplode("keys").alias("ring", "key"))
    sizes = slots.groupBy("ring", "key").agg(F.count("*").alias("size")).where("size > 1")
    slots = written(slots.join(sizes, ["ring", "key"]))
    few = slots.where(F.col("size") <= SKETCHED)
    x, y = few.alias("x"), few.alias("y")
    apart = (F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))))
    partnered = x.join(y, (F.col("x.ring") == F.col("y.ring")) & (F.col("x.key") == F.col("y.key"))
                       & (F.col("x.id") != F.col("y.id")) & (apart <= SKETCH_APART), "left_semi")
    blocks = F.ceil(F.col("size") / BLOCK)
    members = partnered.union(slots.where(F.col("size") > SKETCHED)).select("id", "ring", "key", blocks.alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("id", "ring"), F.col("blocks")))
    return members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "id", F.col("ring").cast("int").alias("ring"), "key",
        F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
        (F.col("block") > F.col("other")).cast("int").alias("side"))


def embedding_links(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Equal vectors form a class whose least id stands for it. Classes enter several tables of quantised random
    projections; buckets are cut into blocks, every two blocks of a bucket meet in one task, and cosines are checked
    there in double precision. Tasks give counts and spanning links, never pairs, so output stays linear in a group.
    In small buckets, members without any partner of a similar sign sketch are dropped before vectors travel. A task
    holds two blocks of vectors at most; a bucket of n members is sent n / BLOCK times, once if it is one block.

    Null or zero vectors and vectors with null or non-finite components link with nothing: no links, their own
    component, kept. Vectors of different length never link. A null id gives no links and a null component, kept.
    Repeated rows are vectors of their own, linked with each other, unless their id is null. An empty table gives no rows.
    """
    v = F.col("v")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = (F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: x != 0))
    rows = written(source.select("id", F.coalesce(sound, F.lit(False)).alias("sound"), "v")
                   .select("id", "sound", F.when(F.col("sound"), v).alias("v"))
                   .withColumn("h", F.when(F.col("sound"), F.struct(F.xxhash64("v"), F.xxhash64(F.lit(7), "v")))))
    classes = written(rows.where("sound").groupBy("h")
                      .agg(F.min("id").alias("cls"), F.count("*").alias("n"), F.min_by("v", "id").alias("emb"))
                      .select("h", "cls", "n", "emb", F.monotonically_increasing_id().alias("id")))
    total = classes.count()
    hashes, tables = plan_tables(total, cosine)
    keyed = written(hashed(classes.select("id", "emb"), hashes, tables))
    carried = dealt(keyed).join(classes.select("id", "n", "emb").join(keyed.select("id", "keys"), "id"), "id")
    found = written(compared(carried.select("id", "ring", "key", "bi", "bj", "side", "n", "emb", "keys"), cosine))
    names = classes.select("id", "cls")
    edges = (found.where("root <> id").select("id", "root").distinct().join(names, "id")
             .join(names.select(F.col("id").alias("root"), F.col("cls").alias("b")), "root")
             .select(F.col("cls").alias("a"), "b"))
    reached = components(edges)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    told = (classes.join(counts, "id", "left").join(reached.withColumnRenamed("node", "cls"), "cls", "left")
            .select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                    F.coalesce("component", "cls").alias("component_id")))
    return (rows.select("id", "h").join(told, "h", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
