"""Near copies by the Jaccard similarity of word shingles: SimHash links propose pairs, MinHash bands those whose
fingerprints lie further apart, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import components, written
from bandwise.llm.simhash import fingerprint_of, links, shingle_hashes

WORDS = 5
SIMILAR = 0.8
#: A pair of similarity s shares one of the keys with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9999 at 0.8.
BANDS, ROWS = 24, 5
#: Up to this many sets under a key are compared pair by pair; larger crowds by the shingles of their sets.
PAIR_BUCKET = 64
#: A block of a crowd's sets holds about this many shingles.
TILE = 1 << 18
_MIX = np.random.default_rng(8_203).integers(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * 2 + 1
_PIECE = 1 << 12


def shingles(text: str | None) -> np.ndarray:
    """The set of hashes of a text's shingles, sorted; a text of fewer words is one shingle, of none no shingle."""
    return np.unique(shingle_hashes(text, WORDS))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band of least hashes."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _PIECE):
        h = found[at:at + _PIECE, None] * _MIX
        h ^= h >> np.uint64(32)
        np.minimum(least, h.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _prints(docs: DataFrame) -> DataFrame:
    """(id, node, n, keys, fp): the digest of a text's shingle set, its size, its band keys and the text's SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), WORDS)
                found = np.unique(hashes)
                rows.append((xxhash.xxh64_intdigest(found.tobytes()), len(found), band_keys(found), fingerprint_of(hashes)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64)),
                 pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[3] for r in rows], pa.int64())], ["id", "node", "n", "keys", "fp"])

    return docs.mapInArrow(run, "id long, node long, n int, keys array<long>, fp long")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, found) of texts (id, text), a few rows at a time, as sets may be long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                found = [shingles(t.as_py()) for t in batch.column(1).slice(at, 200)]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["node", "found"])

    return docs.mapInArrow(run, "node long, found array<long>")


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, found), written, of the nodes in `wanted`."""
    ids = wanted.join(nodes, "node").select(F.col("first").alias("id")).distinct()
    # where ids clash or rows repeat, the digest decides
    return written(_sets(docs.join(ids, "id").select("id", "text")).join(wanted, "node").dropDuplicates(["node"]))


def _tile_links(table: pa.Table) -> pa.Table:
    """Of two blocks of a family (or one), links (a, b) that join what its similar pairs of different components join."""
    node, n, block = (table.column(c).to_numpy() for c in ("node", "n", "block"))
    label = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
    grams = table.column("grams").combine_chunks()
    ends = np.cumsum(grams.value_lengths().to_numpy())
    grams, row = grams.flatten().to_numpy(), np.repeat(np.arange(len(node)), np.diff(ends, prepend=0))
    second = np.flatnonzero(block[row] == block.max())
    second = second[np.argsort(grams[second], kind="stable")]
    listed, holder = grams[second], row[second]
    found = []
    for x in np.flatnonzero(block == block.min()):
        own = grams[(ends[x - 1] if x else 0):ends[x]]
        low, high = np.searchsorted(listed, own, "left"), np.searchsorted(listed, own, "right")
        at = np.repeat(high - np.cumsum(high - low), high - low) + np.arange((high - low).sum())
        common = np.bincount(holder[at], minlength=len(node))
        for y in np.flatnonzero((common >= SIMILAR * (n[x] + n - common)) & (label != label[x])):
            if label[y] != label[x]:
                found.append((node[x], node[y]))
                label[label == label[y]] = label[x]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _crowd_links(crowd: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b), written, among the nodes (node, component, n) of crowds that join all components that any link joins.

    The least hashes of a set, as many as it may lack and one more, hold one in common with each similar set's, so sets
    that share such a one, which several components hold, are a family. All pairs of a family meet, in tiles of two blocks
    of about TILE shingles; a family of one block is sent once, a larger one once per block. A tile returns no more links than
    it has components.
    """
    sets = _sets_of(crowd.select("node"), nodes, docs).join(crowd, "node")
    many = (F.col("n") - F.ceil(SIMILAR * F.col("n") - 1e-6) + 1).cast("int")
    least = written(sets.select("node", "component", F.explode(F.slice("found", F.lit(1), many)).alias("gram")))
    lists = least.groupBy("gram").agg(F.min("node").alias("a"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    families = components(least.join(lists.where("lo <> hi"), "gram").where("node <> a").select("a", F.col("node").alias("b")))
    members = written(sets.join(families.select("node", F.col("component").alias("family")), "node")
                      .select("family", "node", "component", "n", F.col("found").alias("grams")))
    blocks = members.groupBy("family").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("blocks"))
    dealt = (members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    return written(dealt.select("family", "i", "j", "block", "node", "component", "n", "grams").groupBy("family", "i", "j")
                   .applyInArrow(_tile_links, "a long, b long"))


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) among nodes (node, fp): the least node of a fingerprint with each other one of it, and the least
    nodes of two fingerprints that op2's operator links."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    same = nodes.join(prints.where("n > 1"), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    edges = links(prints.select("fp"))
    for side in "ab":
        edges = edges.join(prints.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_node")), side)
    return same.union(edges.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar, whole sets compared."""
    pairs = written(pairs.distinct())
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = _sets_of(wanted, nodes, docs)
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    return written(both.where(common >= SIMILAR * (F.size("x") + F.size("y") - common)).select("a", "b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and component_id, the smallest id reachable by links of similarity 0.8 or more.

    Words stand between white space, in lower case; similarity is that of the sets of 5-word shingles, decided on whole
    sets, so no other texts are linked. Texts with equal sets, also those without words and null ones, are one node.
    The SimHash links of op2's operator, over these shingles, are candidates first; what they link is one component
    from there on. Nodes that share a band key are candidates too: each meets the least of its bucket, then those of other
    components in it. In a crowd of over PAIR_BUCKET nodes they meet by their shingles instead (_crowd_links), which joins
    what comparing every pair of the crowd would join. A row without an id links nothing and has a null component_id. Very
    long texts are sets like others; an empty table gives no rows; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = written(_prints(narrow))
    nodes = written(prints.where("id is not null").groupBy("node").agg(
        F.min("id").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("fp").alias("fp")))
    close = fingerprint_pairs(nodes)
    for side, n in (("a", "n"), ("b", "m")):
        close = close.join(nodes.select(F.col("node").alias(side), F.col("n").alias(n)), side)
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("least")).where("size > 1")
    rows = written(rows.join(sizes, "key"))
    fits = F.least("n", "m") >= SIMILAR * F.greatest("n", "m")
    stars = rows.where("node <> least.node").select(F.col("least.node").alias("a"), F.col("node").alias("b"), "n", F.col("least.n").alias("m"))
    linked = _similar(close.where(fits).select("a", "b").union(stars.where(fits).select("a", "b")), nodes, narrow)
    found = _named(rows.select("key", "size", "node", "n"), components(linked))
    # what the stars left apart
    apart = found.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    found = written(found.join(apart, "key"))
    few = found.where(F.col("size") <= PAIR_BUCKET)
    x, y = few.alias("x"), few.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
                  & (F.least("x.n", "y.n") >= SIMILAR * F.greatest("x.n", "y.n"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    crowd = written(found.where(F.col("size") > PAIR_BUCKET).select("node", "component", "n").distinct())
    linked = linked.union(_similar(rest, nodes, narrow))
    if not crowd.isEmpty():
        linked = linked.union(_crowd_links(crowd, nodes, narrow))
    groups = _named(nodes, components(linked))
    smallest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    named = groups.join(smallest, "component").select("node", "component_id")
    return prints.select("id", "node").join(named, "node", "left").select(
        F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def _named(rows: DataFrame, linked: DataFrame) -> DataFrame:
    return rows.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
