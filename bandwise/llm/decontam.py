"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import written

#: Token positions that each mask reads; the others may hold anything. Chosen by enumeration: whatever tokens an overlap
#: of 8 to 13 tokens (or a stretch of 13 in a longer one) may have changed, one mask fits between them.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 6, 7), (0, 2, 3, 4, 5, 7), (0, 1, 2, 3, 4, 5), (0, 1, 3, 5, 7, 8))
SPAN = 8
#: Items of fewer than SPAN tokens, down to this many, are hashed whole: as they are, and, where EQUAL lets a token
#: differ, without each token in turn.
SHORTEST = 3
#: An overlap is a run of this many aligned tokens (the whole item, where that is shorter) ...
OVERLAP = 13
#: ... of which this share is equal.
EQUAL = 0.8
#: Tokens kept on both sides of a hit.
AROUND = 2 * OVERLAP
#: The driver holds one bit for each of so many hash values of the benchmark, whatever its size.
FILTER_BITS = 1 << 25
_WORD = re.compile(r"\w+")
_MIX = np.random.default_rng(8_201).integers(1, 1 << 62, (len(MASKS), len(MASKS[0])), dtype=np.int64).astype(np.uint64) * 2 + 1
_SHORT_MIX = np.random.default_rng(8_202).integers(1, 1 << 62, (SPAN, SPAN, SPAN), dtype=np.int64).astype(np.uint64) * 2 + 1
_CHUNK = 400_000


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _hashed(t: np.ndarray, mask: tuple[int, ...], mix: np.ndarray, span: int) -> np.ndarray:
    n = len(t) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = t[mask[0]:mask[0] + n] * mix[0]
    for at, m in zip(mask[1:], mix[1:], strict=True):
        h += t[at:at + n] * m
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(32))


def seeds(t: np.ndarray) -> list[np.ndarray]:
    """For each mask, the hash at every token position that has room for it."""
    return [_hashed(t, mask, mix, mask[-1] + 1) for mask, mix in zip(MASKS, _MIX, strict=True)]


def _whole_masks(n: int) -> list[tuple[int, ...]]:
    """The token positions that are hashed for a short item of n tokens."""
    whole = tuple(range(n))
    return [whole, *[whole[:k] + whole[k + 1:] for k in range(n)]] if n - 1 >= EQUAL * n else [whole]


def short_seeds(t: np.ndarray, n: int) -> list[np.ndarray]:
    """For each mask of items of n tokens, the hash at every token position that has room for such an item."""
    return [_hashed(t, mask, _SHORT_MIX[n, k, :len(mask)], n) for k, mask in enumerate(_whole_masks(n))]


def _own_seeds(t: np.ndarray) -> list[np.ndarray]:
    """The seeds of an item."""
    return short_seeds(t, len(t)) if SHORTEST <= len(t) < SPAN else seeds(t)


def _item_seeds(items: DataFrame) -> DataFrame:
    """(item, tokens, seeds (h, at)) of the benchmark rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts = [tokens(t.as_py()) for t in batch.column(1)]
            hs = [[{"h": int(h), "at": k} for s in _own_seeds(t) for k, h in enumerate(s.view(np.int64))] for t in ts]
            kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.view(np.int64) for t in ts], pa.list_(pa.int64())), pa.array(hs, kind)],
                ["item", "tokens", "seeds"])

    return items.mapInArrow(run, "item long, tokens array<long>, seeds array<struct<h: long, at: int>>")


def _filter_words(hashes: DataFrame) -> np.ndarray:
    """A bit map of fixed size with the low bits of every hash."""
    low = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = (hashes.select(F.floor(low / 64).alias("w"), F.expr(f"shiftleft(1L, int((h & {FILTER_BITS - 1}) % 64))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits


def _runs(ids: list, ts: list[np.ndarray], bits: np.ndarray, short: list[int]) -> Iterator[tuple]:
    """(id, first token kept, tokens kept, hashes, their places) for each stretch of filter hits in documents; `short`
    holds the lengths of the benchmark's short items."""
    ends = np.cumsum([len(t) for t in ts])
    if not len(ends) or not ends[-1]:
        return
    t = np.concatenate(ts)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ts)), np.diff(np.concatenate([[0], ends])))
    at, hs = [], []
    for h in [*seeds(t), *[h for n in short for h in short_seeds(t, n)]]:
        low = h & np.uint64(FILTER_BITS - 1)
        hit = np.nonzero((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1))[0]
        hit = hit[doc[hit] == doc[hit + len(t) - len(h)]]
        at.append(hit)
        hs.append(h[hit])
    at, hs = np.concatenate(at), np.concatenate(hs)
    order = np.argsort(at, kind="stable")
    at, hs = at[order], hs[order].view(np.int64)
    cuts = np.nonzero((np.diff(at) > SPAN) | (np.diff(doc[at]) != 0))[0] + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]), strict=True):
        if a == b:
            continue
        d = doc[at[a]]
        lo, hi = max(starts[d], at[a] - AROUND), min(ends[d], at[b - 1] + SPAN + AROUND)
        yield ids[d], int(lo - starts[d]), t[lo:hi].view(np.int64), hs[a:b], (at[a:b] - lo).astype(np.int32)


def _filtered(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)
    names = ["id", "start", "tokens", "hs", "at"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts, held = [], [], 0
            for k in range(len(batch) + 1):
                if k == len(batch) or held > _CHUNK:
                    found = list(_runs(ids, ts, shared.value, short))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)], names)
                    ids, ts, held = [], [], 0
                if k < len(batch):
                    ids.append(batch.column(0)[k].as_py())
                    ts.append(tokens(batch.column(1)[k].as_py()))
                    held += len(ts[-1])

    return docs.mapInArrow(run, "id long, start long, tokens array<long>, hs array<long>, at array<int>")


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(first, end, equal tokens) of the overlap in doc, when item's token 0 lies at place `shift` of doc."""
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    wide = min(OVERLAP, len(item))
    if hi - lo < wide:
        return None
    same = doc[lo:hi] == item[lo - shift:hi - shift]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.nonzero(sums[wide:] - sums[:-wide] >= EQUAL * wide)[0]
    if not len(good):
        return None
    inside = np.zeros(len(same) + 1, dtype=np.int64)
    np.add.at(inside, good, 1)
    np.add.at(inside, good + wide, -1)
    covered = np.nonzero((np.cumsum(inside)[:-1] > 0) & same)[0]
    return int(lo + covered[0]), int(lo + covered[-1] + 1), int(len(covered))


def _verified(candidates: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                got = overlap(np.array(r["tokens"], np.int64), np.array(r["item_tokens"], np.int64), r["shift"])
                if got:
                    rows.append((r["id"], r["item"], r["start"] + got[0], r["start"] + got[1], got[2], len(r["item_tokens"])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                 ["id", "item", "first", "end", "equal", "item_words"])

    return candidates.mapInArrow(run, "id long, item long, first long, end long, equal long, item_words long")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, benchmark item) that overlap: id, item, first_word, end_word, equal_words, item_words.

    Words are lower-cased runs of word characters. Five masks hash six words of at most nine, so that whatever words an
    overlap may have substituted, one of them hits; items of 3 to 7 words are hashed whole and, from 5 words on, without
    each word in turn. Document hashes that pass the benchmark's bit map are joined with its hashes; around
    each hit the texts are laid side by side, and they overlap where 13 words in a row (the whole item, if that is
    shorter) are equal in at least 80 %. Only stretches around hits are shuffled, never whole texts; popular passages
    are shuffled as rows of an equi-join, which the engine may split.

    Null and empty texts overlap with nothing; so do items of one or two words, which prove nothing. Repeated
    documents and items are reported once per id; rows without an id are reported with a null id. A very long text is
    read whole in its task, however long; without documents or without items there are no rows.
    """
    items = written(_item_seeds(benchmark.select(F.col(item_col).cast("long").alias("item"),
                                                 F.col(item_text).cast("string").alias("text")))
                    .withColumn("ref", F.monotonically_increasing_id()))
    hashes = items.select("ref", F.explode("seeds").alias("s")).select("ref", "s.h", F.col("s.at").alias("item_at"))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lengths = items.select(F.size("tokens").alias("n")).where(f"n >= {SHORTEST} and n < {SPAN}").distinct().collect()
    runs = written(_filtered(narrow, _filter_words(hashes), sorted(r["n"] for r in lengths)).withColumn("run", F.monotonically_increasing_id()))
    hits = runs.select("run", F.explode(F.arrays_zip("hs", "at")).alias("z")).select(
        "run", F.col("z.hs").alias("h"), F.col("z.at").alias("at"))
    pairs = hits.join(hashes, "h").groupBy("run", "ref", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.count("*").alias("hits")).drop("hits")
    candidates = pairs.join(runs.select("run", "id", "start", "tokens"), "run").join(
        items.select("ref", "item", F.col("tokens").alias("item_tokens")), "ref")
    return _verified(candidates.select("id", "start", "tokens", "item", "item_tokens", "shift")).groupBy("id", "item").agg(
        F.min("first").alias("first_word"), F.max("end").alias("end_word"), F.max("equal").alias("equal_words"),
        F.max("item_words").alias("item_words")).withColumnsRenamed({"id": id_col, "item": item_col})
