"""Periodic runs of words: seeds from repeated word grams, extended along their diagonals."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words and at least two periods. So it equals itself, one period later, over max(12 - q, q)
#: words or more: never under six, and at least K where the period is K or more.
SHORTEST = 12
SEED = 6
#: Words searched together; a longer text is searched alone.
TOGETHER = 200_000
#: Occurrence pairs held at once.
PAIRS = 1 << 20


def _named(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a SEED-gram stands that its document has twice or more, and equal numbers for equal grams. A hash
    finds the few places to look at, the numbers themselves are exact."""
    n = len(w) - SEED + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(SEED):
        h = (h ^ w[k:n + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    order = np.sort(h)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.nonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)[0]
    name, wide = doc[at].astype(np.int64), int(w.max()) + 1
    for k in range(SEED):
        name = np.unique(name * wide + w[at + k], return_inverse=True)[1]
    return _twice(at, name)


def _twice(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, name, many = np.unique(key, return_inverse=True, return_counts=True)
    keep = many[name] > 1
    return at[keep], name[keep]


def _reach(w: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on; i < j."""
    far, size, n = 0, 64, len(w)
    while j + far < n:
        b = w[j + far:j + far + size]
        other = np.nonzero(w[i + far:i + far + len(b)] != b)[0]
        if len(other):
            return far + int(other[0])
        far, size = far + len(b), min(size * 4, 1 << 16)
    return far


def _reach_back(w: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j; i < j."""
    far, size = 0, 64
    while i - far > 0:
        a = w[max(i - far - size, 0):i - far]
        other = np.nonzero(a != w[j - far - len(a):j - far])[0]
        if len(other):
            return far + len(a) - 1 - int(other[-1])
        far, size = far + len(a), min(size * 4, 1 << 16)
    return far


class _Runs:
    """The runs found so far; `over` names a run at every word that one covers."""

    def __init__(self, w: np.ndarray):
        self.w, self.rows, self.seen, self.over, self.painted = w, [], set(), np.full(len(w), -1, np.int32), 0

    def paint(self) -> None:
        for k in range(self.painted, len(self.rows)):
            part = self.over[self.rows[k][0]:self.rows[k][1]]
            part[part < 0] = k
        self.painted = len(self.rows)

    def new(self, i: np.ndarray, q: np.ndarray, block: int) -> np.ndarray:
        """False where known runs prove that no other run lies on the diagonal of the block at i and its copy at i + q.

        Both blocks must lie in runs of one period, not over the block. In the same run, the diagonal is the run
        again. In different runs it ends where either of them ends, unless both end at once.
        """
        keep = np.ones(len(i), bool)
        if not self.rows:
            return keep
        run = np.array(self.rows)
        a, b = self.over[i], self.over[i + q]
        at = np.nonzero((a >= 0) & (b >= 0))[0]
        x, y, i, q = run[a[at]], run[b[at]], i[at], q[at]
        inside = (x[:, 2] == y[:, 2]) & (x[:, 2] <= block) & (i + block <= x[:, 1]) & (i + q + block <= y[:, 1])
        left, other_left, right, other_right = i - x[:, 0], i + q - y[:, 0], x[:, 1] - i, y[:, 1] - i - q
        short = np.minimum(left, other_left) + np.minimum(right, other_right) < np.maximum(SHORTEST - q, q)
        known = (a[at] == b[at]) | ((left != other_left) & (right != other_right) & short)
        keep[at[inside & known]] = False
        return keep

    def extend(self, i: np.ndarray, q: np.ndarray, block: int, covered: dict[int, int]) -> None:
        """Extends pairs, in the order of their places, to whole diagonals; `covered` holds for every lag how far the
        last one went, and pairs before that belong to it."""
        order = np.lexsort((i, q))
        i, q = i[order], q[order]
        first = np.ones(len(i), bool)  # a block that touches the one before it is on the same diagonal
        first[1:] = (q[1:] != q[:-1]) | (i[1:] > i[:-1] + block)
        for at, lag in zip(i[first].tolist(), q[first].tolist(), strict=True):
            if at < covered.get(lag, 0):
                continue
            end = at + _reach(self.w, at, at + lag)
            start = at - _reach_back(self.w, at, at + lag)
            covered[lag] = end
            if end - start >= max(SHORTEST - lag, lag) and (start, end + lag) not in self.seen:
                self.seen.add((start, end + lag))  # lags grow, so the first period of a stretch is its smallest
                self.rows.append((start, end + lag, lag))


def find_runs(w: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs in w, by start, then period. w holds the word numbers of documents one
    after another, parted by numbers that occur once; doc is each place's document.

    Level by level, lags double. Lags under 12 are seeded by all repeated SEED-grams. Lags from K to 2K - 1 are seeded
    by grams of K / 2 words at every K / 2-th place, as one of those lies whole in every match of K words or more; the
    longer grams are named by pairs of the shorter ones. A place has at most some four copies of its gram in reach
    unless the gram is itself periodic, and then known runs settle the pair. So pairs stay near the number of words.
    """
    at, name = _named(w, doc)
    found = _Runs(w)
    full = np.full(len(w) + SHORTEST, -1, np.int64)
    full[at] = name
    for lag in range(1, SHORTEST):
        i = at[full[at] == full[at + lag]]
        i = i[found.new(i, np.full(len(i), lag), SEED)]
        found.extend(i, np.full(len(i), lag), SEED, {})
        found.paint()
    block = SEED
    while len(at):
        order = np.lexsort((at, name))
        places, wide = at[order], len(w) + 1
        key = name[order] * wide + places
        mine = at % block == 0
        seeds, base = at[mine], name[mine] * wide + at[mine]
        lo = np.searchsorted(key, base + 2 * block)
        many = np.searchsorted(key, np.minimum(base + 4 * block, (name[mine] + 1) * wide)) - lo
        seeds, lo, many = seeds[many > 0], lo[many > 0], many[many > 0]
        ends, covered, done = np.cumsum(many), {}, 0
        while done < len(seeds):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, side="right")))
            m = many[done:upto]
            i = np.repeat(seeds[done:upto], m)
            j = places[np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[done:upto], m)]
            keep = found.new(i, j - i, block)
            found.extend(i[keep], (j - i)[keep], block, covered)
            done = upto
        found.paint()
        after = np.full(len(w) + block, -1, np.int64)
        after[at] = name
        two = after[at + block]
        pair = two >= 0
        at, name = _twice(at[pair], name[pair] * (int(name.max()) + 1) + two[pair])
        block *= 2
    return np.array(sorted((s, q, e) for s, e, q in found.rows), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _searched(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, bytes]]:
    """(runs, remaining words joined by spaces) of each text."""
    sizes = np.array([len(t) for t in texts])
    flat = pa.array([word for t in texts for word in t], pa.binary()).dictionary_encode()
    known = len(flat.dictionary)
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    first = np.cumsum(sizes + 1) - sizes - 1
    w = np.zeros(len(doc), np.int64)
    between = first + sizes
    inner = np.ones(len(w), bool)
    inner[between] = False
    w[inner] = flat.indices.to_numpy()
    w[between] = known + np.arange(len(texts))
    rows = find_runs(w, doc)
    bounds = np.searchsorted(rows[:, 0], np.append(first, len(w)))
    for k, words in enumerate(texts):
        mine = rows[bounds[k]:bounds[k + 1]] - [first[k], first[k], 0]
        if len(mine):
            inside = np.zeros(len(words) + 1, np.int64)
            np.add.at(inside, mine[:, 0] + mine[:, 2], 1)
            np.add.at(inside, mine[:, 1], -1)
            words = [word for word, n in zip(words, np.cumsum(inside).tolist(), strict=False) if not n]
        yield mine, b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per input row: id, runs (array of start, length, period, by start, then period) and collapsed, the text
    in UTF-8 without the words that a run repeats, joined by single spaces.

    Words are what white space (space, 0x09 to 0x0D) parts, compared byte by byte. `rewrite` may change the words of a
    document, given its id, before they are searched. Nothing is shuffled. Null and empty texts have no runs and
    collapse to nothing; rows without an id and repeated rows are searched like others; an empty table gives no rows;
    other columns are ignored. A very long text is searched whole in its task, in some 200 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(ids: list, texts: list) -> pa.RecordBatch:
            runs, kept = [], []
            for rows, text in _searched(texts):
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in rows.tolist()])
                kept.append(text)
            of = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, of), pa.array(kept, pa.binary())],
                                              ["id", "runs", "collapsed"])

        for batch in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                if rewrite is not None:
                    words = rewrite(i, words)
                if texts and held + len(words) > TOGETHER:
                    yield flushed(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(words)
                held += len(words)
            if texts:
                yield flushed(ids, texts)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary").withColumnRenamed("id", id_col)


def planted(i: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by the hash of its id repeats a part of itself from some word on; no id, no change."""
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of runs, the longest (ties: smallest start, then period) and digests of runs and remaining text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))

    def whole(c: Column) -> Column:
        return F.when(F.size("runs") > 0, F.concat(F.array_join(c, "\n"), F.lit("\n"))).otherwise("")

    length = -F.col("best.shorter")
    return found.withColumn("best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.expr("(-best.shorter * 1000) div best.period").alias("exponent_milli"),
        F.sha2(whole(lines).cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
