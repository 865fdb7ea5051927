"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import written

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5, 6)
#: Words averaged together; a text's score is that of its most toxic window.
WINDOW = 4
#: Bounds of the labelled sample that the model is fitted on: texts of each label, and bytes in all, half for each label;
#: what one label leaves goes to the other.
SAMPLE_TEXTS, SAMPLE_BYTES = 2_000, 8 << 20
#: Texts over their share of the bytes are represented by random stretches of so many bytes.
STRETCH = 1_000
THRESHOLD = 0.3
#: The greatest score of a text without words, below the threshold whatever the share of toxic labels.
EMPTY_SCORE = 0.1
_SPACE = 32
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else _SPACE for c in range(256))
_CHUNK = 1 << 20


def _bucket(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(15)).astype(np.int32)


@dataclass
class Pieces:
    """Texts side by side: their bytes, where words begin, and which words are whose."""

    raw: np.ndarray  # lower-case bytes; words stand between single or repeated spaces
    starts: np.ndarray  # byte before each word; one more at the end
    first: np.ndarray  # first word of each text; one more at the end

    @classmethod
    def of(cls, texts: list[str | None]) -> Pieces:
        parts = [b" " + (t or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP) for t in texts]
        raw = np.frombuffer(b"".join(parts) + b"  ", dtype=np.uint8)
        space = raw == _SPACE
        starts = np.nonzero(space[:-1] & ~space[1:])[0]
        ends = np.cumsum([len(p) for p in parts])
        first = np.concatenate([[0], np.searchsorted(starts, ends)])
        return cls(raw, np.concatenate([starts, [len(raw) - 2]]), first)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: bucket of the n-gram at every byte, and whether it lies in one word (bounds included)."""
        space = np.concatenate([[0], np.cumsum(self.raw == _SPACE)])
        h = self.raw.astype(np.uint32)
        for n in range(2, GRAMS[-1] + 1):
            if len(self.raw) < n:
                return
            h = h[:len(self.raw) - n + 1] * np.uint32(16_777_619) + self.raw[n - 1:]
            if n in GRAMS:
                inner = space[n - 1:len(space) - 1] - space[1:len(space) - n + 1]
                yield _bucket(h), inner == 0

    def part(self, lo: int, hi: int) -> Pieces:
        """The texts lo to hi - 1 alone."""
        a, b = int(self.first[lo]), int(self.first[hi])
        begin, end = int(self.starts[a]), int(self.starts[b])
        return Pieces(self.raw[begin:end + 2], self.starts[a:b + 1] - begin, self.first[lo:hi + 1] - a)

    def parts(self) -> Iterator[Pieces]:
        """Some texts at a time, about _CHUNK bytes."""
        ends = self.starts[self.first[1:]]
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, int(self.starts[self.first[lo]]) + _CHUNK, side="right")))
            yield self.part(lo, hi)
            lo = hi

    def bag(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams in the windows [a, b) of words, and the window of each."""
        lo, hi = self.starts[a], self.starts[b]
        size = hi - lo
        own = np.repeat(np.arange(len(a)), size)
        at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + lo[own]
        last = len(self.raw) - 1
        h, inner, out, who = self.raw[at].astype(np.uint32), np.ones(len(at), bool), [], []
        for n in range(2, GRAMS[-1] + 1):
            letter = self.raw[np.minimum(at + n - 1, last)]
            h = h * np.uint32(16_777_619) + letter
            if n in GRAMS:
                good = inner & (at + n - 1 <= last)
                out.append(_bucket(h[good]))
                who.append(own[good])
            inner &= letter != _SPACE
        return np.concatenate(out), np.concatenate(who)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end word, text) of every window; a text shorter than a window is one window, an empty one none."""
        counts = np.diff(self.first)
        many = np.where(counts > 0, np.maximum(counts - WINDOW + 1, 1), 0)
        text = np.repeat(np.arange(len(counts)), many)
        a = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + self.first[text]
        return a, np.minimum(a + WINDOW, self.first[text + 1]), text


def _logits(p: Pieces, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows (a, b, text) and the mean value of the n-grams in each."""
    n = len(p.raw)
    total, count = np.zeros(n + 1), np.zeros(n + 1)
    for bucket, good in p.grams():
        total[1:len(bucket) + 1] += np.where(good, values[bucket], 0)
        count[1:len(bucket) + 1] += good
    np.cumsum(total, out=total)
    np.cumsum(count, out=count)
    a, b, text = p.windows()
    lo, hi = p.starts[a], p.starts[b]
    return a, b, text, (total[hi] - total[lo]) / np.maximum(count[hi] - count[lo], 1)


def _best(logit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    best = np.full(n, -np.inf)
    np.maximum.at(best, text, logit)
    return best


@dataclass
class Model:
    values: np.ndarray  # each bucket's embedding times the difference of the two softmax columns
    bias: float
    scale: np.ndarray  # calibration: weight of the best window, of its log count, and constant
    empty: float  # score of a text without words

    def scores(self, texts: list[str | None]) -> np.ndarray:
        p = Pieces.of(texts)
        _, _, text, logit = _logits(p, self.values)
        n = len(texts)
        best = _best(logit + self.bias, text, n)
        many = np.bincount(text, minlength=n)
        with np.errstate(invalid="ignore", over="ignore"):
            z = self.scale[0] * best + self.scale[1] * np.log1p(many) + self.scale[2]
            return np.where(many > 0, 1 / (1 + np.exp(-z)), self.empty)


def fit(texts: list[str], labels: np.ndarray, prior: float, seed: int = 5) -> Model:
    """Embeddings and softmax together, by Adagrad: first on random windows under their text's label, then on the
    most toxic window of each text, so that one insult in a long text counts. A fifth of the sample is kept for the
    calibration of the score. Labels of one kind only teach nothing: every text then scores EMPTY_SCORE at most, so none is
    predicted toxic. So do texts without words, which no word can make toxic."""
    labels = np.asarray(labels)
    empty = min(prior, EMPTY_SCORE)
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, np.array([0.0, 0.0, np.log(max(empty, 1e-9) / (1 - empty))]), empty)
    rng = np.random.default_rng(seed)
    p = Pieces.of(texts)
    held = np.arange(len(texts)) % 5 == 4
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = np.stack([rng.normal(0, 0.5, DIM), rng.normal(0, 0.5, DIM)], axis=1).astype(np.float32)
    bias, seen, seen_soft = np.zeros(2), np.full(BUCKETS, 1e-6), 1e-6
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def learn(a: np.ndarray, b: np.ndarray, text: np.ndarray, rate: float) -> None:
        nonlocal bias, seen_soft
        for part in np.array_split(rng.permutation(len(a)), max(1, len(a) // 256)):
            bucket, who = p.bag(a[part], b[part])
            each = np.maximum(np.bincount(who, minlength=len(part)), 1)
            mean = np.zeros((len(part), DIM))
            for d in range(DIM):
                mean[:, d] = np.bincount(who, table[bucket, d], len(part)) / each
            z = mean @ soft + bias
            prob = 1 / (1 + np.exp(z[:, 0] - z[:, 1]))
            miss = (prob - labels[text[part]]) * balance[text[part]]
            pull = np.bincount(bucket, (miss / each)[who], BUCKETS)
            at = np.nonzero(pull)[0]
            seen[at] += pull[at] ** 2
            way = soft[:, 1] - soft[:, 0]
            slope = (miss @ mean) / len(part)
            table[at] -= (rate * pull[at] / np.sqrt(seen[at]))[:, None] * way / max(np.linalg.norm(way), 1e-6)
            seen_soft += slope @ slope
            step = rate * 0.3 * slope / np.sqrt(seen_soft)
            soft[:, 1] -= step
            soft[:, 0] += step
            bias += rate * 0.1 * miss.mean() * np.array([1, -1])

    def values() -> np.ndarray:
        return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)

    def logits(worth: np.ndarray) -> np.ndarray:
        """Of all windows, in order; a part of the texts at a time, so that memory stays small."""
        return np.concatenate([np.zeros(0, np.float32), *[_logits(part, worth)[3].astype(np.float32) for part in p.parts()]])

    a, b, text = (x.astype(np.int32) for x in p.windows())
    mine = ~held[text]
    for _ in range(3):
        pick = np.nonzero(mine & (rng.random(len(a)) < 24 / np.maximum(np.bincount(text, minlength=len(texts)), 24)[text]))[0]
        learn(a[pick], b[pick], text[pick], 0.15)
    for turn in range(12):
        logit = logits(values())
        order = np.lexsort((-logit, text))
        place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        wide = np.where(labels[text[order]] == 1, 1, 3)  # the worst windows of a clean text are all clean
        pick = order[(place < wide) & mine[order]]
        learn(a[pick], b[pick], text[pick], 0.1 / (1 + turn / 4))
    worth, offset = values(), float(bias[1] - bias[0])
    logit = logits(worth)
    best, many = _best(logit + offset, text, len(texts)), np.bincount(text, minlength=len(texts))
    use = held & (many > 0)
    if len(set(labels[use])) < 2:
        use = many > 0
    x = np.stack([best[use], np.log1p(many[use]), np.ones(use.sum())], axis=1)
    spread = np.maximum(np.abs(x).max(axis=0), 1e-9)
    y, w = labels[use], np.where(labels[use] == 1, prior / labels[use].mean(), (1 - prior) / (1 - labels[use].mean()))
    scale = np.zeros(3)
    for _ in range(60):  # Newton steps of a weighted, slightly damped logistic fit
        q = 1 / (1 + np.exp(-np.clip(x / spread @ scale, -30, 30)))
        grad = (x / spread).T @ (w * (q - y)) + 1e-2 * scale
        curve = (x / spread).T @ ((w * q * (1 - q))[:, None] * (x / spread)) + 1e-2 * np.eye(3)
        scale -= np.linalg.solve(curve, grad)
    return Model(worth, offset, scale / spread, empty)


def _level(sizes: np.ndarray, room: int) -> int:
    """The greatest length to which texts may be cut so that all of them fit."""
    sizes = np.sort(sizes)
    before = np.cumsum(sizes) - sizes
    level = (room - before) // np.maximum(len(sizes) - np.arange(len(sizes)), 1)
    short = np.nonzero(level < sizes)[0]
    return int(max(level[short[0]], 1)) if len(short) else int(max(sizes.max(initial=1), 1))


def _limits(sizes: list[np.ndarray], room: int) -> list[int]:
    """The length limit of each of two labels; a label that needs less than half leaves the rest to the other."""
    need = [int(s.sum()) for s in sizes]
    return [_level(s, max(room // 2, room - need[1 - k])) for k, s in enumerate(sizes)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts over `most` bytes become random stretches of whole words, in their order, of about so many bytes."""
    for batch in batches:
        texts = []
        for key, text, most in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
            raw, most = text.as_py().encode("utf-8", "surrogatepass"), most.as_py()
            if len(raw) > most:
                wide = min(STRETCH, most)
                blocks = max(1, most // wide)
                at = np.sort(np.random.default_rng(zlib.crc32(str(key.as_py()).encode())).choice(len(raw) // wide, blocks, replace=False)) * wide
                raw = b" ".join(_whole(raw, int(a), int(a) + wide) for a in at)
            texts.append(raw.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "label", "text"])


def _whole(raw: bytes, a: int, b: int) -> bytes:
    """The words that lie whole in raw[a:b]; all of it if there is no white space."""
    words = raw[max(a - 1, 0):b + 1].split()
    inner = words[int(a > 0 and not raw[a - 1:a].isspace()):len(words) - int(b < len(raw) and not raw[b:b + 1].isspace())]
    return b" ".join(inner) or raw[a:b]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model fitted on a bounded sample of the labelled documents outside the held-out quarter.

    The sample is SAMPLE_TEXTS texts of each label, by a hash of the id; none of them is left out for its size. Where a
    label's texts exceed its share of SAMPLE_BYTES, its longest are cut to one common length, in random stretches.
    Repeated labels of a document count as its greatest, of repeated texts the least counts; null labels and documents
    without a text are left out.
    """
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "id is not null and label is not null and pmod(crc32(cast(cast(id as string) as binary)), 4) <> 2")
    named = named.groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in named.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    by_hash = [F.xxhash64("id"), F.col("id")]
    drawn = named.where("label > 0").orderBy(*by_hash).limit(SAMPLE_TEXTS).union(
        named.where("label <= 0").orderBy(*by_hash).limit(SAMPLE_TEXTS))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    picked = written(texts.join(F.broadcast(drawn), "id").groupBy("id").agg(
        F.min("text").alias("text"), F.max((F.col("label") > 0).cast("int")).alias("label")))
    sizes = picked.select("label", F.octet_length("text").alias("size")).toPandas()
    limits = _limits([sizes["size"][sizes["label"] == k].to_numpy(np.int64) for k in (0, 1)], SAMPLE_BYTES)
    limit = F.when(F.col("label") == 1, limits[1]).otherwise(limits[0])
    sample = (picked.select("id", "label", "text", limit.cast("long").alias("most")).mapInArrow(_cut, "id long, label int, text string")
              .withColumn("h", F.xxhash64("id")).toPandas().sort_values(["h", "id"]))
    return fit(sample["text"].tolist(), sample["label"].to_numpy(), prior)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted. The model goes to every task (half a megabyte); nothing
    is shuffled. Null texts score like empty ones, the share of toxic labels but at most EMPTY_SCORE; rows without an id
    are not held out. A very long text is scored whole in its task; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores, held = [], [], 0
            for t in batch.column(1):
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held > _CHUNK:
                    scores.append(shared.value.scores(texts))
                    texts, held = [], 0
            scores.append(shared.value.scores(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], ["id", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, score double").select(
        F.col("id").alias(id_col), F.coalesce(F.expr("pmod(crc32(cast(cast(id as string) as binary)), 4) = 2"), F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents, then score them all."""
    return scored(docs, train(docs, labels))
