"""Bulk-synchronous best-fit packing of token sequences."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import ranked, written

CAPACITY = 2048
END = b"\0\0\0\0"
#: Words, and lower-case parts of words, whose ids a worker remembers.
REMEMBERED, REMEMBERED_PARTS = 800_000, 200_000
#: Bytes of text that are looked up at once; a longer text is a chunk of its own.
CHUNK = 8 << 20
_WORD = re.compile(r"[^ \t\n\r]+")
_LETTERS = re.compile(r"[a-z\u00e0-\u00f6\u00f8-\u00ff]+").fullmatch
#: Of each byte: 1 white space, 2 a sign that ends words, 3 an ASCII letter.
_KIND = np.array([1 if c in b" \t\n\r" else 2 if c in b".,;:!?" else 3 if chr(c).isalpha() and c < 128 else 0
                  for c in range(256)], np.uint8)
_LOWER = np.array([c | 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: First bytes of the marks that may combine with a letter before them (U+0300 to U+036F).
_MARKS = np.array([0xCC, 0xCD], np.uint8)
_LATIN = re.compile(r"[!-~\u00a1-\u024f]+").fullmatch
#: How this vocabulary cuts a lower-case word before its merges; all white space is gone by then.
_PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_signs() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Token ids of whole texts, as little-endian bytes.

    The tokenizer never merges across white space, so a text's ids are those of its words, and a word's are those of
    the parts between which it never merges either; both are remembered. Parts of printable words in Latin letters,
    which need no normalisation but lower case, go to the tokenizer's merges at once, all other words to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.parts, self.signs = Tokenizer.from_file(path), {}, {}, _byte_signs()
        self.merges = self.tokenizer.model

    def _merged(self, part: str) -> bytes:
        found = self.merges.tokenize(part.encode().decode("latin-1").translate(self.signs))
        return array("I", [t.id for t in found]).tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word or not _LATIN(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        if low.isalpha():
            parts = (low,)
        elif low[-1] in ".,;:!?" and low[:-1].isalpha():
            parts = (low[:-1], low[-1])
        else:
            parts = _PART.findall(low)
        out = []
        for part in parts:
            ids = self.parts.get(part)
            if ids is None:
                if len(self.parts) >= REMEMBERED_PARTS:
                    self.parts.clear()
                ids = self.parts[part] = self._merged(part)
            out.append(ids)
        return b"".join(out)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        known, letters = self.known, _LETTERS
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self._merged(w) if letters(w) else b"".join(map(self._word, _WORD.findall(w)))
                known[w] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype="<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; null counts as empty.

        Texts are taken side by side, some CHUNK bytes at a time, and cut around white space and before a sign that
        ends a word, where no merge reaches across; each different cut of the chunk is looked up once. Letters are
        made lower case before, as the tokenizer does, save where marks or special tokens might see the difference.
        """
        texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
            part, first = raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
            if not (np.isin(part, _MARKS).any() or ((part[:-1] == 60) & (part[1:] == 124)).any()):
                part = _LOWER[part]
            kind = _KIND[part]
            cut = kind == 1
            cut[1:] |= (kind[:-1] == 1) | ((kind[1:] == 2) & (kind[:-1] == 3))
            cut[first[first < len(part)]] = True
            starts = np.append(np.nonzero(cut)[0], len(part))
            words = pa.LargeStringArray.from_buffers(
                len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(part)).dictionary_encode()
            flat, many = self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            code = words.indices.to_numpy()
            n = many[code]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat((np.cumsum(many) - many)[code] - ends[:-1], n) + np.arange(ends[-1])]
            bounds = ends[np.searchsorted(starts, first)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield ids[a:b].tobytes()
            lo = hi


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, crc) of every document: its ids and an end id 0, cut where it is longer than a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids += END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)],
                ["id", "piece", "start", "length", "crc"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, piece int, start long, length long, crc long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit over sorted lengths and gaps. Rows (length, first rank, first sequence, pieces per sequence, offset).

    One superstep per length, longest first: its pieces, known by their ranks, sweep over the gaps in ascending order
    from the successor of their length; the lowest ranks take the lowest gaps, as many per sequence as fit; the gaps
    touched are updated at once and the next length follows. Pieces that meet no gap open sequences. Sequences with
    the same past are one run, so the state has a few runs per length, and a run meets at most 63 different lengths
    (their sum must fit 2048): its size is bounded by the capacity, whatever the number of documents.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs of (first sequence, sequences)
    gaps: list[int] = []
    rows, opened = [], 0

    def put(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(gap: int, first: int, many: int | None) -> int:
            """Puts pieces into up to `many` sequences of this gap (None: new ones); how many it used."""
            nonlocal left, rank
            each = gap // length
            full = left // each if many is None else min(many, left // each)
            used = 0
            for sequences, here in ((full, each), (1, left - full * each)):
                if sequences and here and (many is None or used < many) and left:
                    rows.append((length, rank, first + used, here, capacity - gap))
                    put(gap - here * length, first + used, sequences)
                    used += sequences
                    left -= sequences * here
                    rank += sequences * here
                if many is not None and used == many:
                    break
            return used

        at = bisect_left(gaps, length)
        while left and at < len(gaps):
            gap = gaps[at]
            mine = runs.pop(gap)
            gaps.pop(at)
            before = len(gaps)
            while mine and left:
                first, many = mine.pop()
                used = fill(gap, first, many)
                if used < many:
                    mine.append((first + used, many - used))
            at += len(gaps) - before  # new gaps are smaller than this one
            if mine:
                runs[gap] = mine
                insort(gaps, gap)
        if left:
            opened += fill(capacity, opened, None)
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def best_fit(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are ranked within their length by hashed slices, no length is one task's; the lengths' counts (at most
    `capacity` rows) give the plan, and every task looks its pieces up in it by (length, rank). Null and empty texts
    are one end id. Rows without an id and repeated rows are packed like others; equal pieces may swap places. A very
    long text is encoded whole in its task and leaves as pieces. An empty table gives no rows.
    """
    cut = written(pieces(docs, tokenizer, id_col, text_col, capacity))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = plan(counts, capacity)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(steps)
    placed = ranked(cut, ["length"], ["id", "piece", "start", "crc"], sum(counts.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        firsts = np.searchsorted(steps[:, 0], np.arange(capacity + 2)) if len(steps) else np.zeros(capacity + 2, np.int64)
        wide = int(steps[:, 1].max()) + 1 if len(steps) else 1
        order = steps[:, 0] * wide + steps[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            row = np.searchsorted(order, length * wide + np.minimum(rank, wide - 1), side="right") - 1
            step = steps[np.maximum(row, firsts[length])]
            nth = rank - step[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(step[:, 2] + nth // step[:, 3]), pa.array(step[:, 4] + nth % step[:, 3] * length)],
                ["id", "piece", "start", "length", "crc", "sequence_id", "offset"])

    found = placed.select("id", "piece", "start", "length", "crc", "rank").mapInArrow(
        run, "id long, piece int, start long, length long, crc long, sequence_id long, offset long")
    return found.withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})
