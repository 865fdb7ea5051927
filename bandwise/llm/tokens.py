"""Token ids of documents in Parquet list columns: files in id order that can be read in part."""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwise.llm.common import shared_folder

END = 2
#: Bytes of text looked up at once, and different pieces of text whose ids a worker remembers.
CHUNK, REMEMBERED = 4 << 20, 500_000
#: Bytes of text that one file takes, about; a file is one task's.
FILE_BYTES = 256 << 20
#: How the files are laid out: ids by dictionary (bit-packed codes of the ids that a row group holds), numbers as deltas
#: (format 2), row groups small enough to be skipped, pages of bounded rows so that the page index finds single documents.
LAYOUT = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
          "parquet.dictionary.page.size": str(1 << 20), "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10),
          "parquet.page.row.count.limit": "1000", "compression": "snappy"}


#: A piece of text that the byte-level cut leaves whole.
_WHOLE = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+").fullmatch
#: Of each byte: 1 space or line feed, 2 other ASCII signs, 3 ASCII letter, 4 ASCII digit, 0 all others.
_KIND = np.array([1 if c in b" \n" else 3 if chr(c).isalpha() else 4 if chr(c).isdigit() else 2 if 32 < c < 127 else 0
                  for c in range(128)] + [0] * 128, np.uint8)


def _byte_signs() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteIds:
    """Token ids of whole texts.

    The byte-level cut of the vocabulary never puts white space or a sign behind the letters of a piece, so a text may
    be cut there, and each different piece of a chunk is looked up once. Where an added token occurs, or the tokenizer
    file cuts or normalises in another way, whole texts go to the tokenizer instead.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.signs = Tokenizer.from_file(path), {}, _byte_signs()
        self.merges = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        cut, model = said.get("pre_tokenizer") or {}, said["model"]
        self.added = [t["content"].encode() for t in said.get("added_tokens", [])]
        self.parted = (cut.get("type") == "ByteLevel" and cut.get("use_regex") is True and not cut.get("add_prefix_space")
                       and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
                       and all(said.get(k) is None for k in ("normalizer", "truncation", "padding")))

    def _encoded(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _looked_up(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each piece, as bytes."""
        known = self.known
        found = list(map(known.get, parts))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
        several, merged, signs = [], self.merges.tokenize, self.signs
        for k in missing:
            piece = parts[k]
            if piece[:1] == b" " and piece[1:].isalpha():
                tokens = merged("\u0120" + piece[1:].decode())  # the sign of a space
            elif _WHOLE(piece.decode("utf-8", "replace")):
                tokens = merged(piece.decode("latin-1").translate(signs))
            else:
                several.append(k)
                continue
            found[k] = known[piece] = array("I", [t.id for t in tokens]).tobytes()
        for k, ids in zip(several, self._encoded([parts[k].decode("utf-8", "replace") for k in several]), strict=True):
            found[k] = known[parts[k]] = ids.tobytes()
        return found

    def __call__(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time, in order: the ids of all, and how many each has. Null counts as empty."""
        texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw, lo = np.frombuffer(texts.buffers()[2] or b"", np.uint8), 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
            part, first = raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
            whole = part.tobytes()
            if self.parted and not any(t in whole for t in self.added):
                yield self._parted(part, first)
            else:
                ids = self._encoded([whole[a:b].decode("utf-8", "replace") for a, b in zip(first[:-1], first[1:], strict=True)])
                yield np.concatenate(ids), np.array([len(x) for x in ids])
            lo = hi

    def _parted(self, part: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _KIND[part]
        # a printable ASCII character, or a two-byte character of U+00C0 or above, is no white space
        solid = kind > 1
        solid[1:] |= (part[1:] >= 128) & (part[:-1] >= 0xC3) & (part[:-1] < 0xE0)
        cut = np.zeros(len(part), bool)
        cut[1:] = (solid[:-1] & (kind[1:] == 1)) | ((kind[:-1] == 3) & (kind[1:] == 2))
        cut[first[first < len(part)]] = True
        starts = np.append(np.nonzero(cut)[0], len(part))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(part))])
        coded = pieces.dictionary_encode()
        ids = self._looked_up(coded.dictionary.to_pylist())
        many = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        code = coded.indices.to_numpy()
        n = many[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if max(len(flat), ends[-1]) < 1 << 31 else np.int64
        out = flat[np.repeat(((np.cumsum(many) - many)[code] - ends[:-1]).astype(kind), n) + np.arange(ends[-1], dtype=kind)]
        return out, np.diff(ends[np.searchsorted(starts, first)])


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> ByteIds:
    """One per worker process, so that its tasks share what it remembers."""
    return ByteIds(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """Writes the ids of every document, with the end id, to Parquet files in `folder`: rows (doc_id, file, offset,
    n_tokens, ids) in ascending order of doc_id within and across files, where offset counts the ids before it in the file.

    Texts are dealt to tasks by ranges of (id, hash of the text), so an id that very many rows share is spread as well,
    and encoded in the order in which they are written; ids never pass a shuffle. Rows without an id come first. Equal
    ids are ordered by their texts. A null text is the end id alone. A very long text is one row, so its ids must fit a
    row (2 GB). An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    order = [F.col("id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(max(1, -(-size // FILE_BYTES), min(64, -(-size // (8 << 20)))), *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = _encoder(tokenizer), 0
        for batch in batches:
            done = 0
            for ids, many in encode(batch.column(2)):
                ends = np.cumsum(many + 1)
                out = np.full(int(ends[-1]), end, np.uint32)
                spot = np.ones(len(out), bool)
                spot[ends - 1] = False
                out[spot] = ids
                part = batch.slice(done, len(many))
                starts = ends - many - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(starts + before), pa.array(many + 1),
                     pa.ListArray.from_arrays(pa.array(np.append(starts, len(out)), pa.int32()), pa.array(out.view(np.int32)))],
                    ["doc_id", "file", "offset", "n_tokens", "ids"])
                before += len(out)
                done += len(many)

    named = dealt.select("id", F.spark_partition_id().alias("file"), F.col("text").cast("binary"))
    encoded = named.mapInArrow(run, "doc_id long, file int, offset long, n_tokens long, ids array<int>")
    encoded.write.options(**LAYOUT).parquet(folder)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, file int, offset long, n_tokens long, ids array<int>").parquet(folder)


def _placed(rows: DataFrame, folder: str) -> DataFrame:
    """rows with start = the tokens of all earlier files + offset, instead of file and offset."""
    files = _rows(rows.sparkSession, folder).groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0).cast("long")).alias("base"))
    return rows.join(files, "file").withColumn("start", F.col("base") + F.col("offset")).drop("file", "offset", "base")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_tokens, ids, start) of the documents in `folder`; start counts the ids of all documents before it.

    The files' totals come from their number columns alone; a reader that selects no ids never reads them, and one that
    asks for some doc_id reads the row groups and pages that may hold it.
    """
    return _placed(_rows(spark, folder), folder)


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian 32-bit numbers, of every document in
    `folder`. The ids are read once, in file order, and go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], ["doc_id", "file", "offset", "n_tokens", "ids_crc32"])

    found = _rows(spark, folder).mapInArrow(run, "doc_id long, file int, offset long, n_tokens long, ids_crc32 long")
    return _placed(found, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids to a new shared folder; its name."""
    folder = shared_folder(docs.sparkSession)
    write_tokens(docs, folder, tokenizer, id_col, text_col)
    return folder
