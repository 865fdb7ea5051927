"""The page archive as a data source: packs of pages by source and day, read in part, written in batches, followed as a
stream.

    pages.write.format("page_archive").mode("append").save(folder)
    spark.read.format("page_archive").load(folder).where("source = 'bat' and fetch_date >= date'2025-01-01'")
    spark.readStream.format("page_archive").load(folder)

A pack is an Arrow file with one record batch (or more, if large) per day of one source, so that a quiet day is a piece of
a file and no file of its own. Every write ends with a list of its packs and their days below `_log`, numbered by write;
packs that no list names do not exist for readers, so a failed write leaves nothing. One write at a time. The folder must
be one that the driver and all executors reach.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

PAGES = ("page_id bigint, source string, url string, fetched_at timestamp, content string, content_type string, "
         "status_code int, fetch_date date")
_ARROW = pa.schema([("page_id", pa.int64()), ("source", pa.string()), ("url", pa.string()), ("fetched_at", pa.timestamp("us", "UTC")),
                    ("content", pa.string()), ("content_type", pa.string()), ("status_code", pa.int32()), ("fetch_date", pa.date32())])
#: Bytes that a pack's batch, and the batches read by one task, hold about.
BATCH_BYTES, TASK_BYTES = 32 << 20, 128 << 20


@dataclass
class Piece:
    """One record batch of a pack."""

    file: str
    batch: int
    source: str | None
    day: str | None
    size: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


@dataclass
class Packed(WriterCommitMessage):
    pieces: list[Piece]


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


def _writes(path: str) -> list[int]:
    """The numbers of the finished writes."""
    store, root = _store(path)
    found = store.get_file_info(pa.fs.FileSelector(f"{root}/_log", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))


def _pieces(path: str, writes: list[int]) -> list[Piece]:
    store, root = _store(path)
    out = []
    for n in writes:
        with store.open_input_stream(f"{root}/_log/{n:010}.json") as file:
            out += [Piece(*p) for p in json.loads(file.read())]
    return out


def _grouped(pieces: list[Piece]) -> list[Pieces]:
    """Pieces of about TASK_BYTES for each task, those of one pack together."""
    out, held = [], 0
    for piece in sorted(pieces, key=lambda p: (p.file, p.batch)):
        if not out or held + piece.size > TASK_BYTES:
            out.append(Pieces([]))
            held = 0
        out[-1].pieces.append(piece)
        held += piece.size
    return out


def _read(path: str, partition: Pieces | None) -> Iterator[pa.RecordBatch]:
    store, root = _store(path)
    by_file = defaultdict(list)
    for piece in partition.pieces if partition is not None else []:  # no piece planned: one task without any
        by_file[piece.file].append(piece.batch)
    for name, batches in by_file.items():
        with store.open_input_file(f"{root}/{name}") as file, pa.ipc.open_file(file) as pack:
            for k in batches:
                yield pack.get_batch(k)


class ArchiveReader(DataSourceReader):
    """Plans the pieces whose source and day the filters allow; the filters run again on the rows."""

    def __init__(self, path: str):
        self.path, self.wanted = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) in (("source",), ("fetch_date",)):
                self.wanted.append(f)
            yield f

    def _allows(self, piece: Piece) -> bool:
        day = piece.day and dt.date.fromisoformat(piece.day)
        for f in self.wanted:
            value = piece.source if f.attribute == ("source",) else day
            if isinstance(f, EqualTo):
                good = value == f.value
            elif isinstance(f, In):
                good = value in f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if value is None:
                    return False
                good = {GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value,
                        LessThan: value < f.value, LessThanOrEqual: value <= f.value}[type(f)]
            else:
                good = True
            if not good:
                return False
        return True

    def partitions(self) -> list[Pieces]:
        return _grouped([p for p in _pieces(self.path, _writes(self.path)) if self._allows(p)])

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, partition)


class ArchiveStream(DataSourceStreamReader):
    """The offset is the number of the next write."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"write": 0}

    def latestOffset(self) -> dict:
        return {"write": max(_writes(self.path), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return _grouped(_pieces(self.path, [n for n in _writes(self.path) if start["write"] <= n < end["write"]]))

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, partition)


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes one pack; the driver lists them when all are there."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packed:
        store, root = _store(self.path)
        store.create_dir(f"{root}/packs", recursive=True)
        name, pieces, held, key, size = f"packs/{uuid.uuid4().hex}.arrow", [], [], None, 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with store.open_output_stream(f"{root}/{name}") as file, pa.ipc.new_file(file, _ARROW, options=options) as pack:

            def put() -> None:
                if held:
                    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    pack.write_batch(batch)
                    pieces.append(Piece(name, len(pieces), key[0], key[1] and key[1].isoformat(), batch.nbytes))

            for batch in iterator:
                batch = pa.RecordBatch.from_arrays([batch.column(n).cast(t) for n, t in zip(_ARROW.names, _ARROW.types, strict=True)], schema=_ARROW)
                for part in _runs(batch):
                    now = (part.column("source")[0].as_py(), part.column("fetch_date")[0].as_py())
                    if now != key or size + part.nbytes > BATCH_BYTES:
                        put()
                        held, key, size = [], now, 0
                    held.append(part)
                    size += part.nbytes
            put()
        if not pieces:
            store.delete_file(f"{root}/{name}")
        return Packed(pieces)

    def commit(self, messages: list[Packed | None]) -> None:
        store, root = _store(self.path)
        pieces = [vars(p) for m in messages if m is not None for p in m.pieces]
        store.create_dir(f"{root}/_log", recursive=True)
        number = max(_writes(self.path), default=-1) + 1
        with store.open_output_stream(f"{root}/_log/.{number:010}") as file:
            file.write(json.dumps([list(p.values()) for p in pieces]).encode())
        store.move(f"{root}/_log/.{number:010}", f"{root}/_log/{number:010}.json")

    def abort(self, messages: list[Packed | None]) -> None:
        store, root = _store(self.path)
        for name in {p.file for m in messages if m is not None for p in m.pieces}:
            store.delete_file(f"{root}/{name}")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of one source and day."""
    if not batch.num_rows:
        return
    source, day = batch.column("source"), batch.column("fetch_date")
    keys = pa.StructArray.from_arrays([pc.fill_null(source, "\0"), pc.fill_null(day.cast(pa.int32()), -(1 << 31))], ["s", "d"])
    pairs = keys.to_pylist()
    start = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k] != pairs[start]:
            yield batch.slice(start, k - start)
            start = k


class PageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageArchive)


def write_pages(pages: DataFrame, folder: str, empty: bool = False) -> None:
    """Append the pages that have content, or, with `empty`, those without as well (a page that is gone, say). Pages of
    a source lie together, by day; large sources are split by size."""
    register(pages.sparkSession)
    names = [c.split()[0] for c in PAGES.split(", ")]
    rows = pages.where(F.lit(empty) | (F.length("content") > 0)).withColumn("fetch_date", F.col("fetched_at").cast("date")).select(*names)
    rows.hint("rebalance", "source").sortWithinPartitions("source", "fetch_date").write.format("page_archive").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format("page_archive").load(folder)


def follow_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of every write from the first on, write by write."""
    register(spark)
    return spark.readStream.format("page_archive").load(folder)
