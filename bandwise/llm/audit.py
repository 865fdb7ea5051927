"""Filter interaction audit by contraction of contingency tensors."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The filters, one axis of the tensor each: A few words, B few different words, C many capitals, D signs, E repeated text.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SIGNS = b"#$%&*|"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_PASS, _FAIL, _ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])


def failures(raw: bytes) -> int:
    """Which of A to D a text fails, as the bits 8, 4, 2, 1."""
    words = raw.split()  # bytes split at space and 0x09 to 0x0D only
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    points = len(raw.translate(None, _CONTINUED))
    return (8 * (len(words) < MIN_WORDS) + 4 * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
            + 2 * (100 * capitals > CAPITAL_PERCENT * points) + (len(raw.translate(None, SIGNS)) < len(raw)))


def _tested(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, bits, digest) of every row; equal digests (128 bits) are equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, digests = [], []
            for text in batch.column(2):
                raw = text.as_py() or b""
                bits.append(failures(raw))
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())],
                                             ["id", "part", "bits", "digest"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                         F.col(text_col).cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "id long, part string, bits int, digest binary")


def tensors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, n, good, toxic): three arrays of 32 counts, by the outcome of the filters A, B, C, D, E, A the highest bit.

    Only narrow rows leave the texts' tasks. Equal texts are counted per (text, part, labels) with map-side combine
    before they meet, so a group of copies of any size arrives as a few rows; how many of its rows hold the group's
    least id is carried along, as these are the ones that pass E.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").eqNullSafe(1).alias("good"),
                          F.col("toxic").eqNullSafe(1).alias("toxic")).where("id is not null")
    marks = marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = _tested(docs, id_col, text_col, part_col).join(marks, "id", "left").fillna(False, ["good", "toxic"])
    kind = ["digest", "part", "bits", "good", "toxic"]
    ids = rows.groupBy("id", *kind).agg(F.count("*").alias("n"))
    groups = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct(F.col("id").isNull().alias("late"), "id", "n")).alias("first"))
    least = F.min(F.struct("first.late", "first.id")).over(Window.partitionBy("digest"))
    passing = F.when(F.struct("first.late", "first.id").eqNullSafe(least), F.col("first.n")).otherwise(0)
    groups = groups.withColumn("passing", passing)
    cells = groups.select("part", "good", "toxic", F.explode(F.array(
        F.struct((F.col("bits") * 2).alias("cell"), F.col("passing").alias("n")),
        F.struct((F.col("bits") * 2 + 1).alias("cell"), (F.col("n") - F.col("passing")).alias("n")))).alias("c"))
    cells = cells.groupBy("part", F.col("c.cell").alias("cell")).agg(
        F.sum("c.n").alias("n"), *[F.sum(F.when(F.col(m), F.col("c.n")).otherwise(0)).alias(m) for m in ("good", "toxic")])

    def counts(column: str) -> F.Column:
        return F.array(*[F.sum(F.when(F.col("cell") == k, F.col(column)).otherwise(0)) for k in range(32)]).alias(column)

    return cells.groupBy("part").agg(counts("n"), counts("good"), counts("toxic"))


def _selectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 600 (order, step): what it takes along each axis for removed, kept, and failing only here."""
    removed, kept, alone = [], [], []
    for order in ORDERS:
        for step, name in enumerate(order):
            before = order[:step]
            removed.append([_PASS if f in before else _FAIL if f == name else _ALL for f in FILTERS])
            kept.append([_PASS if f in before or f == name else _ALL for f in FILTERS])
            alone.append([_FAIL if f == name else _PASS for f in FILTERS])
    return np.array(removed), np.array(kept), np.array(alone)


def _contracted(tensor: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    return np.einsum("mabcde,xa,xb,xc,xd,xe->mx", tensor, *selectors.transpose(1, 0, 2))


def steps(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of the 600 (order, step) rows from counts of the shape (3, 32): documents, good ones, toxic ones."""
    tensor = np.asarray(counts, np.int64).reshape(3, *[2] * len(FILTERS))
    here, after, alone = _selectors()
    removed = _contracted(tensor, here)
    names = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    failing = np.array([tensor[0].take(1, axis=k).sum() for k in range(len(FILTERS))])
    shapley = np.array([removed[0][names == k].sum() for k in range(len(FILTERS))])
    return {"kept": _contracted(tensor[:1], after)[0], "removed": removed[0], "redundant": failing[names] - removed[0],
            "unique_fails": _contracted(tensor[:1], alone)[0], "good_lost": removed[1], "toxic_lost": removed[2], "shapley": shapley[names]}


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter_order and step with the measures above; every part has all 600 rows.

    The filters are E, a text that a smaller id also has, and the four of `failures`. Null texts count as empty; these
    fail A, and E from the second id on. A null part is the part ''. Of rows with one id, all or none pass E. A row
    without an id comes after all ids, so it fails E if a row with an id has its text; its labels are unknown. A
    repeated row counts again; a document labelled twice counts as good or toxic if any label says so. A very long
    text is one row in one task and never leaves it. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = pa.array([o for o in ORDERS for _ in o])
        step = pa.array([k + 1 for o in ORDERS for k in range(len(o))], pa.int32())
        for batch in batches:
            for part, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = steps(np.array(counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(step), pa.string()), orders, step, *[pa.array(found[m], pa.int64()) for m in MEASURES]],
                    ["part", "filter_order", "step", *MEASURES])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    return tensors(docs, labels, id_col, text_col, part_col).mapInArrow(run, schema)


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
f AS (SELECT doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
             100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x),
             regexp_matches(x, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY x)] AS fails FROM w),
c AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (l.good) AS good, count(*) FILTER (l.toxic) AS toxic
      FROM f LEFT JOIN (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
      GROUP BY part, fails),
five AS (SELECT unnest(range(1, 6)) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM five a, five b, five c, five d, five e
           WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
first AS (SELECT part, fails, n, good, toxic, o,
                 coalesce(list_min([s for s in range(1, 6) if fails[o[s]]]), 9) AS gone FROM c, orders),
r AS (SELECT part, o, k AS step, o[k] AS f,
             coalesce(sum(n) FILTER (gone > k), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (gone = k), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (gone < k AND fails[o[k]]), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (fails[o[k]] AND len(list_filter(fails, lambda y: y)) = 1), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (gone = k), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (gone = k), 0)::BIGINT AS toxic_lost
      FROM first, five GROUP BY part, o, k)
SELECT part, array_to_string([substr('ABCDE', y, 1) for y in o], '') AS filter_order, step::INTEGER AS step, kept, removed,
       redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM r
"""
