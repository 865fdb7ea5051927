"""Repeated-passage removal with suffix arrays kept in a logarithmic index family."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import written

#: A byte is removed when a string of this many bytes around it also starts earlier.
MATCH = 100
#: Strings of MATCH bytes meet by the least hash among their strings of GRAM bytes.
GRAM = 24
#: Windows that one shard's index family is planned for; an anchor with more than CROWDED is dealt by window content.
SHARD_WINDOWS, CROWDED = 150_000, 20_000
#: Differing neighbourhoods of one anchor in one batch after which they skip the meeting by anchor.
LOCAL_HOT = 64
_CHUNK = 1 << 20
_RNG = np.random.default_rng(6_100)
_BYTE = _RNG.integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * 2 + 1
_STEP = _RNG.integers(1, 1 << 62, 8, dtype=np.int64).astype(np.uint64) * 2 + 1
_BASE = int(_STEP[7])
_BACK = pow(_BASE, -1, 1 << 64)
#: What the first shuffle carries: a neighbourhood to be met, one already known to repeat, one already known to be
#: doubtful, and a sign that an anchor is doubtful.
MEET, REPEATED, DOUBTFUL, SIGN = 0, 1, 2, 3


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def neighbourhoods(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, windows, key, content hash, looped) of every maximal run of 100-byte windows with the same anchor;
    looped: the anchor stands in the run more than once, so the run may repeat in itself.

    A window's anchor is the least hash of its 24-byte strings, so equal windows have equal anchors wherever they
    stand; one run in about 39 bytes. The run covers windows start .. start + windows - 1.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, bool))
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(raw) < MATCH:
        return none
    ends = np.cumsum(lengths)
    begins = ends - lengths
    h1 = _BYTE[raw]
    h2 = h1[:-1] * _STEP[0] + h1[1:]
    h4 = h2[:-2] * _STEP[1] + h2[2:]
    h8 = h4[:-4] * _STEP[2] + h4[4:]
    h16 = h8[:-8] * _STEP[3] + h8[8:]
    h = h16[:len(raw) - GRAM + 1] * _STEP[4] + h8[16:]
    h ^= h >> np.uint64(31)
    h *= _STEP[5]
    h ^= h >> np.uint64(29)
    del h2, h4, h8, h16
    wide, low = MATCH - GRAM + 1, h
    step = 1
    while step * 2 <= wide:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = wide - step
    low = np.minimum(low[:len(low) - rest], low[rest:])  # one for each window start
    here = np.ones(len(low), dtype=bool)
    here[1:] = low[1:] != low[:-1]
    whole = lengths >= MATCH
    here[begins[whole]] = True
    outside = np.zeros(len(low) + 1, dtype=np.int64)  # windows that would run into the next text
    from_, to = np.minimum(np.where(whole, ends - MATCH + 1, begins), len(low)), np.minimum(ends, len(low))
    np.add.at(outside, from_, 1)
    np.add.at(outside, to, -1)
    here &= np.cumsum(outside)[:-1] == 0
    at = np.nonzero(here)[0]
    if not len(at):
        return none
    text = np.searchsorted(ends, at, side="right")
    stop = np.minimum(np.append(at[1:], len(raw)), ends[text] - MATCH + 1)
    many = stop - at
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(h1 * _powers(_BASE, len(raw)), out=sums[1:], dtype=np.uint64)
    content = (sums[stop + MATCH - 1] - sums[at]) * _powers(_BACK, len(raw))[at]
    content = (content ^ (content >> np.uint64(32))) * _STEP[6]
    # where the anchors stand: places whose hash is the least of some window
    top = np.concatenate([np.zeros(wide - 1, np.uint64), low, np.zeros(wide - 1, np.uint64)])
    step = 1
    while step * 2 <= wide:
        top = np.maximum(top[:-step], top[step:])
        step *= 2
    rest = wide - step
    top = np.maximum(top[:len(top) - rest], top[rest:])
    spots = np.nonzero(h == top)[0]
    spots = spots[np.lexsort((spots, h[spots]))]
    p, q = spots[:-1], spots[1:]
    twice = (h[p] == h[q]) & (q - p < wide)
    p, q = p[twice], q[twice]
    looped = many > wide
    r = np.maximum(np.searchsorted(at, q - wide + 1, side="right") - 1, 0)
    stay = np.arange(len(p))
    while len(stay):
        hit = (low[at[r[stay]]] == h[p[stay]]) & (at[r[stay]] <= p[stay]) & (stop[r[stay]] + wide - 1 > q[stay])
        looped[r[stay[hit]]] = True
        r[stay] += 1
        stay = stay[r[stay] < len(at)]
        stay = stay[at[r[stay]] <= p[stay]]
    return text, at - begins[text], many, low[at].view(np.int64), content.view(np.int64), looped


_COLUMNS = ["route", "key", "content", "id", "start", "windows", "kind"]
_SCHEMA = "route long, key long, content long, id long, start long, windows long, kind int"


def _chunks(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    part_ids, part, held = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        part_ids.append(i.as_py())
        part.append(t.as_py() or b"")
        held += len(part[-1])
        if held >= _CHUNK:
            yield np.array(part_ids, dtype=np.int64), part
            part_ids, part, held = [], [], 0
    if part:
        yield np.array(part_ids, dtype=np.int64), part


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for ids, texts in _chunks(batch.column(0), batch.column(1)):
            text, start, many, key, content, looped = neighbourhoods(texts)
            parts.append((key, content, ids[text], start, many, looped))
        key, content, doc, start, many, looped = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6
        if not len(key):
            continue
        order = np.lexsort((start, doc, content, key))
        key, content, doc, start, many, looped = (c[order] for c in (key, content, doc, start, many, looped))
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, content[1:] != content[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        kind = np.where((doc != doc[first]) | (start != start[first]), REPEATED, MEET).astype(np.int32)
        # an anchor with very many different neighbourhoods here would be one task's work if they all met by it
        group = np.cumsum(new_key) - 1
        classes = np.bincount(group, weights=new)
        crowded = (classes > LOCAL_HOT)[group]
        kind[(crowded | looped) & (kind == MEET)] = DOUBTFUL
        nth = np.cumsum(new) - np.maximum.accumulate(np.where(new_key, np.cumsum(new) - 1, 0))
        sign = new & (kind == DOUBTFUL) & (looped | (nth <= 2))
        with np.errstate(over="ignore"):
            route = np.where(kind == MEET, key, (doc * 1_000_003 + start) * int(_STEP[5].view(np.int64)))
        cols = [np.concatenate([c, c[sign]]) for c in (route, key, content, doc, start, many)]
        cols[0][len(key):] = key[sign]
        cols.append(np.concatenate([kind, np.full(sign.sum(), SIGN, np.int32)]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _COLUMNS)


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order (key, content, id, start): keeps the repeated and the doubtful ones.

    A neighbourhood repeats if an equal one (same key and content) starts earlier. The earliest of equal ones is
    doubtful if its anchor has another content: single windows may still be equal. The last class of a batch is
    carried on, so a class or an anchor may be of any size.
    """
    carried: tuple | None = None  # (key, content, id, start, windows) of the last class's first row
    told, several = True, False  # whether that row went out, and whether its anchor has several contents
    for batch in batches:
        key, content, doc, start, many, kind = (batch.column(c).to_numpy() for c in range(1, 7))
        known = (kind == REPEATED) | (kind == DOUBTFUL)
        out = [(key[known], doc[known], start[known], many[known], kind[known])]
        key, content, doc, start, many, kind = (c[~known] for c in (key, content, doc, start, many, kind))
        if carried is not None:
            key, content, doc, start, many = (np.append(np.int64(a), c) for a, c in
                                              zip(carried, (key, content, doc, start, many), strict=True))
            kind = np.append(np.int32(SIGN if told else MEET), kind)
        if len(key):
            new_key = np.append(True, key[1:] != key[:-1])
            new = new_key | np.append(True, content[1:] != content[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            group = np.cumsum(new_key) - 1
            classes = np.bincount(group, weights=new)
            if carried is not None and several:
                classes[0] += 1
            plural = (classes > 1)[group]
            repeated = ((doc != doc[first]) | (start != start[first])) & (kind == MEET)
            # a sign stands for rows that went another way: it may be earlier or not, which the windows will tell
            signed = repeated & (kind[first] == SIGN) & ~((carried is not None) & (first == 0))
            doubtful = ((~repeated & plural) | signed) & (kind == MEET)
            repeated &= ~signed
            for rows, what in ((repeated, REPEATED), (doubtful, DOUBTFUL)):
                out.append((key[rows], doc[rows], start[rows], many[rows], np.full(rows.sum(), what, np.int32)))
            last = first[-1]
            told = bool(kind[last] == SIGN or doubtful[last])
            several = bool(plural[-1])
            carried = tuple(int(c[last]) for c in (key, content, doc, start, many))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                         ["key", "id", "start", "windows", "kind"])


class IndexFamily:
    """Sorted arrays of window contents (suffixes cut at MATCH bytes), their sizes falling by half from level to level."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, windows: np.ndarray) -> np.ndarray:
        """Whether each window of a new batch, given in document order, occurs earlier in the batch or in a level.

        The batch gets its suffix array; merge scans against the levels find the matches; what is new becomes a level,
        and levels of equal size merge.
        """
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        again = np.zeros(len(ranked), dtype=bool)
        again[1:] = ranked[1:] == ranked[:-1]
        fresh = ~again
        for level in self.levels:
            at = np.searchsorted(level, ranked[fresh])
            seen = level[np.minimum(at, len(level) - 1)] == ranked[fresh]
            again[np.nonzero(fresh)[0][seen]] = True
            fresh = ~again
        grown = ranked[fresh]
        while self.levels and len(self.levels[-1]) <= 2 * len(grown):
            level = self.levels.pop()
            merged = np.empty(len(level) + len(grown), dtype=level.dtype)
            into = np.searchsorted(level, grown) + np.arange(len(grown))
            rest = np.ones(len(merged), dtype=bool)
            rest[into] = False
            merged[into], merged[rest] = grown, level
            grown = merged
        if len(grown):
            self.levels.append(grown)
        found = np.empty(len(windows), dtype=bool)
        found[order] = again
        return found


_STRETCHES = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, pieces, starts, known) of one shard in document order: per row, the stretches that start earlier too."""
    family = IndexFamily()
    last = None
    for batch in batches:
        for low in range(0, len(batch), 1024):
            part = batch.slice(low, 1024)
            ids, heads = part.column(0).to_numpy(), [k.as_py() for k in part.column(4)]
            fresh = []  # a row that repeats belongs to a repeated document
            for r in zip(ids.tolist(), heads, strict=True):
                fresh.append(r != last)
                last = r
            part = part.filter(pa.array(fresh))
            ids = part.column(0).to_numpy()
            out: list[list] = [[{"first": k, "end": k + MATCH} for k in known] for known in part.column(3).to_pylist()]
            strings = part.column(1).flatten().to_pylist()
            if strings:
                start = part.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(len(part)), pa.compute.list_value_length(part.column(1)).to_numpy())
                many = np.array([len(s) - MATCH + 1 for s in strings])
                raw = np.frombuffer(b"".join(strings), dtype=np.uint8) + np.uint8(1)  # no byte of UTF-8 is 255
                own = np.repeat(np.arange(len(strings)), many)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
                at = nth + np.repeat(np.cumsum(many + MATCH - 1) - (many + MATCH - 1), many)
                place = start[own] + nth
                order = np.lexsort((place, ids[row[own]]))
                own, at, place = own[order], at[order], place[order]
                views = np.lib.stride_tricks.sliding_window_view(raw, MATCH)
                again = np.concatenate([
                    family.add(np.ascontiguousarray(views[at[k:k + SHARD_WINDOWS]]).view(f"S{MATCH}").ravel())
                    for k in range(0, len(own), SHARD_WINDOWS)])
                edge = np.append(True, (own[1:] != own[:-1]))
                opens = again & (edge | ~np.append(False, again[:-1]))
                closes = again & (np.append(edge[1:], True) | ~np.append(again[1:], False))
                for r, first, end in zip(row[own[opens]].tolist(), place[opens].tolist(), place[closes].tolist(), strict=True):
                    out[r].append({"first": first, "end": end + MATCH})
            some = [k for k, x in enumerate(out) if x]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([out[k] for k in some], _STRETCHES)],
                                             ["id", "stretches"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, [(key, start, windows, parts)]): the bytes of the doubtful neighbourhoods. Those of a crowded
    anchor are dealt to `parts` shards by window content, and a window that an earlier one of the batch equals is
    known to repeat without travelling."""
    kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        seen: dict[bytes, tuple] = {}

        def put(*row: object, out: tuple[list, ...] = out) -> None:
            for column, value in zip(out, row, strict=True):
                column.append(value)

        ids = batch.column(0).to_pylist()
        for k in sorted(range(len(ids)), key=ids.__getitem__):
            body = batch.column(1)[k].as_py()
            for s in sorted(batch.column(2)[k].as_py(), key=lambda s: s["start"]):
                start, parts = s["start"], s["parts"]
                piece = body[start:start + s["windows"] + MATCH - 1]
                if len(piece) < MATCH:  # only where an id has several texts
                    continue
                if parts == 1:
                    put(ids[k], [piece], [start], [], start, s["key"])
                    continue
                dealt: dict[int, tuple[list, list, list]] = {}
                for at in range(len(piece) - MATCH + 1):
                    window = piece[at:at + MATCH]
                    digest = hashlib.blake2b(window, digest_size=16).digest()
                    to = dealt.setdefault(int.from_bytes(digest[:6]) % parts, ([], [], []))
                    if seen.setdefault(digest, (ids[k], start + at)) != (ids[k], start + at):
                        to[2].append(start + at)
                    else:
                        to[0].append(window)
                        to[1].append(start + at)
                for part, (windows, starts, known) in dealt.items():
                    put(ids[k], windows, starts, known, min(starts + known), s["key"] ^ (part * 0x9E3779B97F4A7C1 & (1 << 62) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)],
                                         ["id", "pieces", "starts", "known", "head", "shard"])


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(id, stretches [(first, end)]) of bytes to be removed from (id, text binary), none null; several rows for an
    id, and stretches may overlap."""
    mapped = docs.mapInArrow(_mapped, _SCHEMA)
    dealt = mapped.repartition("route").sortWithinPartitions("key", "content", "id", "start")
    found = written(dealt.mapInArrow(_classified, "key long, id long, start long, windows long, kind int"))
    doubtful = written(found.where(F.col("kind") == DOUBTFUL).select("key", "id", "start", "windows").distinct())
    total = doubtful.agg(F.sum("windows")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WINDOWS))
    crowded = doubtful.groupBy("key").agg(F.sum("windows").alias("all")).where(F.col("all") > CROWDED)
    spots = doubtful.join(crowded.select("key", (F.ceil(F.col("all") / CROWDED) + 1).alias("parts")), "key", "left").groupBy(
        "id").agg(F.collect_list(F.struct("key", "start", "windows", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("spots"))
    strings = docs.join(spots, "id").select("id", "text", "spots").mapInArrow(
        _cut_out, "id long, pieces array<binary>, starts array<long>, known array<long>, head long, shard long")
    indexed = (strings.repartition(shards, "shard").sortWithinPartitions("id", "head")
               .select("id", "pieces", "starts", "known", "head")
               .mapInArrow(_indexed, "id long, stretches array<struct<first: long, end: long>>"))
    end = (F.col("start") + F.col("windows") + MATCH - 1).alias("end")
    sure = found.where(F.col("kind") == REPEATED).select("id", F.array(F.struct(F.col("start").alias("first"), end)).alias("stretches"))
    return sure.union(indexed)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay; as_text: without
    the characters that a cut broke, as a string) and row (a struct of the columns to carry along, and of the id).

    A byte goes if a 100-byte string over it also starts at a smaller id or earlier in the same text. Runs of
    neighbouring 100-byte windows meet by their anchor hash. Equal runs settle each other by 128 bits of hash; where an
    anchor has different runs, their bytes go to the anchor's shard, which holds a logarithmic family of suffix
    arrays: every batch, in document order, gets its suffix array, is merge-scanned against the levels and joins them.
    Crowded anchors are dealt by window instead, so no shard grows with a popular passage, and each task sends one of
    equal runs only.

    Null and empty texts, and texts under 100 bytes, lose nothing. Repeated rows (same id, same text) do not count as
    earlier than each other; rows that share an id but not a text lose the union of what either loses. Rows without
    an id lose nothing and remove nothing. A very long text is a chunk of its own in its task; an empty table gives
    no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
                       F.struct(id_col, *[c for c in carry if c != id_col]).alias("row"))
    stretches = repeated_stretches(rows.where("id is not null").select("id", "text")).groupBy("id").agg(
        F.array_sort(F.flatten(F.collect_list("stretches"))).alias("stretches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, cuts in zip(batch.column(1), batch.column(2), strict=True):
                body = text.as_py()
                kept, at, removed, spans = [], 0, 0, 0
                reach = -1
                for c in cuts.as_py() or ():
                    first, end = min(c["first"], len(body)), min(c["end"], len(body))
                    if first >= end:
                        continue
                    if first > reach:
                        kept.append(body[at:first])
                        spans += 1
                        reach = at = first
                    if end > reach:
                        removed += end - reach
                        reach = at = end
                kept.append(body[at:])
                rest = b"".join(kept)
                left = rest.decode("utf-8", "ignore") if as_text else rest
                for column, value in zip(out, (len(body), removed, spans, hashlib.sha256(rest).hexdigest(), left), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)], batch.column(3)],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "row"])

    found = f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if as_text else 'binary'}"
    return rows.join(stretches, "id", "left").select("id", "text", "stretches", "row").mapInArrow(
        run, f"{found}, row {rows.schema['row'].dataType.simpleString()}").withColumnRenamed("id", id_col)
