"""Dictionaries that come as tables: colour aliases of any number, and generations by year."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.functions.normalize import blank_to_null, stripped
from bandwise.schemas import COLORS, FUZZY_THRESHOLD

#: Names of a dictionary, and names looked up, that one task holds at once.
BLOCK, SLICE = 5_000, 2_000


def sorted_tokens(name: str) -> str:
    return " ".join(sorted(name.split()))


class Names:
    """A block of names to compare others with by token-sort ratio, 200 * LCS / (sum of lengths).

    The names are ordered by length, and a text is only compared with those whose length allows the ratio: the common
    subsequence is no longer than the shorter of the two. It runs bit-parallel, a machine word per name, all names side
    by side; names of more than 64 letters take one long integer each.
    """

    def __init__(self, names: Sequence[str], ranks: Sequence[int], least: float):
        texts = sorted(zip(map(sorted_tokens, names), ranks, range(len(names)), strict=True), key=lambda t: len(t[0]))
        self.least = least
        self.ranks = np.array([r for _, r, _ in texts], np.int64)
        self.place = [k for *_, k in texts]
        self.lengths = np.array([len(t) for t, *_ in texts], np.int64)
        self.short = int(np.searchsorted(self.lengths, 64, side="right"))
        self.full = np.array([(1 << n) - 1 for n in self.lengths[:self.short].tolist()], np.uint64)
        self.masks: dict[str, np.ndarray] = {}
        for j, (text, *_) in enumerate(texts[:self.short]):
            for i, letter in enumerate(text):
                self.masks.setdefault(letter, np.zeros(self.short, np.uint64))[j] |= np.uint64(1 << i)
        self.long = [text for text, *_ in texts[self.short:]]
        self.none = np.zeros(self.short, np.uint64)

    def best(self, text: str) -> tuple[int, float] | None:
        """(position, score) of the best name of at least `least`; of equals the one with the least rank."""
        text = sorted_tokens(text)
        n, least = len(text), self.least
        lo = int(np.searchsorted(self.lengths, np.ceil(least * n / (200 - least) - 1e-9)))
        hi = int(np.searchsorted(self.lengths, np.floor((200 - least) * n / least + 1e-9), side="right"))
        if lo >= hi:
            return None
        end = min(hi, self.short)
        common = np.zeros(hi - lo, np.int64)
        if lo < end:
            state = np.full(end - lo, np.iinfo(np.uint64).max, np.uint64)
            for letter in text:
                hit = state & self.masks.get(letter, self.none)[lo:end]
                state = (state + hit) | (state - hit)
            common[:end - lo] = np.bitwise_count(~state & self.full[lo:end])
        for k in range(max(lo, self.short), hi):
            common[k - lo] = _common(self.long[k - self.short], text)
        scores = 200.0 * common / (self.lengths[lo:hi] + n)
        top = scores.max()
        if top < least:
            return None
        at = np.nonzero(scores == top)[0] + lo
        at = int(at[np.argmin(self.ranks[at])])
        return self.place[at], float(top)


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(a):
        masks[letter] = masks.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for letter in b:
        hit = state & masks.get(letter, 0)
        state = ((state + hit) | (state - hit)) & full
    return (~state & full).bit_count()


def closest_names(keys: DataFrame, names: DataFrame, least: float = FUZZY_THRESHOLD) -> DataFrame:
    """(key, tier, name, score) of the best name of each tier for every key, where it reaches `least`; of equals the
    one with the least rank. `keys` has a column key, `names` has name, tier and rank, one row each.

    Names are dealt to blocks and keys to slices, and every block meets every slice in one task of an equi-join, so
    neither side is ever held whole. At a ratio of 70 two names need not have much in common (of their pairs of
    neighbouring letters, often a single one), so an index over letters finds nearly all pairs and is not used.
    """
    blocks = max(1, -(-names.count() // BLOCK))
    slices = max(1, -(-keys.count() // SLICE))
    asked = keys.select("key", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int").alias("slice"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    known = names.select("name", "tier", "rank", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def met(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tier, part in block.groupby("tier"):
            part = part.reset_index(drop=True)
            index = Names(part["name"].tolist(), part["rank"].tolist(), least)
            for key in some["key"]:
                found = index.best(key)
                if found is not None:
                    out.append((key, tier, part["name"][found[0]], found[1], part["rank"][found[0]]))
        return pd.DataFrame(out, columns=["key", "tier", "name", "score", "rank"])

    pairs = asked.groupBy("slice", "block").cogroup(known.groupBy("slice", "block")).applyInPandas(
        met, "key string, tier int, name string, score double, rank long")
    best = pairs.groupBy("key", "tier").agg(F.max_by(F.struct("name", "score"), F.struct("score", -F.col("rank"))).alias("b"))
    return best.select("key", "tier", "b.name", "b.score")


def with_color_of(df: DataFrame, raw: Column, aliases: DataFrame, color: str, confidence: str) -> DataFrame:
    """Add the canonical colour and its confidence by a table of aliases (alias, canonical, rank): the exact alias, else
    a canonical name, else the closest alias, else the closest canonical name, else 'other'. Only the different names
    that the table lacks are compared, each once."""
    spark = df.sparkSession
    own = spark.createDataFrame([(c, c, 1, k) for k, c in enumerate(COLORS)], "name string, canonical string, tier int, rank long")
    names = aliases.select(F.col("alias").alias("name"), "canonical", F.lit(0).alias("tier"), F.col("rank").cast("long")).unionByName(own)
    exact = names.groupBy("name").agg(F.min_by("canonical", "tier").alias("canonical"))
    keyed = df.withColumn("_key", F.lower(stripped(blank_to_null(raw))))
    unknown = keyed.select(F.col("_key").alias("key")).where("key is not null").distinct().join(
        exact.select(F.col("name").alias("key")), "key", "left_anti")
    close = closest_names(unknown, names).join(names.select("name", "tier", "canonical"), ["name", "tier"]).groupBy("key").agg(
        F.min_by(F.struct("canonical", F.round(F.col("score") / 100, 2).alias("score")), "tier").alias("c"))
    settled = exact.select(F.col("name").alias("_key"), F.col("canonical").alias("_color"), F.lit(1.0).alias("_score")).union(
        close.select("key", "c.canonical", "c.score"))
    found = keyed.join(settled, "_key", "left")
    known = F.col("_key").isNotNull()
    return found.withColumn(color, F.when(known, F.coalesce("_color", F.lit("other")))).withColumn(
        confidence, F.coalesce("_score", F.lit(0.0))).drop("_key", "_color", "_score")


def with_generation_of(df: DataFrame, year: str, text: Column, years: DataFrame, generation: str) -> DataFrame:
    """Add the generation by a table of years (year, generation, later, words): in a year that two generations share, a
    text with one of the words means the later one."""
    table = years.select(F.col("year").alias("_year"), F.col("generation").alias("_earlier"), F.col("later").alias("_later"),
                         F.col("words").alias("_words"))
    joined = df.withColumn("_text", F.lower(F.coalesce(text, F.lit("")))).join(table, F.col(year) == F.col("_year"), "left")
    hinted = F.coalesce(F.exists("_words", lambda w: F.col("_text").contains(w)), F.lit(False))
    return joined.withColumn(generation, F.when(hinted, F.col("_later")).otherwise(F.col("_earlier"))).drop(
        "_text", "_year", "_earlier", "_later", "_words")
