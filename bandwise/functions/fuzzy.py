"""Colour names to canonical colours: exact alias first, then the closest alias."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwise.functions.dictionaries import COLOR_ALIASES
from bandwise.functions.normalize import blank_to_null, stripped
from bandwise.schemas import COLORS, FUZZY_THRESHOLD


def alias_map() -> dict[str, str]:
    """Alias to canonical in dictionary order; a repeated alias keeps its first place and
    takes its last meaning."""
    out: dict[str, str] = {}
    for canonical, aliases in COLOR_ALIASES.items():
        for alias in aliases:
            out[alias.lower().strip()] = canonical
    return out


def exact_colors(spark) -> DataFrame:
    """alias -> canonical, the canonical names included: a fixed dictionary below 200 rows."""
    known = {c: c for c in COLORS} | alias_map()
    return spark.createDataFrame(sorted(known.items()), "color_key string, exact_color string")


class _Matcher:
    """Best of a fixed list of names by token-sort ratio, for many inputs at once per name.

    ratio = 200 * LCS / (total length) over whitespace-sorted tokens; the LCS runs bit-parallel
    with one 64-bit word per name, all names side by side.
    """

    def __init__(self, names: list[str]):
        self.names = names
        sorted_names = [" ".join(sorted(n.split())) for n in names]
        self.lengths = np.array([len(n) for n in sorted_names])
        self.full = np.array([(1 << len(n)) - 1 for n in sorted_names], dtype=np.uint64)
        self.none = np.zeros(len(names), dtype=np.uint64)
        self.masks: dict[str, np.ndarray] = {}
        for j, name in enumerate(sorted_names):
            for i, ch in enumerate(name):
                mask = self.masks.setdefault(ch, np.zeros(len(names), dtype=np.uint64))
                mask[j] |= np.uint64(1 << i)

    def best(self, text: str) -> tuple[str, float]:
        text = " ".join(sorted(text.split()))
        state = np.full(len(self.names), np.iinfo(np.uint64).max, dtype=np.uint64)
        for ch in text:
            hit = state & self.masks.get(ch, self.none)
            state = (state + hit) | (state - hit)
        common = np.bitwise_count(~state & self.full).astype(np.float64)
        scores = 200.0 * common / (self.lengths + len(text))
        at = int(np.argmax(scores))  # the first of equals
        return self.names[at], float(scores[at])


_MATCH = T.StructType([
    T.StructField("color", T.StringType()), T.StructField("confidence", T.DoubleType()),
])
_ALIASES = alias_map()
_BY_ALIAS = _Matcher(list(_ALIASES))
_BY_COLOR = _Matcher(list(COLORS))


def closest_color(text: str) -> tuple[str, float]:
    name, score = _BY_ALIAS.best(text)
    if score >= FUZZY_THRESHOLD:
        return _ALIASES[name], round(score / 100, 2)
    name, score = _BY_COLOR.best(text)
    if score >= FUZZY_THRESHOLD:
        return name, round(score / 100, 2)
    return "other", 0.0


@F.pandas_udf(_MATCH)
def _closest(keys: pd.Series) -> pd.DataFrame:
    """Each distinct name of an Arrow batch is matched once."""
    found = {k: closest_color(k) for k in keys.dropna().unique()}
    pairs = [found.get(k, (None, None)) for k in keys]
    return pd.DataFrame(pairs, columns=["color", "confidence"])


def with_color(df: DataFrame, raw: Column, color: str, confidence: str) -> DataFrame:
    """Add the canonical colour and its confidence. Nothing shuffles: the dictionary is a fixed
    broadcast, and only names it lacks go through the matcher."""
    key = F.lower(stripped(blank_to_null(raw)))
    keyed = df.withColumn("color_key", key)
    joined = keyed.join(F.broadcast(exact_colors(df.sparkSession)), "color_key", "left")
    unknown = F.when(F.col("exact_color").isNull(), F.col("color_key"))
    matched = joined.withColumn("_fuzzy", _closest(unknown))
    return (
        matched.withColumn(color, F.coalesce("exact_color", "_fuzzy.color"))
        .withColumn(
            confidence,
            F.when(F.col("color_key").isNull(), 0.0)
            .when(F.col("exact_color").isNotNull(), 1.0)
            .otherwise(F.col("_fuzzy.confidence")),
        )
        .drop("color_key", "exact_color", "_fuzzy")
    )
