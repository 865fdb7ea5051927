"""Raw text columns to typed ones, as column expressions that yield null instead of failing."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise import schemas as S
from bandwise.functions import dictionaries as D

# i: ignore case; U: Unicode classes and boundaries; d: only \n ends a line
FLAGS = "(?iUd)"
BLANKS = " \t\n\r\x0b\x0c"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.when(stripped(c) != "", c)


def any_of(patterns: Iterable[str]) -> str:
    """One alternation instead of one scan per pattern."""
    return FLAGS + "(?:" + "|".join(patterns) + ")"


# Letters that ignore-case matching equates with s, i or k but lower() does not.
ODD_CASE = "[ſıİ\u212a]"


class IndexedText(NamedTuple):
    """A text column with its lower-cased form, the gate words found in it and whether it has an
    odd-case letter, each computed once per row."""

    text: Column
    lowered: Column
    words: Column
    odd: Column


def with_text_index(df: DataFrame, column: str) -> tuple[DataFrame, IndexedText]:
    gates = sorted({w for words in D.GATE_WORDS.values() for w in words})
    df = df.withColumn("_lowered", F.lower(column))
    df = df.withColumn(
        "_words",
        F.array_intersect(
            F.split("_lowered", "[^a-z0-9]+"), F.array(*[F.lit(w) for w in gates])
        ),
    )
    df = df.withColumn("_odd", F.col(column).rlike(ODD_CASE))
    return df, IndexedText(F.col(column), F.col("_lowered"), F.col("_words"), F.col("_odd"))


TEXT_INDEX_COLUMNS = ("_lowered", "_words", "_odd")


def _boundary_last(pattern: str) -> str:
    """The same pattern with its leading word boundary checked after the match, by looking back:
    the engine then skips ahead on the first letter instead of testing every position."""
    body = pattern.removeprefix(r"\b")
    return f"(?Ud){body}(?<=\\b{body})"


def mentions(indexed: IndexedText, patterns: Iterable[str]) -> Column:
    """Whether any pattern matches, ignoring case.

    One split of the text into words says which patterns can match at all; a regex only runs on
    the texts that hold one of its gate words. Texts with a letter that lower() does not fold
    take the full patterns.
    """
    patterns = tuple(patterns)
    found = F.lit(False)
    for pattern in patterns:
        gate = reduce(or_, [F.array_contains(indexed.words, w) for w in D.GATE_WORDS[pattern]])
        found = found | (gate & indexed.lowered.rlike(_boundary_last(pattern)))
    return found | (indexed.odd & indexed.text.rlike(any_of(patterns)))


def first_class(text: Column, patterns) -> Column:
    """Label of the first matching pattern, in order."""
    chain = F.lit(None).cast("string")
    for pattern, label in reversed(patterns):
        chain = F.when(text.rlike(FLAGS + pattern), label).otherwise(chain)
    return F.when(blank_to_null(text).isNotNull(), chain)


def generation(year: Column, text: Column) -> Column:
    """Model year to generation; in the two shared years the text decides, the earlier one
    by default."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for name, first, last in D.GENERATION_YEARS:
        out = F.when(year.between(first, last), name).otherwise(out)
    for shared, (earlier, later, words) in D.SHARED_YEARS.items():
        hinted = F.lit(False)
        for word in words:
            hinted = hinted | lowered.contains(word)
        out = F.when(year == shared, F.when(hinted, later).otherwise(earlier)).otherwise(out)
    return out


def body_style(text: Column) -> Column:
    return first_class(text, D.BODY_STYLE_PATTERNS)


def transmission(text: Column) -> Column:
    return first_class(text, D.TRANSMISSION_PATTERNS)


def drivetrain(raw: Column) -> Column:
    """awd or rwd; anything unknown counts as rwd."""
    return F.when(F.lower(stripped(raw)) == "awd", "awd").otherwise("rwd")


def text_flag(indexed: IndexedText, name: str) -> Column:
    """False on a negation, else true on a mention, else null: not mentioned is unknown."""
    rules = D.FLAG_PATTERNS[name]
    return F.when(mentions(indexed, rules["no"]), False).when(
        mentions(indexed, rules["yes"]), True
    )


def modification_flags(indexed: IndexedText) -> Column:
    """Names of the matching modification groups in dictionary order; null when none."""
    found = F.array_compact(
        F.array(*[
            F.when(mentions(indexed, patterns), name)
            for name, patterns in D.MODIFICATION_PATTERNS.items()
        ])
    )
    return F.when(F.size(found) > 0, found)


def seller_type(raw: Column) -> Column:
    lowered = F.lower(raw)
    return (
        F.when(lowered.contains("auction"), "auction_house")
        .when(lowered.contains("dealer"), "dealer")
        .when(lowered.contains("private"), "private")
    )


def lenient_date(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(
        *[
            F.try_to_date(value, fmt)
            for fmt in ("yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'",
                        "MMMM d, yyyy")
        ]
    )


def _has(c: Column, empty) -> Column:
    """1 when neither null nor the empty value."""
    return F.coalesce((c != empty).cast("int"), F.lit(0))


def confidence(year, generation_, body, trans, color_raw, mileage, color, color_conf) -> Column:
    """Share of six key fields found, blended with the colour confidence."""
    found = (
        _has(year, 0) + _has(generation_, "") + _has(body, "") + _has(trans, "")
        + _has(color_raw, "") + _has(mileage, 0)
    )
    share = found / F.lit(6.0) * 0.7
    sure = color.isNotNull() & (color != "other")
    blended = F.when(sure, share + color_conf * 0.3).otherwise(share)
    return F.round(blended.cast("decimal(18,6)"), 2).cast("double")


def deduction_confidence(row: dict[str, Column]) -> Column:
    """The documented alternative score: 1 minus a deduction per weakness."""
    weak = {
        "year": (row["year"].isNull(), 15),
        "generation": (row["generation"].isNull(), 15),
        "transmission": (row["transmission"].isNull(), 10),
        "body_style": (row["body_style"].isNull(), 5),
        "color_other": (row["color"] == "other", 5),
        "color_fuzzy": (row["color_confidence"] < 0.8, 5),
        "vin": (row["vin"].isNull(), 5),
        "duplicate": (row["possible_duplicate_id"].isNotNull(), 10),
        "matching_numbers": (row["matching_numbers"].isNull(), 5),
    }
    lost = F.lit(0)
    for hit, points in weak.values():
        lost = lost + F.when(F.coalesce(hit, F.lit(False)), points).otherwise(0)
    return (F.lit(100) - lost) / 100


def confidence_tier(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.65, "medium").when(
        score.isNotNull(), "low"
    )


def comp_confidence(price_type: Column) -> Column:
    """How far a price of this type stands for a sale."""
    return (
        F.when(price_type == "auction_final", 0.95)
        .when(price_type.isin("dealer_ask", "private_ask"), 0.4)
        .when(price_type == "estimate", 0.2)
    )


def only_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keep the columns the target table knows, in its order."""
    have = set(df.columns)
    return df.select(*[c for c in columns if c in have])


def as_comps(normalized: DataFrame) -> DataFrame:
    """Normalized records in comp shape: final price becomes the sale price, and the price type
    gives the confidence."""
    comps = normalized.withColumn("sale_price", F.col("final_price")).withColumn(
        "confidence_score", comp_confidence(F.col("price_type"))
    )
    return only_columns(comps, S.COMP_COLUMNS)
