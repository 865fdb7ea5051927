"""Typed fields from page text: column expressions shared by the sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bandwise.functions.normalize import FLAGS, stripped

# --- fixed values: patterns of the extracted fields ------------------------------------
YEAR_FROM_1960 = r"\b(19[6-9]\d|1998)\b"
YEAR_FROM_1965 = r"\b(196[5-9]|19[7-9]\d|1998)\b"
MODEL_WORDS = r"\bPorsche\s+91[0-9]\b"
MILES = r"([\d,]+)\s*(?:miles?|mi\.?)"
DOLLARS = r"\$\s*([\d,]+)"
DOLLARS_CENTS = r"\$\s*([\d,]+(?:\.\d{2})?)"
SOLD_FOR = r"[Ss]old\s+for\s+\$([\d,]+)"
LONG_DATE = r"([A-Z][a-z]+\s+\d{1,2},\s+\d{4})"
BIDS = r"(\d+)\s+bids?"
BIDS_CLOSE = r"(\d+)\s*bids?"
VIN = r"\b([A-HJ-NPR-Z0-9]{17})\b"
ENGINE = (
    r"\b(2\.0|2\.2|2\.4|2\.7|2\.7[- ]?[Tt]urbo|3\.0|3\.0[- ]?[Tt]urbo|"
    r"3\.2|3\.3[- ]?[Tt]urbo|3\.6|3\.8|3\.5)\b"
)
CLOSED = r"\bsold\s+for\b|\bauction\s+ended\b|\bno\s+sale\b"
GEARBOX_WORDS = ("tiptronic", "speed", "manual", "g50", "915")
BODY_WORDS = (
    ("speedster", "speedster"), ("cabriolet", "cabriolet"), ("cabrio", "cabriolet"),
    ("convertible", "cabriolet"), ("targa", "targa"), ("coupe", "coupe"), ("coupé", "coupe"),
)
GEARBOX_CLASSES = (
    (r"\btiptronic\b", "auto"),
    (r"\b6[-\s]?speed\b", "manual-6sp"),
    (r"\b(5[-\s]?speed|g50|915|manual)\b", "manual"),
)
FOUR_WHEEL = r"\b(carrera\s*4|c4|all[-\s]?wheel|awd)\b"
CASED = "(?Ud)"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of the pattern, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def whole_number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("int")


def amount(text: Column, pattern: str = DOLLARS) -> Column:
    return F.regexp_replace(found(text, CASED + pattern), ",", "").try_cast("double")


def first_amount(texts: Column, pattern: str = DOLLARS) -> Column:
    """First price in a list of texts."""
    priced = F.filter(texts, lambda t: t.rlike(CASED + pattern))
    return amount(F.get(priced, F.lit(0)), pattern)


def year(title: Column, pattern: str) -> Column:
    return found(title, CASED + pattern).try_cast("int")


def trim(title: Column) -> Column:
    """What is left of a title without year and model."""
    left = stripped(F.regexp_replace(title, CASED + YEAR_FROM_1960, ""))
    left = stripped(F.regexp_replace(left, FLAGS + MODEL_WORDS, ""))
    return F.nullif(F.btrim(left, F.lit(", ")), F.lit(""))


def miles(text: Column) -> Column:
    return whole_number(found(text, FLAGS + MILES))


def engine(text: Column) -> Column:
    return found(text, FLAGS + ENGINE)


def vin(text: Column) -> Column:
    return found(text, CASED + VIN)


def bids(text: Column, pattern: str = BIDS) -> Column:
    return found(text, FLAGS + pattern).try_cast("int")


def long_date(text: Column) -> Column:
    return F.try_to_date(F.regexp_replace(found(text, CASED + LONG_DATE), r"\s+", " "), "MMMM d, yyyy")


def page_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_date(text, f) for f in ("MMMM d, yyyy", "M/d/yyyy", "yyyy-M-d")])


def closed(text: Column) -> Column:
    return text.rlike(FLAGS + CLOSED)


def body_word(text: Column) -> Column:
    lowered = F.lower(text)
    out = F.lit(None).cast("string")
    for word, label in reversed(BODY_WORDS):
        out = F.when(lowered.contains(word), label).otherwise(out)
    return out


def gearbox_class(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, label in reversed(GEARBOX_CLASSES):
        out = F.when(text.rlike(FLAGS + pattern), label).otherwise(out)
    return out


def four_wheel(text: Column) -> Column:
    return F.when(text.rlike(FLAGS + FOUR_WHEEL), "awd")


def exterior(color: Column) -> Column:
    """The part before " over "; the test ignores case, the cut does not."""
    return F.when(
        F.lower(color).contains(" over "), stripped(F.split(color, " over ")[0])
    ).otherwise(color)


def strip_html(html: Column) -> Column:
    """Markup to blanks, blanks collapsed."""
    spaced = F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"(?U)\s+", " ")
    return F.trim(spaced)


def slot(fragments: str, name: str) -> Column:
    return F.coalesce(F.col(fragments)[name], F.array().cast("array<string>"))


def slot_first(fragments: str, name: str) -> Column:
    return F.get(F.col(fragments)[name], F.lit(0))


def spec_entries(fragments: str) -> Column:
    """Label/value entries of a page in order of precedence."""
    return F.zip_with(
        slot(fragments, "labels"), slot(fragments, "values"),
        lambda k, v: F.struct(k.alias("k"), v.alias("v")),
    )


def spec_last(entries: str, name: str) -> Column:
    """Value of a label, the last one when repeated."""
    hits = F.filter(entries, lambda e: (e["k"] == name) & (e["v"] != ""))
    return F.try_element_at(hits, F.lit(-1))["v"]


def spec_first(entries: str, *names: str) -> Column:
    """Value of the first entry that bears any of the labels."""
    return F.get(F.filter(entries, lambda e: e["k"].isin(*names)), F.lit(0))["v"]
