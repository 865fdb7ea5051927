import pytest
from pyspark.sql import functions as F

from bandwise.functions import dictionaries as D
from bandwise.functions import normalize as N
from bandwise.functions.fuzzy import closest_color, with_color


def test_generation(spark):
    cases = [
        (1969, "", "G1"), (1976, "", "G2"), (1981, "", "G3"), (1987, "", "G4"), (1991, "", "G5"),
        (1997, "", "G6"), (1964, "", None), (1999, "", None), (1989, "a 964 Carrera", "G5"),
        (1989, "Carrera 3.2 Speedster", "G4"), (1994, "early 993", "G6"), (1994, "plain", "G5"),
        (1989, None, "G4"),
    ]
    df = spark.createDataFrame(cases, "year int, text string, want string")
    bad = df.where(~N.generation(F.col("year"), F.col("text")).eqNullSafe(F.col("want"))).collect()
    assert bad == []


def test_classes(spark):
    cases = [
        ("body", "Coupé", "coupe"), ("body", "COUPÉ", "coupe"), ("body", "Targa Speedster", "speedster"),
        ("body", "  ", None), ("body", "coupes", None), ("gear", "Tiptronic 5-speed", "auto"),
        ("gear", "6 Speed manual", "manual-6sp"), ("gear", "automatic", None), ("gear", "G50", "manual"),
    ]
    df = spark.createDataFrame(cases, "kind string, text string, want string")
    got = F.when(F.col("kind") == "body", N.body_style(F.col("text"))).otherwise(
        N.transmission(F.col("text")))
    assert df.where(~got.eqNullSafe(F.col("want"))).collect() == []


@pytest.mark.parametrize("raw, color, confidence", [
    ("Guards Red", "red", 1.0), ("grand prix white", "white", 1.0), ("black", "black", 1.0),
    (None, None, 0.0), ("   ", None, 0.0), ("Biscay Blue", "blue", 1.0), ("linen", "beige", 1.0),
    ("xqzwv", "other", 0.0), ("grey", "grey", 1.0), ("red guards", "red", 1.0),
])
def test_color(spark, raw, color, confidence):
    df = spark.createDataFrame([(raw,)], "c string")
    row = with_color(df, F.col("c"), "color", "conf").first()
    assert (row["color"], row["conf"]) == (color, confidence)


def test_closest_color_ratio():
    # "gards red" against "guards red": 9 of 9+10 letters in common order
    assert closest_color("gards red") == ("red", round(2 * 9 / 19, 2))


PHRASES = [
    ("matching_numbers", "A matching-numbers car", True), ("matching_numbers", "engine swap done", False),
    ("matching_numbers", "nothing here", None), ("matching_numbers", "ORIGINAL ENGINE", True),
    ("original_paint", "unrestored survivor", True), ("original_paint", "repainted once", False),
    ("original_paint", "", None), ("service_history", "service records present", True),
    ("service_history", "no service records", False), ("service_history", "ſervice records", True),
    ("original_paint", "xunrestored", None), ("original_paint", "éunrestored", None),
]


def test_text_flags(spark):
    df = spark.createDataFrame(PHRASES, "flag string, text string, want boolean")
    indexed, text = N.with_text_index(df, "text")
    got = F.lit(None).cast("boolean")
    for name in D.FLAG_PATTERNS:
        got = F.when(F.col("flag") == name, N.text_flag(text, name)).otherwise(got)
    assert indexed.where(~got.eqNullSafe(F.col("want"))).select("flag", "text").collect() == []


def test_gate_words_lose_nothing(spark):
    """The gated test agrees with the plain patterns on every wording of the fixture."""
    from bandwise.adapters import PHRASES as wordings

    df = spark.createDataFrame([(p,) for p in wordings] + [(p,) for _, p, _ in PHRASES], "text string")
    indexed, text = N.with_text_index(df, "text")
    groups = list(D.MODIFICATION_PATTERNS.values()) + [
        side for rules in D.FLAG_PATTERNS.values() for side in rules.values()]
    for patterns in groups:
        for pattern in patterns:
            plain = F.col("text").rlike(N.FLAGS + pattern)
            assert indexed.where(plain != N.mentions(text, [pattern])).count() == 0, pattern


def test_modification_flags(spark):
    df = spark.createDataFrame(
        [("widebody kit, roll cage and aftermarket 18 inch wheels",), ("stock",)], "text string")
    indexed, text = N.with_text_index(df, "text")
    got = [r[0] for r in indexed.select(N.modification_flags(text)).collect()]
    assert got == [["widebody", "aftermarket_wheels", "roll_cage", "stripped_interior"], None]


def test_dates(spark):
    cases = [("2025-03-14", "2025-03-14"), ("February 20, 2025", "2025-02-20"),
             ("2025-03-14T10:20:30Z", "2025-03-14"), ("soon", None), (None, None)]
    df = spark.createDataFrame(cases, "raw string, want string")
    got = N.lenient_date(F.col("raw")).cast("string")
    assert df.where(~got.eqNullSafe(F.col("want"))).collect() == []
