"""CSV exchange and JSON reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANUAL_SCHEMA = (
    "source_url string, year int, generation string, body_style string, trim string, "
    "transmission string, exterior_color_raw string, mileage int, asking_price double, "
    "currency string, description_raw string, listing_date string, seller_type string, "
    "location string"
)


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV part per task, each with a header; quotes inside a value are doubled and its white space is kept."""
    df.write.mode("errorifexists").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str, schema, line_breaks: bool = False) -> DataFrame:
    """CSV parts with headers. Values may hold line breaks only if told so, since a part is then one task's work."""
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=line_breaks).csv(path)


def import_manual(spark: SparkSession, path: str) -> DataFrame:
    """Manually collected listings in parsed shape, ready for normalization; descriptions may run over several lines."""
    rows = read_csv(spark, path, MANUAL_SCHEMA, line_breaks=True)
    return rows.select(
        F.lit("manual").alias("source"), "source_url", "year", "trim",
        F.col("body_style").alias("body_style_raw"),
        F.col("transmission").alias("transmission_raw"), F.lit(None).cast("string").alias("drivetrain_raw"),
        "exterior_color_raw", "mileage", "asking_price", "currency", "description_raw",
        F.lit(None).cast("string").alias("title_raw"), "listing_date",
        F.col("seller_type").alias("seller_type_raw"), "location",
    )


def alias_table(spark: SparkSession, path: str) -> DataFrame:
    """Alias dictionary file {"aliases": {canonical: [alias, ...]}} as (alias, canonical, rank). A repeated alias keeps
    its first place and takes its last meaning."""
    doc = spark.read.schema("aliases map<string,array<string>>").option("multiLine", True).json(path)
    rows = doc.select(F.posexplode(F.map_entries("aliases")).alias("place", "entry")).select(
        "place", "entry.key", F.posexplode("entry.value").alias("nth", "name"))
    at = F.struct("place", "nth")
    named = rows.groupBy(F.lower(F.trim("name")).alias("alias")).agg(
        F.max_by("key", at).alias("canonical"), F.min(at).alias("at"))
    return named.select("alias", "canonical", (F.col("at.place") * 1_000_000 + F.col("at.nth")).alias("rank"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """The same as (alias, canonical)."""
    return alias_table(spark, path).select("alias", "canonical")


def year_table(spark: SparkSession, path: str) -> DataFrame:
    """Year table file {"year_to_generation": {year: code}, "shared_years": {year: {"earlier": code, "later": code,
    "words": [...]}}} as (year, generation, later, words); the last two are null where a year has one generation."""
    doc = spark.read.schema(
        "year_to_generation map<string,string>, shared_years map<string,struct<earlier:string,later:string,words:array<string>>>"
    ).option("multiLine", True).json(path)
    plain = doc.select(F.explode("year_to_generation").alias("year", "generation")).select(
        F.col("year").try_cast("int").alias("year"), "generation", F.lit(None).cast("string").alias("later"),
        F.lit(None).cast("array<string>").alias("words"))
    shared = doc.select(F.explode("shared_years").alias("year", "s")).select(
        F.col("year").try_cast("int").alias("year"), F.col("s.earlier").alias("generation"), "s.later", "s.words")
    return shared.unionByName(plain.join(shared.select("year"), "year", "left_anti"))


def read_year_table(spark: SparkSession, path: str) -> DataFrame:
    """The same as (year, generation)."""
    return year_table(spark, path).select("year", "generation")
