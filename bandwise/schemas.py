"""Record schemas, value domains and the fixed dictionaries."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: value domains of the enumerated columns ---------------------------
SOURCES = ("bat", "carsandbids", "pcarmarket", "ebay", "dealer_manual", "manual")
LISTING_STATUSES = ("active", "ended", "sold", "removed", "relist")
GENERATIONS = ("G1", "G2", "G3", "G4", "G5", "G6")
BODY_STYLES = ("coupe", "targa", "cabriolet", "speedster")
TRANSMISSIONS = ("manual", "manual-6sp", "auto")
DRIVETRAINS = ("rwd", "awd")
TITLE_STATUSES = ("clean", "salvage", "unknown")
CURRENCIES = ("USD", "GBP", "EUR")
PRICE_TYPES = ("auction_final", "dealer_ask", "private_ask", "estimate")
ALERT_TYPES = ("underpriced", "price_drop", "new_listing", "relist", "insufficient_data_warning")
SEVERITIES = ("info", "watch", "act")
ALERT_STATUSES = ("open", "read", "dismissed")
SELLER_TYPES = ("dealer", "private", "auction_house")
COLORS = (
    "white", "silver", "grey", "grey-metallic", "black",
    "red", "blue", "blue-metallic", "green", "green-metallic",
    "yellow", "orange", "brown", "beige", "gold-metallic",
    "purple", "turquoise", "burgundy", "bronze-metallic", "other",
)

YEAR_MIN, YEAR_MAX = 1965, 1998

# --- fixed values: thresholds ---------------------------------------------------------
WINDOW_DAYS = 90
THIN_WINDOW_DAYS = 180
MIN_CLUSTER_SIZE = 5
UNDERPRICED_PCT = -15.0
ACT_PCT = -25.0
PRICE_DROP_PCT = 5.0
NEW_LISTING_HOURS = 24
FUZZY_THRESHOLD = 70

CLUSTER_KEYS = ("generation", "body_style", "transmission")
NATURAL_KEY = ("source", "source_url")

# --- fixed values: reference models, one row per generation ---------------------------
# (generation, first year, last year, name, trims, engines, weight in tenths)
CANONICAL_MODELS = (
    ("G1", 1965, 1973, "Classic 911 / Long-hood",
     ["911", "911T", "911E", "911S", "912", "2.7RS", "Carrera RS"],
     ["2.0", "2.2", "2.4", "2.7"], 10),
    ("G2", 1974, 1977, "Impact bumper Carrera",
     ["Carrera", "911S", "Turbo", "930"],
     ["2.7", "3.0", "3.0T"], 10),
    ("G3", 1978, 1983, "911 SC",
     ["SC", "SC Targa", "SC Cabriolet", "Turbo", "930"],
     ["3.0", "3.3T"], 10),
    ("G4", 1984, 1989, "Carrera 3.2",
     ["Carrera", "Carrera Targa", "Carrera Cabriolet", "Speedster", "Turbo", "930"],
     ["3.2", "3.3T"], 10),
    ("G5", 1989, 1994, "964",
     ["Carrera 2", "Carrera 4", "Targa", "Cabriolet", "Turbo 3.3", "Turbo 3.6",
      "RS America", "Carrera RS", "Speedster"],
     ["3.6", "3.3T", "3.6T"], 10),
    ("G6", 1994, 1998, "993 — Last air-cooled",
     ["Carrera", "Carrera 4", "Targa", "Cabriolet", "Turbo", "Turbo S",
      "Carrera RS", "Carrera 4S", "GT2"],
     ["3.6", "3.6T", "3.8T"], 12),
)

CANONICAL_MODEL_SCHEMA = T.StructType([
    T.StructField("generation", T.StringType(), False),
    T.StructField("years_start", T.IntegerType(), False),
    T.StructField("years_end", T.IntegerType(), False),
    T.StructField("common_name", T.StringType()),
    T.StructField("known_trims", T.ArrayType(T.StringType())),
    T.StructField("known_engine_variants", T.ArrayType(T.StringType())),
    T.StructField("weight_tenths", T.IntegerType()),
])

RAW_PAGE_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
])

HISTORY_TYPE = "array<struct<price:double,ts:string>>"

# --- fixed values: columns of the stored listings and comps ----------------------------
LISTING_COLUMNS = (
    "id", "source", "source_url", "scrape_ts", "listing_status", "year", "generation",
    "body_style", "trim", "drivetrain", "engine_variant", "transmission",
    "exterior_color_raw", "exterior_color_canonical", "interior_color_raw", "mileage", "vin",
    "title_status", "asking_price", "currency", "price_history", "final_price",
    "matching_numbers", "original_paint", "service_history", "modification_flags",
    "normalization_confidence", "description_raw", "listing_date", "seller_type",
    "seller_name", "location", "bidder_count", "snapshot_path", "possible_duplicate_id",
    "title_raw", "created_at", "updated_at",
)

COMP_COLUMNS = (
    "id", "source", "source_url", "year", "generation", "body_style", "trim", "transmission",
    "engine_variant", "exterior_color_canonical", "exterior_color_raw", "mileage",
    "sale_price", "sale_date", "price_type", "currency", "bidder_count", "matching_numbers",
    "original_paint", "service_history", "modification_flags", "confidence_score", "notes",
    "created_at",
)
