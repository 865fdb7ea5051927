"""Normalization over ads derived from the documents, and over part names."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from bandwise import adapters as A
from bandwise.functions import dictionaries as D
from bandwise.functions import normalize as N
from bandwise.functions.fuzzy import alias_map, with_color
from bandwise.operators.dictionaries import with_color_of, with_generation_of
from bandwise.operators.normalizing import normalize_records
from bandwise.plans.registry import query
from bandwise.schemas import COLORS
from bandwise.session import run_folder
from bandwise.sources import files


def lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def choose(values, index: str) -> str:
    return f"[{', '.join(lit(v) for v in values)}][CAST(({index}) % {len(values)} AS INTEGER) + 1]"


ADS = f"""
ads0 AS (SELECT doc_id, {choose(A.SITES, 'doc_id')} AS source,
  'https://market.example/ad/' || doc_id AS source_url,
  CASE WHEN doc_id % 13 <> 0 THEN CAST(doc_id * 7 % 45 + 1958 AS INTEGER) END AS year,
  {choose(A.TRIMS, 'doc_id')} AS trim_text, text || ' ' || {choose(A.PHRASES, 'doc_id')} AS description_raw,
  {choose(A.BODIES, 'doc_id')} AS body_style_raw, {choose(A.GEARBOXES, 'doc_id // 3')} AS transmission_raw,
  {choose(A.DRIVES, 'doc_id')} AS drivetrain_raw, {choose(A.PAINTS, 'doc_id')} AS exterior_color_raw,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id * 31 % 200000 AS INTEGER) END AS mileage,
  CASE WHEN doc_id % 4 <> 0 THEN 'WP0ZZZ' || lpad(CAST(doc_id AS VARCHAR), 11, '0') END AS vin,
  {choose(A.SELLERS, 'doc_id')} AS seller_type_raw, {choose(A.DATES, 'doc_id')} AS listing_date,
  doc_id * 997 % 90000 + 10000 AS final_price,
  {choose(('auction_final', 'dealer_ask', 'private_ask', 'estimate'), 'doc_id // 2')} AS price_type
  FROM documents),
ads AS (SELECT *, coalesce(CAST(year AS VARCHAR), '') || ' Porsche 911 ' || trim_text AS title_raw,
  coalesce(CAST(year AS VARCHAR), '') || ' Porsche 911 ' || trim_text || ' ' || description_raw AS combined
  FROM ads0)
"""


def sql_classes(text: str, patterns) -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, {lit('(?i)' + p)}) THEN '{label}'"
                     for p, label in patterns)
    return f"CASE WHEN trim(coalesce({text}, '')) = '' THEN NULL {whens} END"


def sql_any(text: str, patterns) -> str:
    return f"regexp_matches({text}, {lit('(?i)(?:' + '|'.join(patterns) + ')')})"


def sql_flag(text: str, name: str) -> str:
    rules = D.FLAG_PATTERNS[name]
    return (f"CASE WHEN {sql_any(text, rules['no'])} THEN FALSE "
            f"WHEN {sql_any(text, rules['yes'])} THEN TRUE END")


def sql_mods(text: str) -> str:
    items = ", ".join(f"CASE WHEN {sql_any(text, p)} THEN '{n}' END"
                      for n, p in D.MODIFICATION_PATTERNS.items())
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"


def sql_generation(year: str, text: str, years=D.GENERATION_YEARS) -> str:
    whens = [f"WHEN {year} BETWEEN {a} AND {b} THEN '{g}'" for g, a, b in years]
    for y, (early, late, words) in D.SHARED_YEARS.items():
        hint = " OR ".join(f"contains(lower({text}), '{w}')" for w in words)
        whens.append(f"WHEN {year} = {y} THEN CASE WHEN {hint} THEN '{late}' ELSE '{early}' END")
    return f"CASE {' '.join(whens)} END"


def sql_color(raw: str, names_from: str, known=None) -> str:
    """CTEs color(raw, key, exterior_color_canonical, color_confidence) over distinct raw values,
    the common subsequence by dynamic programming over lists."""
    aliases = ", ".join(f"({i}, {lit(a)}, '{c}')" for i, (a, c) in enumerate((known or alias_map()).items()))
    colors = ", ".join(f"({i}, '{c}', '{c}')" for i, c in enumerate(COLORS))

    def scored(table):
        return f"""SELECT k.key, t.ord, t.canonical, 200.0::DOUBLE *
          list_reduce(string_split(k.sorted, ''), lambda acc, c: list_reduce(
              range(1, length(t.sorted) + 1),
              lambda r, j: list_append(r, CASE WHEN substr(t.sorted, CAST(j AS INTEGER), 1) = c
                THEN acc[j] + 1 ELSE greatest(acc[j + 1], r[j]) END), [0]),
            list_transform(range(length(t.sorted) + 1), lambda z: 0))[-1]
          / (length(k.sorted) + length(t.sorted)) AS score
          FROM keys k, {table} t"""

    def tokens(col):
        return (f"array_to_string(list_sort(list_filter(regexp_split_to_array({col}, '\\s+'), "
                f"lambda x: x <> '')), ' ')")

    return f"""
    alias0(ord, alias, canonical) AS (VALUES {aliases}), color0(ord, alias, canonical) AS (VALUES {colors}),
    aliases AS (SELECT *, {tokens('alias')} AS sorted FROM alias0),
    colors AS (SELECT *, {tokens('alias')} AS sorted FROM color0),
    raws AS (SELECT DISTINCT {raw} AS raw, trim(lower({raw})) AS key FROM {names_from}),
    keys AS (SELECT DISTINCT key, {tokens('key')} AS sorted FROM raws WHERE key <> ''
      AND key NOT IN (SELECT alias FROM aliases) AND key NOT IN (SELECT alias FROM colors)),
    sa AS ({scored('aliases')}), sc AS ({scored('colors')}),
    ba AS (SELECT key, arg_max(canonical, (score, -ord)) AS c, max(score) AS s FROM sa GROUP BY key),
    bc AS (SELECT key, arg_max(canonical, (score, -ord)) AS c, max(score) AS s FROM sc GROUP BY key),
    color AS (SELECT raw,
      CASE WHEN coalesce(r.key, '') = '' THEN NULL WHEN a.alias IS NOT NULL THEN a.canonical
        WHEN x.alias IS NOT NULL THEN x.canonical WHEN ba.s >= 70 THEN ba.c WHEN bc.s >= 70 THEN bc.c
        ELSE 'other' END AS exterior_color_canonical,
      CASE WHEN coalesce(r.key, '') = '' THEN 0.0 WHEN a.alias IS NOT NULL OR x.alias IS NOT NULL THEN 1.0
        WHEN ba.s >= 70 THEN round_even(ba.s / 100, 2) WHEN bc.s >= 70 THEN round_even(bc.s / 100, 2)
        ELSE 0.0 END AS color_confidence
      FROM raws r LEFT JOIN aliases a ON a.alias = r.key LEFT JOIN colors x ON x.alias = r.key
      LEFT JOIN ba ON ba.key = r.key LEFT JOIN bc ON bc.key = r.key)"""


def ads_sql(select: str) -> str:
    return f"WITH {ADS} SELECT {select} FROM ads"


@query("n1_generation", ads_sql(f"doc_id, year, {sql_generation('year', 'combined')} AS generation"))
def generation(spark, sf):
    text = F.concat_ws(" ", "title_raw", "description_raw")
    return A.ads(spark, sf).select("doc_id", "year", N.generation(F.col("year"), text).alias("generation"))


@query("n2_body_style", ads_sql(f"doc_id, {sql_classes('body_style_raw', D.BODY_STYLE_PATTERNS)} AS body_style"))
def body_style(spark, sf):
    return A.ads(spark, sf).select("doc_id", N.body_style(F.col("body_style_raw")).alias("body_style"))


@query("n3_transmission",
       ads_sql(f"doc_id, {sql_classes('transmission_raw', D.TRANSMISSION_PATTERNS)} AS transmission"))
def transmission(spark, sf):
    return A.ads(spark, sf).select("doc_id", N.transmission(F.col("transmission_raw")).alias("transmission"))


@query("n4_drivetrain", ads_sql(
    "doc_id, CASE WHEN lower(trim(drivetrain_raw)) = 'awd' THEN 'awd' ELSE 'rwd' END AS drivetrain"))
def drivetrain(spark, sf):
    return A.ads(spark, sf).select("doc_id", N.drivetrain(F.col("drivetrain_raw")).alias("drivetrain"))


_COLORED = f"""WITH {ADS}, {sql_color('exterior_color_raw', 'ads')}
SELECT doc_id, exterior_color_canonical, CAST(color_confidence AS DOUBLE) AS color_confidence
FROM ads LEFT JOIN color ON color.raw IS NOT DISTINCT FROM exterior_color_raw"""


def _colored(spark, sf):
    rows = with_color(A.ads(spark, sf), F.col("exterior_color_raw"), "exterior_color_canonical",
                      "color_confidence")
    return rows.select("doc_id", "exterior_color_canonical", "color_confidence")


@query("n5_color_exact", f"SELECT * FROM ({_COLORED}) WHERE color_confidence = 1.0")
def color_exact(spark, sf):
    """Colours that the dictionary settles."""
    return _colored(spark, sf).where(F.col("color_confidence") == 1.0)


@query("n6_color_fuzzy", f"""WITH {sql_color('p_name', 'part')}
SELECT p_partkey, p_name, exterior_color_canonical, CAST(color_confidence AS DOUBLE) AS color_confidence
FROM part JOIN color ON color.raw = p_name""")
def color_fuzzy(spark, sf):
    """Part names as colour names: nearly all go through the closest-alias search."""
    parts = A.table(spark, sf, "part").select("p_partkey", "p_name")
    return with_color(parts, F.col("p_name"), "exterior_color_canonical", "color_confidence")


@query("n7_color_fallback", f"""SELECT doc_id, exterior_color_canonical FROM ({_COLORED})
WHERE color_confidence = 0.0""")
def color_fallback(spark, sf):
    """Blank colours and the names nothing comes close to."""
    rows = _colored(spark, sf).where(F.col("color_confidence") == 0.0)
    return rows.select("doc_id", "exterior_color_canonical")


@query("t8_best_color_match", f"""WITH {sql_color('p_name', 'part')}
SELECT exterior_color_canonical, count(*) AS parts, max(CAST(color_confidence AS DOUBLE)) AS best
FROM part JOIN color ON color.raw = p_name GROUP BY 1""")
def best_color_match(spark, sf):
    return color_fuzzy(spark, sf).groupBy("exterior_color_canonical").agg(
        F.count("*").alias("parts"), F.max("color_confidence").alias("best"))


_FLAG_NAMES = ("matching_numbers", "original_paint", "service_history")


@query("n8_text_flags", ads_sql("doc_id, " + ", ".join(
    f"{sql_flag('description_raw', n)} AS {n}" for n in _FLAG_NAMES)))
def text_flags(spark, sf):
    ads, text = N.with_text_index(A.ads(spark, sf), "description_raw")
    return ads.select("doc_id", *[N.text_flag(text, n).alias(n) for n in _FLAG_NAMES])


@query("n9_modification_flags", ads_sql(
    f"doc_id, nullif({sql_mods('description_raw')}, '') AS modification_flags"))
def modification_flags(spark, sf):
    ads, text = N.with_text_index(A.ads(spark, sf), "description_raw")
    flags = F.array_join(N.modification_flags(text), ",")
    return ads.select("doc_id", flags.alias("modification_flags"))


_NORMALIZED = f"""WITH {ADS}, {sql_color('exterior_color_raw', 'ads')},
norm0 AS (SELECT ads.*, {sql_generation('year', 'combined')} AS generation,
  {sql_classes("coalesce(nullif(body_style_raw, ''), combined)", D.BODY_STYLE_PATTERNS)} AS body_style,
  {sql_classes("coalesce(nullif(transmission_raw, ''), combined)", D.TRANSMISSION_PATTERNS)} AS transmission,
  CASE WHEN lower(trim(drivetrain_raw)) = 'awd' THEN 'awd' ELSE 'rwd' END AS drivetrain,
  exterior_color_canonical, CAST(color_confidence AS DOUBLE) AS color_confidence,
  {sql_flag('description_raw', 'matching_numbers')} AS matching_numbers
  FROM ads LEFT JOIN color ON color.raw IS NOT DISTINCT FROM exterior_color_raw),
norm AS (SELECT *, (CAST(year IS NOT NULL AS INTEGER) + CAST(generation IS NOT NULL AS INTEGER)
    + CAST(body_style IS NOT NULL AS INTEGER) + CAST(transmission IS NOT NULL AS INTEGER)
    + CAST(coalesce(exterior_color_raw, '') <> '' AS INTEGER)
    + CAST(coalesce(mileage, 0) <> 0 AS INTEGER)) / 6.0::DOUBLE * 0.7 AS share FROM norm0),
scored AS (SELECT *, CAST(round(CAST(CASE WHEN exterior_color_canonical <> 'other'
    THEN share + color_confidence * 0.3 ELSE share END AS DECIMAL(18,6)), 2) AS DOUBLE)
    AS normalization_confidence FROM norm)"""


def _normalized(spark, sf):
    return normalize_records(A.ads(spark, sf))


@query("n10_confidence", f"{_NORMALIZED} SELECT doc_id, normalization_confidence FROM scored")
def confidence(spark, sf):
    return _normalized(spark, sf).select("doc_id", "normalization_confidence")


@query("n11_lenient_dates", ads_sql("""doc_id, listing_date AS raw_date,
  coalesce(CAST(try_strptime(listing_date, '%Y-%m-%d') AS DATE),
    CAST(try_strptime(listing_date, '%Y-%m-%dT%H:%M:%S') AS DATE),
    CAST(try_strptime(listing_date, '%Y-%m-%dT%H:%M:%SZ') AS DATE),
    CAST(try_strptime(listing_date, '%B %d, %Y') AS DATE)) AS listing_date"""))
def lenient_dates(spark, sf):
    raw = F.col("listing_date")
    return A.ads(spark, sf).select("doc_id", raw.alias("raw_date"), N.lenient_date(raw).alias("listing_date"))


@query("n12_normalized_records", f"""{_NORMALIZED}
SELECT doc_id, source, source_url, year, generation, body_style, transmission, drivetrain,
  exterior_color_canonical, mileage, matching_numbers,
  {sql_flag('description_raw', 'original_paint')} AS original_paint,
  {sql_flag('description_raw', 'service_history')} AS service_history,
  nullif({sql_mods('description_raw')}, '') AS modifications, normalization_confidence FROM scored""")
def normalized_records(spark, sf):
    return _normalized(spark, sf).select(
        "doc_id", "source", "source_url", "year", "generation", "body_style", "transmission",
        "drivetrain", "exterior_color_canonical", "mileage", "matching_numbers", "original_paint",
        "service_history", F.array_join("modification_flags", ",").alias("modifications"),
        "normalization_confidence",
    )


@query("n13_seller_type", ads_sql("""doc_id, CASE WHEN contains(lower(seller_type_raw), 'auction')
  THEN 'auction_house' WHEN contains(lower(seller_type_raw), 'dealer') THEN 'dealer'
  WHEN contains(lower(seller_type_raw), 'private') THEN 'private' END AS seller_type"""))
def seller_type(spark, sf):
    return A.ads(spark, sf).select("doc_id", N.seller_type(F.col("seller_type_raw")).alias("seller_type"))


_COMP_COLS = """source, source_url, year, generation, body_style, transmission,
  exterior_color_canonical, mileage, CAST(final_price AS DECIMAL(10,2)) AS sale_price, price_type,
  CASE price_type WHEN 'auction_final' THEN 0.95::DOUBLE WHEN 'estimate' THEN 0.2::DOUBLE
    ELSE 0.4::DOUBLE END AS confidence_score"""


@query("n15_comp_records", f"{_NORMALIZED} SELECT {_COMP_COLS} FROM scored")
def comp_records(spark, sf):
    """Normalized records in comp shape, with sale price and confidence filled."""
    comps = N.as_comps(_normalized(spark, sf))
    return comps.select("source", "source_url", "year", "generation", "body_style", "transmission",
                        "exterior_color_canonical", "mileage", "sale_price", "price_type",
                        "confidence_score")


@query("n14_column_filter", f"""{_NORMALIZED}
SELECT count(*) AS records, 'source,source_url,year,generation,body_style,drivetrain,transmission,'
  || 'exterior_color_raw,exterior_color_canonical,mileage,vin,currency,final_price,matching_numbers,'
  || 'original_paint,service_history,modification_flags,normalization_confidence,description_raw,'
  || 'listing_date,seller_type,title_raw' AS kept FROM scored""")
def column_filter(spark, sf):
    """Which columns of a normalized record the listing table takes."""
    from bandwise.schemas import LISTING_COLUMNS

    kept = N.only_columns(_normalized(spark, sf), LISTING_COLUMNS)
    return kept.agg(F.count("*").alias("records")).withColumn("kept", F.lit(",".join(kept.columns)))


_DEDUCT = """100 - (CASE WHEN year IS NULL THEN 15 ELSE 0 END) - (CASE WHEN generation IS NULL THEN 15 ELSE 0 END)
 - (CASE WHEN transmission IS NULL THEN 10 ELSE 0 END) - (CASE WHEN body_style IS NULL THEN 5 ELSE 0 END)
 - (CASE WHEN exterior_color_canonical = 'other' THEN 5 ELSE 0 END)
 - (CASE WHEN color_confidence < 0.8 THEN 5 ELSE 0 END) - (CASE WHEN vin IS NULL THEN 5 ELSE 0 END)
 - (CASE WHEN matching_numbers IS NULL THEN 5 ELSE 0 END)"""


@query("n16_deduction_confidence", f"""{_NORMALIZED}, p AS (SELECT doc_id, {_DEDUCT} AS pts FROM scored)
SELECT doc_id, pts / 100.0 AS score, CASE WHEN pts >= 85 THEN 'high' WHEN pts >= 65 THEN 'medium'
  ELSE 'low' END AS tier FROM p""")
def deduction_confidence(spark, sf):
    return _deducted(spark, sf).select("doc_id", "score", "tier")


def _deducted(spark, sf):
    rows = _normalized(spark, sf).withColumn("possible_duplicate_id", F.lit(None).cast("string"))
    names = ["year", "generation", "transmission", "body_style", "color_confidence", "vin",
             "possible_duplicate_id", "matching_numbers"]
    row = {n: F.col(n) for n in names} | {"color": F.col("exterior_color_canonical")}
    scored = rows.withColumn("score", N.deduction_confidence(row))
    return scored.withColumn("tier", N.confidence_tier(F.col("score")))


@query("q3_review_queue", f"""{_NORMALIZED}, p AS (SELECT *, {_DEDUCT} AS pts FROM scored)
SELECT doc_id, source, pts / 100.0 AS score FROM p WHERE pts < 65""")
def review_queue(spark, sf):
    """Records whose confidence is too low for the bands."""
    return _deducted(spark, sf).where(F.col("tier") == "low").select("doc_id", "source", "score")


# The dictionaries as files: the fixed ones with other meanings for some aliases and years.
_ALIAS_FILE = {c: [*(a for a in names if a != "midnight blue"), *(["midnight blue", "signl red"] if c == "blue" else [])]
               for c, names in D.COLOR_ALIASES.items()}
_YEARS_FILE = (("G0", 1958, 1964), ("G2", 1970, 1977), *(g for g in D.GENERATION_YEARS if g[0] != "G2"))
_YEARS_FILE = (*_YEARS_FILE[:2], ("G1", 1965, 1969), *_YEARS_FILE[3:])
_FILE_ALIASES = {a.lower().strip(): c for c, names in _ALIAS_FILE.items() for a in names}


def _write_dictionaries(spark, folder):
    years = {str(y): g for g, first, last in _YEARS_FILE for y in range(first, last + 1)}
    shared = {str(y): {"earlier": a, "later": b, "words": list(words)} for y, (a, b, words) in D.SHARED_YEARS.items()}
    for name, content in (("aliases", {"aliases": _ALIAS_FILE}), ("years", {"year_to_generation": years, "shared_years": shared})):
        spark.createDataFrame([(json.dumps(content),)], "value string").write.text(f"{folder}/{name}")


@query("src5_dictionary_files", f"""WITH {ADS}, {sql_color('exterior_color_raw', 'ads', _FILE_ALIASES)}
SELECT doc_id, {sql_generation('year', 'combined', _YEARS_FILE)} AS generation, exterior_color_canonical,
  CAST(color_confidence AS DOUBLE) AS color_confidence
FROM ads LEFT JOIN color ON color.raw IS NOT DISTINCT FROM exterior_color_raw""")
def dictionary_files(spark, sf):
    """Colours and generations by dictionaries read from files, which differ from the fixed ones."""
    folder = run_folder(spark, "dictionaries")
    _write_dictionaries(spark, folder)
    aliases, years = files.alias_table(spark, f"{folder}/aliases"), files.year_table(spark, f"{folder}/years")
    ads = with_generation_of(A.ads(spark, sf), "year", F.concat_ws(" ", "title_raw", "description_raw"), years, "generation")
    rows = with_color_of(ads, F.col("exterior_color_raw"), aliases, "exterior_color_canonical", "color_confidence")
    return rows.select("doc_id", "generation", "exterior_color_canonical", "color_confidence")
