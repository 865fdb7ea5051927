"""Bulk extraction: auction pages derived from the orders, and the raw page table.

The oracles state what the pages were made from, so they check the extraction end to end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bandwise import adapters as A
from bandwise.functions import extract as X
from bandwise.functions.dom import Pick, fragments
from bandwise.plans.normalize_queries import choose
from bandwise.plans.registry import query
from bandwise.sources import parsing as P

PAGES = f"""
f0 AS (SELECT o_orderkey AS k, {choose(A.SITES, 'o_orderkey')} AS source,
  CAST(o_orderkey % 45 + 1958 AS INTEGER) AS y, {choose(A.TRIM_TEXTS, 'o_orderkey')} AS tr,
  {choose(A.BODY_TEXTS, 'o_orderkey')} AS body, {choose(A.GEAR_TEXTS, 'o_orderkey // 4')} AS gear,
  {choose(A.ENGINE_TEXTS, 'o_orderkey')} AS engine, {choose(A.PAINT_TEXTS, 'o_orderkey')} AS paint,
  {choose(A.PHRASES, 'o_orderkey')} AS phrase, CAST(o_orderkey * 37 % 200000 + 1 AS INTEGER) AS miles,
  floor(o_totalprice) AS price, 'WP0ZZZ' || lpad(CAST(o_orderkey AS VARCHAR), 11, '0') AS vin,
  CAST(o_orderkey % 60 + 1 AS INTEGER) AS bids, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS state,
  'City ' || o_custkey AS city, o_orderkey % 53 AS turn FROM orders),
f AS (SELECT *, 'https://' || source || '.example/listing/' || k AS source_url,
  CASE turn WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 301 ELSE 200 END AS status_code,
  turn <> 3 AND CASE source WHEN 'ebay' THEN TRUE WHEN 'pcarmarket' THEN turn NOT IN (0, 1, 2)
    ELSE turn NOT IN (0, 1) END AS passes,
  source IN ('bat', 'carsandbids') AS strict,
  rtrim(y || ' Porsche 911 ' || tr || CASE WHEN source = 'ebay' THEN '' ELSE ' ' || body END) AS title FROM f0),
g AS (SELECT * FROM f WHERE passes AND (NOT strict OR y BETWEEN 1960 AND 1999))
"""


def expected(select: str, where: str = "TRUE") -> str:
    return f"WITH {PAGES} SELECT source_url, {select} FROM g WHERE {where}"


def parsed(spark, sf, *names):
    """The pages parsed, as far as these columns and where they come from go."""
    return P.parse_pages(A.auction_pages(spark, sf), columns=("source", "source_url", *names))


def _fields(*names):
    def run(spark, sf):
        return parsed(spark, sf, *names).select("source_url", *names)

    return run


@query("x1_page_gate", f"WITH {PAGES} SELECT source, count(*) AS pages FROM f WHERE passes GROUP BY 1")
def page_gate(spark, sf):
    """Pages that pass the gate of their source."""
    pages = A.auction_pages(spark, sf)
    loose = P.readable(pages.where(F.col("source").isin("bat", "carsandbids")))
    strict = P.readable(pages.where(F.col("source") == "pcarmarket"), (200,))
    json = pages.where((F.col("source") == "ebay") & (F.length("content") > 0))
    passed = loose.unionByName(strict).unionByName(json)
    return passed.groupBy("source").agg(F.count("*").alias("pages"))


query("x2_texts", expected("""title AS title_raw,
  CASE source WHEN 'bat' THEN trim('A car. ' || phrase) WHEN 'carsandbids' THEN trim('A car. ' || phrase)
    ELSE trim('A car. ' || phrase) END AS description_raw,
  CASE WHEN source IN ('bat', 'carsandbids') THEN city END AS location,
  CASE WHEN source IN ('ebay', 'pcarmarket') THEN city END AS seller_name"""))(
    _fields("title_raw", "description_raw", "location", "seller_name"))

_UNESCAPED = "replace(replace({}, '&quot;', '\"'), '&amp;', '&')"


@query("x2_page_titles", f"""SELECT page_id,
  {_UNESCAPED.format("trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1))")} AS heading,
  {_UNESCAPED.format("trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1))")} AS title FROM pages""")
def page_titles(spark, sf):
    """First heading and title of the raw page table through the document tree."""
    spec = {"slots": {"heading": Pick(("h1",), text="tight"), "title": Pick(("title",), text="tight")}}
    pages = A.table(spark, sf, "pages").withColumn("f", fragments(F.col("html"), spec))
    return pages.select("page_id", X.slot_first("f", "heading").alias("heading"),
                        X.slot_first("f", "title").alias("title"))


query("x3_year", expected("CASE WHEN y BETWEEN 1965 AND 1999 OR (strict AND y BETWEEN 1960 AND 1999) THEN y END AS year"))(
    _fields("year"))

query("x4_trim", expected("CASE WHEN strict THEN trim(tr || ' ' || body) ELSE tr END AS trim"))(_fields("trim"))


@query("x5_item_specs", f"""WITH {PAGES} SELECT source_url, vin AS chassis, paint || ' over Tan Cloth' AS exterior_color
FROM g WHERE source = 'bat'""")
def item_specs(spark, sf):
    """Labelled list items of the first source as a map."""
    rows = P.bat_pages(A.auction_pages(spark, sf).where(F.col("source") == "bat"))
    specs = rows.select(
        F.col("url").alias("source_url"),
        F.map_from_entries(F.transform(
            F.filter(X.slot("f", "items"), lambda t: t.contains(":")),
            lambda t: F.struct(F.lower(F.trim(F.substring_index(t, ":", 1))),
                               F.trim(F.regexp_replace(t, "^[^:]*:", ""))))).alias("m"),
    )
    return specs.select(
        "source_url", F.col("m")["chassis"].alias("chassis"),
        F.col("m")["exterior color"].alias("exterior_color"))


@query("x6_pair_specs", f"""WITH {PAGES} SELECT k AS page_id, format('{{:,}}', miles) || ' miles' AS mileage,
  nullif(gear, '') AS transmission, paint AS exterior_color, vin FROM f WHERE source = 'carsandbids' AND passes""")
def pair_specs(spark, sf):
    """Term/definition pairs of the preferred container only."""
    rows = P.readable(A.auction_pages(spark, sf).where(F.col("source") == "carsandbids"))
    specs = rows.withColumn("f", fragments(F.col("content"), P.CARSANDBIDS)).withColumn(
        "e", X.spec_entries("f"))
    return specs.select(
        "page_id", X.spec_last("e", "mileage").alias("mileage"),
        X.spec_last("e", "transmission").alias("transmission"),
        X.spec_last("e", "exterior color").alias("exterior_color"), X.spec_last("e", "vin").alias("vin"))


@query("x7_label_lookup", f"""WITH {PAGES} SELECT k AS page_id, gear AS transmission, paint AS color, engine
FROM f WHERE source = 'pcarmarket' AND passes""")
def label_lookup(spark, sf):
    """First entry that bears any of several labels, over lists, rows and items."""
    rows = P.readable(A.auction_pages(spark, sf).where(F.col("source") == "pcarmarket"), (200,))
    specs = rows.withColumn("f", fragments(F.col("content"), P.PCARMARKET)).withColumn(
        "e", X.spec_entries("f"))
    return specs.select(
        "page_id", X.spec_first("e", "transmission", "gearbox").alias("transmission"),
        X.spec_first("e", "exterior color", "color", "exterior").alias("color"),
        X.spec_first("e", "engine", "displacement").alias("engine"))


query("x8_json_specs", expected(
    "gear AS transmission_raw, paint AS exterior_color_raw, tr AS trim, body AS body_style_raw", "source = 'ebay'"))(
    lambda spark, sf: P.parse_pages(A.auction_pages(spark, sf), {"ebay": P.SOURCES["ebay"]}).select(
        "source_url", "transmission_raw", "exterior_color_raw", "trim", "body_style_raw"))

query("x9_mileage", expected("miles AS mileage"))(_fields("mileage"))

query("x10_ask", expected("""CAST(CASE WHEN source = 'carsandbids' AND state <> 'O' THEN NULL
  WHEN source = 'pcarmarket' AND state <> 'O' THEN NULL ELSE price END AS DOUBLE) AS asking_price"""))(
    _fields("asking_price"))

query("x11_json_price", expected("CAST(price AS DOUBLE) AS asking_price, 'EUR' AS currency", "source = 'ebay'"))(
    lambda spark, sf: P.parse_pages(A.auction_pages(spark, sf), {"ebay": P.SOURCES["ebay"]}).select(
        "source_url", "asking_price", "currency"))

query("x12_vin", expected("vin"))(_fields("vin"))

query("x13_engine", expected("""CASE WHEN NOT strict THEN engine
  ELSE nullif(regexp_extract(CASE WHEN engine <> '' THEN engine ELSE phrase END,
    '(2\\.0|2\\.2|2\\.4|2\\.7|3\\.0|3\\.2|3\\.3|3\\.6|3\\.8|3\\.5)', 1), '') END AS engine_variant"""))(
    _fields("engine_variant"))

query("x14_color", expected("paint AS exterior_color_raw"))(_fields("exterior_color_raw"))

query("x15_classes", expected("""
  CASE WHEN NOT strict THEN body ELSE nullif(lower(body), '') END AS body_style_raw,
  CASE WHEN NOT strict THEN gear WHEN gear LIKE 'Tiptronic%' THEN 'auto' WHEN gear LIKE '6-Speed%' THEN 'manual-6sp'
    WHEN gear LIKE '5-Speed%' OR gear LIKE '915%' THEN 'manual' END AS transmission_raw,
  CASE WHEN strict AND tr = 'Carrera 4' THEN 'awd' END AS drivetrain_raw""",
    "source <> 'pcarmarket'"))(
    lambda spark, sf: parsed(spark, sf, "body_style_raw", "transmission_raw", "drivetrain_raw").where(
        F.col("source") != "pcarmarket").select(
        "source_url", "body_style_raw", "transmission_raw", "drivetrain_raw"))

query("x16_result", expected("""CAST(CASE WHEN source = 'bat' OR state <> 'O' THEN price END AS DOUBLE) AS final_price,
  CASE WHEN state <> 'O' THEN day END AS sale_date"""))(_fields("final_price", "sale_date"))

query("x17_completed", expected("state <> 'O' AS is_completed"))(_fields("is_completed"))

query("x18_bids", expected("CASE WHEN source <> 'ebay' THEN bids END AS bidder_count"))(_fields("bidder_count"))

query("x19_listing_date", expected("CAST(day AS VARCHAR) AS listing_date"))(_fields("listing_date"))


@query("x20_strip_html", r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '\s+', ' ', 'g')) AS summary FROM pages""")
def strip_html(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("summary"))


query("x21_scheduled_route", expected("CASE WHEN state <> 'O' THEN 'comp' ELSE 'listing' END AS route"))(
    lambda spark, sf: P.routed(parsed(spark, sf, *P.ROUTED_BY)).select("source_url", "route"))

query("x22_script_route", expected(
    "CASE WHEN state <> 'O' OR source = 'bat' THEN 'comp' ELSE 'listing' END AS route"))(
    lambda spark, sf: P.routed(parsed(spark, sf, *P.ROUTED_BY), "comp_first").select("source_url", "route"))


@query("x21_page_outcomes", f"""WITH {PAGES} SELECT source, CASE WHEN status_code = 404 THEN 'removed'
  WHEN status_code <> 200 THEN 'fetch_error' WHEN NOT passes OR (strict AND y NOT BETWEEN 1960 AND 1999)
  THEN 'extraction_error' WHEN state <> 'O' THEN 'comp' ELSE 'listing' END AS outcome, count(*) AS pages
FROM f GROUP BY ALL""")
def page_outcomes(spark, sf):
    """What became of every page of a run."""
    pages = A.auction_pages(spark, sf)
    outcomes = P.page_outcomes(pages)
    return outcomes.groupBy("source", "outcome").agg(F.count("*").alias("pages"))
