import datetime as dt

from pyspark.sql import functions as F

from bandwise.operators.normalizing import normalize_records
from bandwise.schemas import RAW_PAGE_SCHEMA
from bandwise.sources import files, snapshots
from bandwise.sources import parsing as P
from bandwise.streaming.pipelines import PriceTracker

AT = dt.datetime(2025, 3, 15, 12)
BAT_DONE = """<html><head><meta property="article:published_time" content="2025-02-11T08:30:00Z"></head><body>
<h1 class="post-title listing-post-title">1990 Porsche 911 Carrera 4 Coupe</h1>
<div class="bid-result"> Sold for $58,250 on March 4, 2025 | 31 bids </div>
<div class="item"><ul><li>Chassis: WP0AB2966LS450777</li><li>3.6-Liter Engine<li>5-Speed Manual Gearbox
<li>112,300 Miles</li><li>Exterior Color: Guards Red over Tan</li></ul></div>
<div class="post-description">Service history on file.</div></body></html>"""
CNB_OPEN = """<div class="auction-title"><h1>1994 Porsche 911 Carrera Coupe</h1></div>
<div class="current-bid"><span class="bid-value">$47,750</span></div>
<div class="quick-facts"><dl><dt>Mileage</dt><dd>88,400 miles</dd><dt>Transmission</dt><dd>6-Speed Manual</dd>
<dt>Exterior Color</dt><dd>Guards Red</dd></dl></div>
<ul class="stats"><li><span>Bids</span><span>12</span></li></ul>"""


def _pages(spark, *rows):
    return spark.createDataFrame(
        [(s, u, AT, c, "html", code) for s, u, c, code in rows], RAW_PAGE_SCHEMA)


def test_golden_pages(spark):
    pages = _pages(spark, ("bat", "u1", BAT_DONE, 200), ("carsandbids", "u2", CNB_OPEN, 200),
                   ("bat", "u3", "<h1>No year</h1>", 200), ("pcarmarket", "u4", "", 200),
                   ("ebay", "u5", "{not json", 200))
    rows = {r["source_url"]: r for r in P.routed(P.parse_pages(pages)).collect()}
    assert set(rows) == {"u1", "u2"}
    done, live = rows["u1"], rows["u2"]
    assert (done["year"], done["transmission_raw"], done["mileage"], done["final_price"]) == (1990, "manual", 112300, 58250.0)
    assert (done["sale_date"], done["bidder_count"], done["route"]) == (dt.date(2025, 3, 4), 31, "comp")
    assert (done["exterior_color_raw"], done["vin"], done["engine_variant"]) == ("Guards Red", "WP0AB2966LS450777", "3.6")
    assert (live["asking_price"], live["bidder_count"], live["mileage"], live["route"]) == (47750.0, 12, 88400, "listing")
    assert live["body_style_raw"] == "coupe" and not live["is_completed"]
    normal = normalize_records(P.parse_pages(pages)).where("source_url = 'u1'").first()
    assert (normal["generation"], normal["exterior_color_canonical"], normal["service_history"]) == ("G5", "red", True)


def test_archive_round_trip(spark, tmp_path):
    folder = tmp_path / "bat" / "2025-03-15"
    folder.mkdir(parents=True)
    (folder / "x_1.html").write_text("<h1>hi</h1>\nthere")
    row = snapshots.read_archive(spark, str(tmp_path)).first()
    assert (row["source"], str(row["fetch_date"]), row["slug"], row["content"]) == (
        "bat", "2025-03-15", "x_1", "<h1>hi</h1>\nthere")
    pages = _pages(spark, ("bat", "http://a/b?c", "x", 200), ("bat", "http://a/d", "", 200))
    snapshots.write_snapshots(pages, str(tmp_path / "cols"))
    kept = snapshots.read_snapshots(spark, str(tmp_path / "cols")).collect()
    assert [r["url"] for r in kept] == ["http://a/b?c"] and kept[0]["slug"].startswith("a_b_c_")


def test_reference_files_and_manual_import(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"aliases": {"red": ["Guards Red ", "rot"]}}')
    assert sorted(tuple(r) for r in files.read_aliases(spark, str(tmp_path / "a.json")).collect()) == [
        ("guards red", "red"), ("rot", "red")]
    (tmp_path / "y.json").write_text('{"year_to_generation": {"1970": "G1"}}')
    assert [tuple(r) for r in files.read_year_table(spark, str(tmp_path / "y.json")).collect()] == [(1970, "G1")]
    (tmp_path / "m.csv").write_text(
        "source_url,year,generation,body_style,trim,transmission,exterior_color_raw,mileage,asking_price,"
        "currency,description_raw,listing_date,seller_type,location\n"
        "u,1988,G4,coupe,Carrera,manual,Guards Red,78000,49500,USD,service records,2025-03-14,private,Austin\n")
    row = normalize_records(files.import_manual(spark, str(tmp_path / "m.csv"))).first()
    assert (row["generation"], row["transmission"], row["seller_type"], row["service_history"]) == (
        "G4", "manual", "private", True)


def test_late_rows_never_overwrite(spark, tmp_path):
    tracker = PriceTracker(spark, str(tmp_path / "t"))
    schema = "listing_key bigint, scrape_ts timestamp, event_id bigint, price decimal(10,2), status_code int"

    def batch(*rows):
        from decimal import Decimal
        return spark.createDataFrame([(1, AT + dt.timedelta(hours=h), i, Decimal(p), 200) for h, i, p in rows], schema)

    tracker.process(batch((0, 1, 100), (5, 2, 90)), 0)
    tracker.process(batch((2, 3, 10), (6, 4, 80)), 1)
    tracker.process(batch((2, 3, 10), (6, 4, 80)), 1)  # a retried batch
    assert [float(r["price"]) for r in tracker.prices(1).collect()] == [80.0]
    assert sorted((float(r["old_price"]), float(r["new_price"])) for r in tracker.drops().collect()) == [
        (90.0, 80.0), (100.0, 90.0)]
    assert [r["event_id"] for r in tracker.late().collect()] == [3]


def test_manual_records_keep_their_texts(spark, tmp_path):
    told = ['He said "sold", twice', "two\nlines, one\r\nlisting", " ends in a quote\"", "back\\slash", '"', None]
    sheet = spark.createDataFrame(
        [(f"u{k}", 1988, t) for k, t in enumerate(told)], "source_url string, year int, description_raw string")
    for name in files.MANUAL_SCHEMA.split(", "):
        column, kind = name.split()
        if column not in sheet.columns:
            sheet = sheet.withColumn(column, F.lit(None).cast(kind))
    columns = [c.split()[0] for c in files.MANUAL_SCHEMA.split(", ")]
    files.export_csv(sheet.select(columns), str(tmp_path / "sheet"))
    rows = files.import_manual(spark, str(tmp_path / "sheet")).collect()
    got = {r.source_url: r.description_raw for r in rows}
    assert got == {f"u{k}": t for k, t in enumerate(told)}
    assert {r.source for r in rows} == {"manual"} and {r.year for r in rows} == {1988}
