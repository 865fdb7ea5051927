"""The driver's tables in the roles of this domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SITES = ("bat", "carsandbids", "ebay", "pcarmarket")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    """values[index mod n] as an expression."""
    return F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int")
    )


def _sales(lines: DataFrame, parts: DataFrame, status: str) -> DataFrame:
    lines = lines.where(F.col("l_linestatus") == status)
    cents = F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .withColumn("cents", cents)
        .withColumn("tax", F.round(F.col("l_tax") * 100).cast("int"))
        .withColumn("ship_day", F.col("l_shipdate").cast("date"))
    )


def _shared_columns() -> list[Column]:
    return [
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        pick(SITES, F.col("l_orderkey")).alias("source"),
        F.concat(F.lit("https://market.example/item/"), "l_orderkey", F.lit("-"), "l_linenumber")
        .alias("source_url"),
        (F.col("l_orderkey") % 34 + 1965).cast("int").alias("year"),
        F.col("p_brand").alias("generation"),
        F.col("p_type").alias("body_style"),
        F.col("l_returnflag").alias("transmission"),
        F.split("p_name", " ")[0].alias("exterior_color_canonical"),
        (F.col("l_quantity").cast("int") * 2000 + F.col("l_suppkey") % 700)
        .cast("int").alias("mileage"),
        pick(("USD", "EUR", "GBP"), F.col("l_orderkey")).alias("currency"),
        F.when(
            F.col("l_linenumber") <= 3,
            F.concat(F.lit("WP0ZZZ"), F.lpad(F.col("l_partkey").cast("string"), 11, "0")),
        ).alias("vin"),
    ]


def _money(cents: str) -> Column:
    return (F.col(cents).cast("decimal(12,0)") / 100).cast("decimal(10,2)")


def comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed sales: shipped lines, one row each."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return _sales(lines, parts, "F").select(
        *_shared_columns(),
        _money("cents").alias("sale_price"),
        F.col("ship_day").alias("sale_date"),
        F.when(F.col("tax") < 6, "auction_final")
        .when(F.col("tax") == 6, "dealer_ask")
        .when(F.col("tax") == 7, "private_ask")
        .otherwise("estimate").alias("price_type"),
        F.round(1 - F.col("l_discount"), 2).cast("decimal(4,2)").alias("confidence_score"),
        F.col("ship_day").cast("timestamp").alias("created_at"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks: open lines, one row each."""
    return listings_from(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def listings_from(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """The same from given lines, which may be a stream."""
    return _sales(lines, parts, "O").select(
        *_shared_columns(),
        _money("cents").alias("asking_price"),
        F.col("ship_day").alias("listing_date"),
        F.when(F.col("tax") == 0, "removed")
        .when(F.col("tax") == 1, "ended")
        .when(F.col("tax") == 2, "sold")
        .when(F.col("tax") == 3, "relist")
        .otherwise("active").alias("listing_status"),
        F.round(1 - F.col("l_discount"), 2).cast("decimal(4,2)").alias("normalization_confidence"),
        F.array(
            F.struct(
                F.round("p_retailprice", 2).alias("price"),
                F.date_sub("ship_day", 7).cast("string").alias("ts"),
            )
        ).alias("price_history"),
        F.col("ship_day").cast("timestamp").alias("created_at"),
    )


def snapshot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price observations over time: one row per event, keyed by user; an error is a 404."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("listing_key"),
        F.col("ts").cast("timestamp").alias("scrape_ts"),
        "event_id",
        F.round(F.col("value"), 2).cast("decimal(10,2)").alias("price"),
        F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status_code"),
        "event_type",
        "props",
    )


# Wordings that the derived ads cycle through.
PHRASES = (
    "Matching numbers engine, original paint and service records on file.",
    "The engine was replaced by a rebuilt engine; repainted in 1990.",
    "Numbers matching with a widebody kit, lowered on coilovers.",
    "No service records. Non-matching block with a 3.6 swap.",
    "Unrestored barn find with original books; aftermarket alloy wheels.",
    "Sport exhaust and a roll cage, factory paint, documented history.",
    "Records missing, color change, turbo kit fitted.",
    "BBS wheels, dealer maintained, original factory finish.",
    "",
)
TRIMS = ("Carrera 2", "Carrera 3.2", "964 Targa", "993 Coupe", "SC", "Tiptronic cabriolet", "Turbo")
BODIES = ("Coupe", "CABRIOLET", "Targa top", "Speedster", "sedan", "", None, "Roadster", "Hardtop targa")
GEARBOXES = ("five gears, 5-speed (G50)", "Tiptronic S", "6-speed", "automatic", "", "915", "Getrag box",
             "stick shift", None, "6 speed manual")
DRIVES = ("awd", "AWD", "rwd", "fwd", "", None)
PAINTS = ("Signal Red", "  grand prix white ", "black", "Biscay Blue", "linen", "Signl Red",
          "riviera blu metalic", "Slate Grey", "xyzzy", "", None, "metallic cobalt blue",
          "Wine Red", "Grey", "dark-green", "irish greeen", "golden brown", "   ")
SELLERS = ("auction_house", "Private party", "Franchise DEALER", "dealer auction", "", None, "broker")
DATES = ("2025-03-14", "2025-03-14T10:20:30", "2025-03-14T10:20:30Z", "February 20, 2025",
         "May 1, 2025", "14.03.2025", "", None)


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed ads: each document's whole text, closed by one of the wordings above."""
    n = F.col("doc_id")
    year = F.when(n % 13 != 0, (n * 7 % 45 + 1958).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        pick(SITES, n).alias("source"),
        F.concat(F.lit("https://market.example/ad/"), n).alias("source_url"),
        year.alias("year"),
        F.concat(F.coalesce(year.cast("string"), F.lit("")), F.lit(" Porsche 911 "),
                 pick(TRIMS, n)).alias("title_raw"),
        F.concat(F.col("text"), F.lit(" "), pick(PHRASES, n)).alias("description_raw"),
        pick(BODIES, n).alias("body_style_raw"),
        pick(GEARBOXES, F.floor(n / 3)).alias("transmission_raw"),
        pick(DRIVES, n).alias("drivetrain_raw"),
        pick(PAINTS, n).alias("exterior_color_raw"),
        F.when(n % 5 != 0, (n * 31 % 200_000).cast("int")).alias("mileage"),
        F.when(n % 4 != 0, F.concat(F.lit("WP0ZZZ"), F.lpad(n.cast("string"), 11, "0"))).alias("vin"),
        pick(SELLERS, n).alias("seller_type_raw"),
        pick(DATES, n).alias("listing_date"),
        F.lit(None).cast("string").alias("currency"),
        ((n * 997 % 90_000) + 10_000).cast("decimal(10,2)").alias("final_price"),
        pick(("auction_final", "dealer_ask", "private_ask", "estimate"), F.floor(n / 2)).alias("price_type"),
    )


GEAR_TEXTS = ("5-Speed, short throw", "Tiptronic, four gears", "6-Speed, close ratio", "Automatic", "", "915 gearbox")
ENGINE_TEXTS = ("3.6 boxer", "3.2 boxer, rebuilt", "2.7 Turbo", "3.0 injected", "2.4 twin plug",
                "3.8 on carburettors", "")
PAINT_TEXTS = ("Petrol Blue", "Chalk White", "Signal Orange", "Black", "Mint Green")
BODY_TEXTS = ("Coupe", "Targa", "Cabriolet", "Speedster", "")
#: Pages that one task builds at most, some 150 MB.
PAGES_PER_TASK = 50_000
TRIM_TEXTS = ("Carrera", "Carrera 4", "SC")


def _page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    # A page is some fifty times wider than its order row, so the rows are spread before. The
    # count is read from the file footers.
    orders = table(spark, sf_dir, "orders")
    tasks = max(spark.sparkContext.defaultParallelism, -(-orders.count() // PAGES_PER_TASK))
    orders = orders.repartition(tasks, "o_orderkey")
    return orders.select(
        k.alias("k"),
        pick(SITES, k).alias("source"),
        (k % 45 + 1958).cast("string").alias("y"),
        pick(TRIM_TEXTS, k).alias("trim"), pick(BODY_TEXTS, k).alias("body"),
        pick(GEAR_TEXTS, F.floor(k / 4)).alias("gear"), pick(ENGINE_TEXTS, k).alias("engine"),
        pick(PAINT_TEXTS, k).alias("paint"), pick(PHRASES, k).alias("phrase"),
        F.format_number(k * 37 % 200_000 + 1, 0).alias("miles"),
        F.format_number(F.floor("o_totalprice"), 0).alias("price"),
        F.concat(F.lit("WP0ZZZ"), F.lpad(k.cast("string"), 11, "0")).alias("vin"),
        (k % 60 + 1).cast("string").alias("bids"),
        F.date_format(day, "MMMM d, yyyy").alias("long_day"),
        F.date_format(day, "yyyy-MM-dd").alias("iso_day"),
        F.col("o_orderstatus").alias("state"),
        F.concat(F.lit("City "), F.col("o_custkey").cast("string")).alias("city"),
    )


def auction_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages in the shapes of the four sites, one per order. State F is sold, P ended
    without a sale, O still open; some pages failed or came back empty."""
    rows = _page_facts(spark, sf_dir)

    def fill(template: str) -> Column:
        """Template with {column} fields as a concatenation."""
        parts = []
        for i, piece in enumerate(template.replace("{", "}").split("}")):
            parts.append(F.col(piece) if i % 2 else F.lit(piece))
        return F.concat(*parts)

    sold, over = F.col("state") == "F", F.col("state") == "P"
    bat_end = (
        F.when(sold, fill('<div class="bid-result">Sold for ${price} on {long_day} | {bids} bids</div>'))
        .when(over, fill('<div class="bid-result">No sale. Bid to ${price} on {long_day}</div>'))
        .otherwise("")
    )
    bat = F.concat(
        fill('<html><head><meta property="article:published_time" content="{iso_day}T10:00:00Z">'
             '<title>{y} &amp; more</title>'
             '<script>var s="<h1>no</h1>";</script></head><body>'
             '<h1 class="post-title listing-post-title">{y} Porsche 911 {trim} {body}</h1>'),
        bat_end,
        fill('<div class="listing-stats"><span class="info-value noborder-tiny">${price}</span>'
             '<span class="info-value noborder-tiny">{bids} bids</span></div>'
             '<div class="item"><ul><li>Chassis: <b>{vin}</b></li><li>{engine}</li><li>{gear}</li>'
             '<li>{miles} Miles</li><li>Exterior Color: {paint} over Tan Cloth</li>'
             '<li><a href="/search?q={vin}">{vin}</a></li></ul></div>'
             '<div class="item item-seller"><a href="https://maps.google.com/maps/place/x">{city}</a></div>'
             '<div class="post-description"><p>A car.<p>{phrase}</div></body></html>'),
    )
    box = F.when(F.col("state") == "O", "current-bid").otherwise("current-bid ended")
    cnb = F.concat(
        fill('<html><head><meta property="article:published_time" content="{iso_day}T09:00:00Z"></head><body>'
             '<div class="auction-title"><h1>{y} Porsche 911 {trim} {body}</h1></div><div class="'),
        box,
        fill('"><span class="bid-value">${price}</span></div><dl><dt>Mileage</dt><dd>1 mile</dd></dl>'
             '<div class="quick-facts"><dl><dt>Mileage</dt><dd>{miles} miles</dd><dt>Transmission:</dt>'
             '<dd>{gear}</dd><dt>Engine</dt><dd>{engine}</dd><dt>Exterior Color</dt><dd>{paint}</dd>'
             '<dt>VIN</dt><dd>{vin}</dd><dt>Location</dt><dd>{city}</dd></dl></div>'
             '<ul class="stats"><li><span>Bids</span><span>{bids}</span></li><li>Watchers 31</li></ul>'
             '<div class="detail-section detail-highlights"><div class="detail-body"><p>A car.</p>'
             '<p>{phrase}</p></div></div>'),
        F.when(F.col("state") == "O", "").otherwise(fill("<p>Ended {long_day}</p>")),
        F.lit("</body></html>"),
    )
    status = F.when(sold, "Completed").when(over, "Ended").otherwise("Active")
    ebay = F.concat(
        fill('<<"Item": <<"Title": "{y} Porsche 911 {trim}", "SellingStatus": <<"ConvertedCurrentPrice":'
             ' <<"Value": "{price}", "CurrencyID": "EUR">>, "ListingStatus": "'), status,
        fill('">>, "EndTime": "{iso_day}T01:02:03Z", "StartTime": "{iso_day}T00:00:00Z", "Description": '
             '"<p>A car.</p> {phrase}", "Seller": <<"UserID": "{city}">>, "ItemSpecifics": <<"NameValueList": ['
             '<<"Name": "Mileage", "Value": ["{miles} mi", "x"]>>, <<"Name": "transmission", "Value": "{gear}">>, '
             '<<"Name": "Exterior Color", "Value": "{paint}">>, <<"Name": "VIN", "Value": "{vin}">>, '
             '<<"Name": "Engine", "Value": "{engine}">>, <<"Name": "Trim", "Value": "{trim}">>, '
             '<<"Name": "Body Type", "Value": "{body}">>]>>>>>>'),
    )
    ebay = F.replace(F.replace(ebay, F.lit("<<"), F.lit("{")), F.lit(">>"), F.lit("}"))
    pcar_end = (
        F.when(sold, fill('<div class="auction-result">Hammer ${price}.00</div>'))
        .when(over, fill('<span class="badge">Not sold</span><p>High bid ${price}.00</p>'))
        .otherwise(fill('<span class="bid-amount">${price}.00</span>'))
    )
    pcar = F.concat(
        fill('<html><body><h1>  </h1><h1 class="listing-title">{y} Porsche 911 {trim} {body}</h1>'), pcar_end,
        fill('<span class="bid-count">{bids}bids</span><time datetime="{iso_day}T18:30:00Z"></time>'
             '<table><tr><th>Mileage:</th><td>{miles}</td></tr><tr><td>Gearbox</td><td>{gear}</td></tr></table>'
             '<ul><li>Engine: {engine}</li><li>Color: {paint}</li><li>VIN: {vin}</li><li>Trim: {trim}</li>'
             '<li>Body style: {body}</li></ul><span class="seller-name">{city}</span>'
             '<div id="description">A car. {phrase}</div></body></html>'),
    )
    content = (
        F.when(F.col("source") == "bat", bat).when(F.col("source") == "carsandbids", cnb)
        .when(F.col("source") == "ebay", ebay).otherwise(pcar)
    )
    turn = F.col("k") % 53
    return rows.select(
        F.col("k").alias("page_id"),
        "source",
        F.concat(F.lit("https://"), "source", F.lit(".example/listing/"), "k").alias("url"),
        F.col("iso_day").cast("timestamp").alias("fetched_at"),
        F.when(turn == 3, "").otherwise(content).alias("content"),
        F.when(F.col("source") == "ebay", "json").otherwise("html").alias("content_type"),
        F.when(turn == 0, 404).when(turn == 1, 500).when(turn == 2, 301).otherwise(200).alias("status_code"),
    )
