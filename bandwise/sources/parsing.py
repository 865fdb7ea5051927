"""Raw pages to parsed records: one pass over all sources, all expressions but the DOM step."""

from __future__ import annotations

import hashlib
import inspect
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.functions import extract as X
from bandwise.functions.dom import Pick, fragments, fragments_by_source
from bandwise.functions.normalize import FLAGS, stripped

# --- fixed values: where each site keeps its fields -------------------------------------
BAT = {
    "slots": {
        "title": Pick(("h1.post-title.listing-post-title", "h1.post-title", "h1.listing-post-title", "h1"),
                      text="tight"),
        "description": Pick(("div.post-description", "div.more-info", "div.listing-description",
                             "div.post-excerpt")),
        "items": Pick(("div.item ul li", "ul.listing-essentials li"), take="all_first"),
        "prices": Pick(("span.info-value.noborder-tiny", ".current-bid-amount", ".bid-price"),
                       take="all", text="raw"),
        "stats": Pick(("span.info-value.noborder-tiny",), take="all", text="raw"),
        "result": Pick((".listing-available-cta", ".auction-ended", ".bid-result", ".listing-result")),
        "ended": Pick((".auction-ended", ".listing-result", ".bid-result")),
        "links": Pick(("a",), take="all", text="@href"),
        "link_texts": Pick(("a",), take="all", text="tight"),
        "times": Pick(("time",), text="@datetime"),
    },
    "attributes": {
        "published": (("article:published_time", "og:article:published_time"), "meta", "property", "content"),
        "summary": (("og:description",), "meta", "property", "content"),
    },
}
CARSANDBIDS = {
    "slots": {
        "title": Pick((".auction-title h1", "h1.auction-title", "h1.listing-title", "h1"), text="tight"),
        "highlights": Pick((".detail-section.detail-highlights .detail-body",)),
        "highlight_lines": Pick((".detail-section.detail-highlights .detail-body p",), take="all", text="tight"),
        "description": Pick((".listing-description", ".auction-description", ".detail-body", ".description")),
        "asks": Pick((".current-bid.!ended .bid-value",), text="raw"),
        "finals": Pick((".current-bid.ended .bid-value",), text="raw"),
        "ended": Pick((".current-bid.ended",)),
        "stats": Pick(("ul.stats li",), take="all"),
        "times": Pick(("time",), text="@datetime"),
    },
    "pairs_in": (".quick-facts",),
    "attributes": {"published": (("article:published_time",), "meta", "property", "content")},
}
PCARMARKET = {
    "slots": {
        "title": Pick(("h1.listing-title", "h1.auction-title", "h1.vehicle-title", "h1"), take="any", text="tight"),
        "result": Pick((".auction-result", ".sold-price", ".final-price", ".hammer-price"), text="raw"),
        "badge": Pick((".auction-status", ".listing-status", ".badge"), take="each", text="tight"),
        "after_badge": Pick((".auction-status", ".listing-status", ".badge"), take="each", text="price"),
        "asks": Pick((".current-bid", ".bid-amount", ".reserve-price", ".buy-now-price"), text="raw"),
        "bids": Pick((".bid-count", ".bids", ".num-bids"), take="each", text="raw"),
        "description": Pick((".auction-description", ".listing-description", ".vehicle-description",
                             "#description", ".description")),
        "seller": Pick((".seller-name", ".auction-seller", ".consignor"), text="tight"),
        "times": Pick(("time",), text="@datetime"),
        "end_dates": Pick((".auction-end-date", ".end-date", ".sale-date"), take="each", text="tight"),
    },
    "rows_and_items": True,
}

PARSED_COLUMNS = (
    "source", "source_url", "scrape_ts", "title_raw", "year", "trim", "engine_variant",
    "body_style_raw", "transmission_raw", "drivetrain_raw", "exterior_color_raw",
    "interior_color_raw", "mileage", "vin", "asking_price", "currency", "final_price",
    "listing_date", "sale_date", "seller_type_raw", "seller_name", "location", "bidder_count",
    "is_completed", "description_raw", "price_type",
)
REDIRECTS = (200, 301, 302)


class Scope:
    """Names of the helper columns of one source."""

    def __init__(self, source: str):
        self.source = source

    def name(self, column: str) -> str:
        return f"_{self.source}_{column}"

    def __call__(self, column: str) -> Column:
        return F.col(self.name(column))


@dataclass(frozen=True)
class Extraction:
    """How a page of a source becomes a record: helper columns, stage by stage, each of which may use those before it;
    whether the page has a record, by the first stage; and the columns of the record."""

    stages: list[dict[str, Column]]
    keep: Column
    record: dict[str, Column]


@dataclass(frozen=True)
class Source:
    """A site: its extraction, the slots of its markup (None: no markup is read), the statuses worth reading (None: any)."""

    extraction: Callable[[Scope], Extraction]
    spec: dict | None = None
    statuses: tuple[int, ...] | None = REDIRECTS


def readable(pages: DataFrame, statuses=REDIRECTS) -> DataFrame:
    """Pages worth parsing."""
    return pages.where((F.length("content") > 0) & F.col("status_code").isin(*statuses))


TYPES = {"year": "int", "mileage": "int", "bidder_count": "int", "asking_price": "double", "final_price": "double",
         "sale_date": "date", "is_completed": "boolean", "scrape_ts": "timestamp"}


def _first_ten(*texts: Column) -> Column:
    return F.left(F.coalesce(*texts), F.lit(10))


def bat_head(c: Scope) -> dict[str, Column]:
    title = X.slot_first("f", "title")
    return {"title": title, "year": X.year(title, X.YEAR_FROM_1960)}


def _titled(c: Scope) -> Column:
    return (c("title") != "") & c("year").isNotNull()


def bat_pages(pages: DataFrame) -> DataFrame:
    """Readable pages of the first source with their fragments f, a title and a year."""
    rows = readable(pages).withColumn("f", fragments(F.col("content"), BAT))
    head = bat_head(Scope("bat"))
    return rows.withColumns(head).where((F.col("title") != "") & F.col("year").isNotNull())


def bat(c: Scope) -> Extraction:
    """Labelled or bare list items, result strip, price spans."""

    def entry(item):
        return F.struct(
            stripped(F.lower(F.substring_index(item, ":", 1))).alias("k"),
            stripped(F.regexp_replace(item, "^[^:]*:", "")).alias("v"),
        )

    items = F.filter(X.slot("f", "items"), lambda t: t != "")
    labelled = F.filter(
        F.transform(F.filter(items, lambda t: t.contains(":")), entry),
        lambda e: (e["k"] != "") & (e["v"] != ""),
    )

    def is_bare(t):
        e = entry(t)
        return ~t.contains(":") | (e["k"] == "") | (e["v"] == "")

    def has_gear(t):
        lowered = F.lower(t)
        hit = F.lit(False)
        for word in X.GEARBOX_WORDS:
            hit = hit | lowered.contains(word)
        return hit

    def is_miles(t):
        return t.rlike(FLAGS + X.MILES)

    bare = c.name("bare")
    bare_miles = F.get(F.filter(bare, is_miles), F.lit(0))
    bare_gear = F.get(F.filter(bare, lambda t: ~is_miles(t) & has_gear(t)), F.lit(0))
    bare_engine = F.get(
        F.filter(bare, lambda t: ~is_miles(t) & ~has_gear(t) & t.rlike(FLAGS + X.ENGINE)), F.lit(0)
    )

    def spec(name):
        return X.spec_last(c.name("specs"), name)

    result = F.coalesce(F.nullif(X.slot_first("f", "result"), F.lit("")), c("page_text"))
    strip_price = X.first_amount(X.slot("f", "stats"))
    searched = F.transform(
        F.filter(X.slot("f", "links"), lambda h: h.contains("/search?q=")),
        lambda h: F.upper(F.substring_index(F.substring_index(h, "/search?q=", -1), "&", 1)),
    )
    linked_vin = X.found(
        F.get(F.filter(searched, lambda t: t.rlike("^" + X.VIN)), F.lit(0)), "^" + X.VIN
    )
    map_texts = F.filter(
        F.zip_with(X.slot("f", "links"), X.slot("f", "link_texts"),
                   lambda h, t: F.when(h.contains("maps/place") | h.contains("maps.google"), t)),
        lambda t: t.isNotNull() & (t != ""),
    )
    stages = [
        bat_head(c),
        {"specs": labelled, "bare": F.filter(items, is_bare)},
        {"miles_text": F.coalesce(spec("mileage"), bare_miles),
         "gear_text": F.coalesce(spec("transmission"), bare_gear),
         "engine_text": F.coalesce(spec("engine"), bare_engine),
         "description": X.slot_first("f", "description"), "page_text": X.slot_first("f", "page_text")},
        {"combined": F.concat_ws(
            " ", c("title"), c("description"), F.array_join(F.transform(c("specs"), lambda e: e["v"]), " "),
            c("miles_text"), c("gear_text"), c("engine_text"))},
    ]
    return Extraction(stages, _titled(c), dict(
        title_raw=c("title"), year=c("year"), trim=X.trim(c("title")),
        engine_variant=F.coalesce(X.engine(c("engine_text")), X.engine(spec("engine size")),
                                  X.engine(spec("displacement")), X.engine(c("combined"))),
        body_style_raw=X.body_word(c("combined")),
        transmission_raw=F.coalesce(X.gearbox_class(c("gear_text")), X.gearbox_class(spec("gearbox")),
                                    X.gearbox_class(c("combined"))),
        drivetrain_raw=X.four_wheel(c("combined")),
        exterior_color_raw=X.exterior(F.coalesce(spec("exterior color"), spec("exterior"),
                                                 spec("color"), spec("paint"))),
        mileage=F.coalesce(X.miles(c("miles_text")), X.miles(spec("miles")), X.miles(spec("odometer"))),
        vin=F.coalesce(*[X.vin(spec(n)) for n in ("chassis", "vin", "serial", "chassis number")], linked_vin),
        asking_price=F.coalesce(X.first_amount(X.slot("f", "prices")), X.first_amount(X.slot("f", "summary"))),
        final_price=F.coalesce(X.amount(result, X.SOLD_FOR), strip_price),
        sale_date=X.long_date(result),
        listing_date=_first_ten(X.slot_first("f", "published"), X.slot_first("f", "times")),
        seller_type_raw=F.lit("auction_house"),
        location=F.coalesce(spec("location"), spec("seller location"), spec("located in"),
                            F.get(map_texts, F.lit(0))),
        bidder_count=F.coalesce(X.bids(F.array_join(X.slot("f", "stats"), "\n")), X.bids(c("page_text"))),
        is_completed=X.closed(c("page_text")) | (F.size(X.slot("f", "ended")) > 0),
        description_raw=c("description"),
    ))


def carsandbids(c: Scope) -> Extraction:
    """Definition lists, bid boxes, labelled statistics."""
    title = X.slot_first("f", "title")
    lines = F.filter(X.slot("f", "highlight_lines"), lambda t: t != "")

    def spec(name):
        return X.spec_last(c.name("specs"), name)

    bid_stat = F.get(F.filter(X.slot("f", "stats"), lambda t: F.lower(t).contains("bids") & t.rlike(r"\d")), F.lit(0))
    text = c("page_text")
    stages = [
        {"title": title, "year": X.year(title, X.YEAR_FROM_1960)},
        {"specs": X.spec_entries("f"),
         "description": F.when(F.size(X.slot("f", "highlights")) > 0, F.array_join(lines, " "))
         .otherwise(X.slot_first("f", "description")),
         "page_text": X.slot_first("f", "page_text")},
        {"combined": F.concat_ws(
            " ", c("title"), c("description"), F.array_join(F.transform(c("specs"), lambda e: e["v"]), " "))},
    ]
    return Extraction(stages, _titled(c), dict(
        title_raw=c("title"), year=c("year"), trim=X.trim(c("title")),
        engine_variant=F.coalesce(*[X.engine(spec(n)) for n in ("engine", "engine size", "displacement")],
                                  X.engine(c("combined"))),
        body_style_raw=X.body_word(c("combined")),
        transmission_raw=F.coalesce(X.gearbox_class(spec("transmission")), X.gearbox_class(spec("gearbox")),
                                    X.gearbox_class(c("combined"))),
        drivetrain_raw=X.four_wheel(c("combined")),
        exterior_color_raw=F.coalesce(*[spec(n) for n in ("exterior color", "exterior", "color", "paint")]),
        mileage=F.coalesce(*[X.miles(spec(n)) for n in ("mileage", "miles", "odometer")]),
        vin=F.coalesce(*[X.vin(spec(n)) for n in ("vin", "chassis", "serial")], X.vin(c("combined"))),
        asking_price=X.first_amount(X.slot("f", "asks")),
        final_price=F.coalesce(X.first_amount(X.slot("f", "finals")), X.amount(text, X.SOLD_FOR)),
        sale_date=X.long_date(text),
        listing_date=_first_ten(X.slot_first("f", "published"), X.slot_first("f", "times")),
        seller_type_raw=F.lit("auction_house"),
        location=F.coalesce(spec("location"), spec("seller location")),
        bidder_count=F.coalesce(X.found(bid_stat, r"(\d+)").try_cast("int"), X.bids(text)),
        is_completed=(F.size(X.slot("f", "ended")) > 0) | X.closed(text),
        description_raw=c("description"),
    ))


def ebay(c: Scope) -> Extraction:
    """A JSON item, parsed once to a variant; no markup."""

    def at(path):
        return F.try_variant_get(c("item"), f"$.{path}", "string")

    def spec(name):
        value = F.get(F.filter(c("specs"), lambda e: F.lower(e["Name"]) == name.lower()), F.lit(0))["Value"]
        return F.coalesce(F.try_variant_get(value, "$[0]", "string"), F.try_variant_get(value, "$", "string"))

    def number(text):
        return F.regexp_replace(text, r"[^\d.]", "")

    price = F.coalesce(*[
        number(at(p)).try_cast("double")
        for p in ("SellingStatus.ConvertedCurrentPrice.Value", "SellingStatus.CurrentPrice.Value",
                  "CurrentPrice.Value")
    ])
    status = F.lower(F.coalesce(F.nullif(at("SellingStatus.ListingStatus"), F.lit("")),
                                at("ListingStatus"), F.lit("")))
    miles_word = F.split(stripped(spec("Mileage")), r"\s+")[0]
    spec_vin = F.upper(spec("VIN"))
    listed, one = "$.ItemSpecifics.NameValueList", "struct<Name:string,Value:variant>"
    page, item = c("page"), c("item")
    stages = [
        # the row number, never negative, keeps the optimizer from copying the parse into filters below
        {"page": F.when(F.monotonically_increasing_id() >= 0, F.try_parse_json(F.col("content")))},
        {"item": F.coalesce(F.try_variant_get(page, "$.Item", "variant"), F.try_variant_get(page, "$.item", "variant"))},
        {"specs": F.coalesce(F.try_variant_get(item, listed, f"array<{one}>"),
                             F.array_compact(F.array(F.try_variant_get(item, listed, one))))},
        {"price": price, "status": status},
    ]
    ended = c("status").isin("ended", "completed", "sold")

    def is_object(key):  # one with entries
        return F.size(F.try_variant_get(page, key, "map<string,variant>")) > 0

    first = F.try_variant_get(page, "$.Item", "variant")
    return Extraction(stages, F.when(first.isNull() | F.is_variant_null(first), is_object("$.item")).otherwise(is_object("$.Item")), dict(
        title_raw=at("Title"),
        year=F.coalesce(spec("Year").try_cast("int"), X.year(at("Title"), X.YEAR_FROM_1965)),
        trim=spec("Trim"), engine_variant=spec("Engine"), body_style_raw=spec("Body Type"),
        transmission_raw=spec("Transmission"), drivetrain_raw=spec("Drive Type"),
        exterior_color_raw=spec("Exterior Color"), interior_color_raw=spec("Interior Color"),
        mileage=F.coalesce(number(miles_word).try_cast("int"), X.miles(at("Description"))),
        vin=F.coalesce(F.nullif(at("VIN"), F.lit("")), F.when(spec_vin.rlike("^" + X.VIN), spec_vin)),
        asking_price=c("price"),
        final_price=F.when(ended, c("price")),
        currency=F.coalesce(at("SellingStatus.ConvertedCurrentPrice.CurrencyID"), F.lit("USD")),
        listing_date=_first_ten(at("StartTime"), at("ListingDetails.StartTime")),
        sale_date=F.when(ended, F.try_to_date(F.left(at("EndTime"), F.lit(10)))),
        seller_type_raw=F.lit("private"), seller_name=at("Seller.UserID"),
        is_completed=ended,
        description_raw=X.strip_html(at("Description")),
    ))


def pcarmarket(c: Scope) -> Extraction:
    """Labels anywhere on the page: definition lists, table rows, list items."""
    sold_badge = F.array_position(
        F.transform(X.slot("f", "badge"), lambda t: F.lower(t).contains("sold")), True
    )
    end_texts = F.filter(
        F.transform(X.slot("f", "end_dates"), X.page_date), lambda d: d.isNotNull()
    )
    after = F.try_element_at(X.slot("f", "after_badge"), F.greatest(c("sold_badge"), F.lit(1)).cast("int"))
    badge_price = F.when(c("sold_badge") > 0, X.amount(after, X.DOLLARS_CENTS))

    def spec(*names):
        return X.spec_first(c.name("specs"), *names)

    miles_text = spec("mileage", "miles", "odometer")
    bare_miles = F.regexp_replace(F.split(stripped(miles_text), r"\s+")[0], r"[^\d]", "").try_cast("int")
    bid_text = F.filter(X.slot("f", "bids"), lambda t: t.rlike(FLAGS + X.BIDS_CLOSE))
    completed = c("completed")
    stages = [
        {"title": X.slot_first("f", "title")},
        {"specs": X.spec_entries("f"), "result": X.slot_first("f", "result"), "sold_badge": sold_badge,
         "end_date": F.coalesce(F.left(X.slot_first("f", "times"), F.lit(10)),
                                F.get(end_texts, F.lit(0)).cast("string"))},
        {"completed": (F.size(X.slot("f", "result")) > 0) | (c("sold_badge") > 0)},
    ]
    return Extraction(stages, c("title") != "", dict(
        title_raw=c("title"),
        year=F.coalesce(X.year(c("title"), X.YEAR_FROM_1965), X.year(spec("year"), X.YEAR_FROM_1965)),
        trim=spec("trim", "model"),
        engine_variant=spec("engine", "displacement"),
        body_style_raw=spec("body", "body style", "body type"),
        transmission_raw=spec("transmission", "gearbox"),
        drivetrain_raw=spec("drivetrain", "drive"),
        exterior_color_raw=spec("exterior color", "color", "exterior"),
        interior_color_raw=spec("interior color", "interior"),
        mileage=F.coalesce(X.miles(miles_text), bare_miles),
        vin=F.coalesce(X.vin(F.upper(spec("vin", "vin number"))), X.vin(X.slot_first("f", "page_text"))),
        asking_price=F.when(~completed, X.first_amount(X.slot("f", "asks"), X.DOLLARS_CENTS)),
        final_price=F.when(
            completed,
            F.when(F.size(X.slot("f", "result")) > 0, X.amount(c("result"), X.DOLLARS_CENTS)).otherwise(badge_price),
        ),
        listing_date=c("end_date"),
        sale_date=F.when(completed, F.try_to_date(c("end_date"))),
        seller_type_raw=F.lit("auction_house"), seller_name=X.slot_first("f", "seller"),
        bidder_count=X.bids(F.get(bid_text, F.lit(0)), X.BIDS_CLOSE),
        is_completed=completed,
        description_raw=X.slot_first("f", "description"),
    ))


#: The known sites. A job may pass more of them, or fewer.
SOURCES: dict[str, Source] = {
    "bat": Source(bat, BAT),
    "carsandbids": Source(carsandbids, CARSANDBIDS),
    "ebay": Source(ebay, statuses=None),
    "pcarmarket": Source(pcarmarket, PCARMARKET, (200,)),
}


#: A slot of a page in the text of an expression; any other mention of the slots may be any of them.
_SLOT = re.compile(r"""\bf\b(?:\['(\w+)'\])?""")


def slots_read(made: Extraction, scope: Scope, columns: Iterable[str]) -> frozenset[str] | None:
    """The slots that some columns of the record, and whether there is one, are read from; None: any of them."""
    helpers = {scope.name(name): value for stage in made.stages for name, value in stage.items()}
    due, slots, seen = [made.keep, *(made.record[c] for c in columns if c in made.record)], set(), set()
    while due:
        text = str(due.pop())
        slots.update(found[1] for found in _SLOT.finditer(text))
        for name in set(re.findall(r"\w+", text)) & helpers.keys() - seen:
            seen.add(name)
            due.append(helpers[name])
    return None if None in slots else frozenset(slots)


def _extracted(
    pages: DataFrame, sources: Mapping[str, Source], filled: Column, columns: Iterable[str] = PARSED_COLUMNS
) -> DataFrame:
    """Every page in the parsed shape with `status_code` and `found`, whether it has a record; `filled` says whether
    there is something to read. Of the record only `columns` are made, and only the slots that they are read from.

    One scan and one Python stage for all sources: the stage takes the slots of each row's own source, and every later
    expression runs for the rows of its source only.
    """
    at = F.col("source")

    def own(name: str, value: Column) -> Column:
        return F.when(at == name, value)

    read = F.lit(False)
    for name, source in sources.items():
        good = F.lit(True) if source.statuses is None else F.col("status_code").isin(*source.statuses)
        read = read | ((at == name) & good)
    rows = pages.withColumn("_read", F.coalesce(read & filled, F.lit(False)))
    made = {name: source.extraction(Scope(name)) for name, source in sources.items()}
    specs = {name: source.spec | {"wanted": slots_read(made[name], Scope(name), columns)}
             for name, source in sources.items() if source.spec is not None}
    if specs:
        rows = rows.withColumn("f", fragments_by_source(at, F.when(F.col("_read") & at.isin(*specs), F.col("content")), specs))
    keep = F.lit(False)
    for depth in range(max(len(m.stages) for m in made.values())):
        rows = rows.withColumns({
            Scope(name).name(column): own(name, value)
            for name, m in made.items() if depth < len(m.stages) for column, value in m.stages[depth].items()
        })
        if not depth:
            for name, m in made.items():
                keep = keep | ((at == name) & m.keep)
            rows = rows.withColumn("found", F.col("_read") & F.coalesce(keep, F.lit(False)))
    shared = {"source": at, "source_url": F.col("url"), "scrape_ts": F.col("fetched_at")}
    usual = {"currency": "USD", "price_type": "auction_final"}
    values = []
    for column in columns:
        if column in shared:
            value = shared[column]
        else:
            value, plain = None, F.lit(usual.get(column))
            for name, m in made.items():
                given = m.record.get(column, plain).cast(TYPES.get(column, "string"))
                value = F.when(at == name, given) if value is None else value.when(at == name, given)
        values.append(value.cast(TYPES.get(column, "string")).alias(column))
    return rows.select(*values, "status_code", "found")


def parse_pages(
    pages: DataFrame, sources: Mapping[str, Source] = SOURCES, columns: Iterable[str] = PARSED_COLUMNS
) -> DataFrame:
    """Parsed records of all given sources, by default the known ones; all columns, or those wanted in their order."""
    known = pages.where(F.col("source").isin(*sources))
    # not a filter: it would move below the step that spreads the pages, and pages made there would be made twice
    return _extracted(known, sources, F.length("content") > 0, tuple(columns)).where("found").drop("status_code", "found")


def fingerprint(source: Source) -> str:
    """Changes whenever the slots, the statuses or the code of a source's extraction change."""
    rules = (repr(source.spec), source.statuses, inspect.getsource(source.extraction))
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def extracted_pages(pages: DataFrame, sources: Mapping[str, Source] = SOURCES) -> DataFrame:
    """Every page of the sources in the parsed shape, with `found`, `status_code` and the fingerprint of the rules it was
    read by: what a replay starts from."""
    known = pages.where(F.col("source").isin(*sources))
    marks = F.create_map(*[F.lit(x) for name, source in sources.items() for x in (name, fingerprint(source))])
    return _extracted(known, sources, F.length("content") > 0).withColumn("rules", marks[F.col("source")])


def replay_due(stored: DataFrame, latest: DataFrame, sources: Mapping[str, Source] = SOURCES) -> DataFrame:
    """The pages of `latest` (one snapshot per page) that `stored` does not hold by the present rules and from this
    snapshot or a newer one."""
    marks = F.create_map(*[F.lit(x) for name, source in sources.items() for x in (name, fingerprint(source))])
    done = stored.where(F.col("rules") == marks[F.col("source")]).select(
        "source", F.col("source_url").alias("url"), F.col("scrape_ts").alias("_done"))
    return latest.join(done, ["source", "url"], "left").where(
        F.col("source").isin(*sources) & (F.col("_done").isNull() | (F.col("_done") < F.col("fetched_at")))).drop("_done")


def replayed(stored: DataFrame, latest: DataFrame, sources: Mapping[str, Source] = SOURCES) -> DataFrame:
    """The stored pages after a replay of the newest snapshots, with `again`: whether a row was extracted anew. Only the
    pages that are due are read; rows of other pages stay as they are."""
    due = replay_due(stored, latest, sources)
    gone = due.select("source", F.col("url").alias("source_url"))
    kept = stored.drop("again").join(gone, ["source", "source_url"], "left_anti").select(stored.drop("again").columns)
    return kept.withColumn("again", F.lit(False)).unionByName(extracted_pages(due, sources).withColumn("again", F.lit(True)))


#: The columns that a route depends on.
ROUTED_BY = ("is_completed", "sale_date", "final_price")


def _is_comp(mode: str) -> Column:
    if mode == "scheduled":
        comp = F.col("is_completed") & F.col("sale_date").isNotNull()
    elif mode == "comp_first":
        priced = F.col("source").isin("bat", "carsandbids") & F.col("final_price").isNotNull()
        comp = F.col("is_completed") | priced
    else:
        raise ValueError(f"unknown routing mode {mode!r}")
    return F.coalesce(comp, F.lit(False))


def routed(parsed: DataFrame, mode: str = "scheduled") -> DataFrame:
    """Where each record goes. scheduled: completed records with a sale date are comps, all else
    listings. comp_first: whatever closed or bears a final price is a comp."""
    return parsed.withColumn("route", F.when(_is_comp(mode), "comp").otherwise("listing"))


def page_outcomes(pages: DataFrame, sources: Mapping[str, Source] = SOURCES, mode: str = "scheduled") -> DataFrame:
    """What became of every page (source, url, outcome): a 404 marks its listing removed, other failures are errors, the
    rest is a comp or a listing. Read off the extraction itself, page by page."""
    status = F.col("status_code")
    return _extracted(pages, sources, F.length("content") > 0, ("source", "source_url", *ROUTED_BY)).select(
        "source", F.col("source_url").alias("url"),
        F.when(status == 404, "removed")
        .when(status != 200, "fetch_error")
        .when(~F.col("found"), "extraction_error")
        .when(_is_comp(mode), "comp").otherwise("listing").alias("outcome"),
    )
