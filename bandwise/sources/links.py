"""Discovery of item links in stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HREF = r"(?i)<a\s[^>]*?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"


def site_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def clean_link(href: Column, site: Column) -> Column:
    """Absolute link without query, fragment and trailing slash."""
    full = F.when(href.startswith("/"), F.concat(site, href)).otherwise(href)
    return F.rtrim(F.regexp_replace(full, r"[?#].*$", ""), F.lit("/"))


def page_links(pages: DataFrame, item_pattern: str, html: str = "html") -> DataFrame:
    """Distinct item links per site; duplicates fall away in the map-side aggregate."""
    site = site_of(F.col("url"))
    found = pages.select(site.alias("site"), F.explode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("quoted"))
    bare = F.regexp_replace("quoted", "^[\"']|[\"']$", "")
    found = found.select("site", F.replace(bare, F.lit("&amp;"), F.lit("&")).alias("href"))
    return (
        found.select("site", clean_link(F.col("href"), F.col("site")).alias("link"))
        .where(F.col("link").rlike(item_pattern))
        .distinct()
    )


def search_result_links(results: DataFrame, prefix: str, body: str = "body") -> DataFrame:
    """Item links from JSON search responses: any operation's response, all of its items."""
    item = "array<struct<item:array<struct<itemId:array<string>>>>>"
    parsed = F.from_json(body, f"map<string,array<struct<searchResult:{item}>>>")
    items = F.flatten(F.flatten(F.transform(
        F.flatten(F.map_values(parsed)),
        lambda r: F.transform(r["searchResult"], lambda s: s["item"]),
    )))
    return (
        results.select(F.explode(F.transform(items, lambda i: F.get(i["itemId"], F.lit(0)))).alias("item_id"))
        .where(F.col("item_id").isNotNull())
        .select(F.concat(F.lit(prefix), F.col("item_id")).alias("link"))
    )


def union_links(*sections: DataFrame, limit: int | None = None) -> DataFrame:
    """Set union of the sections' links; a limit takes the first in order."""
    out = sections[0]
    for section in sections[1:]:
        out = out.unionByName(section)
    out = out.distinct()
    return out if limit is None else out.orderBy("link").limit(limit)
