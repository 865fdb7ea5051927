"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import time

from bandwise.plans import catalog
from bandwise.session import local_session

HEADLINE = (
    "flagship_underpriced_asks",
    "a2_widened_bands",
    "a12_rollup_bands",
    "e3_delta_read_view",
    "f7_extended_search",
    "t7_cheapest_in_cluster",
    "r8_deduplicated_alerts",
    "u1_listing_upsert",
    "u8_price_history",
    "j8_vin_duplicates",
    "j9_similar_duplicates",
    "j12_currency_asof",
    "n6_color_fuzzy",
    "n12_normalized_records",
    "x21_scheduled_route",
    "st2_streaming_price_drops",
)


def seconds(fn, spark, folder) -> float:
    started = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bandwise-bench")
    queries = catalog.QUERIES
    seconds(queries["a5_search_total"], spark, folder)  # start-up is not a query's time
    timings = {}
    for name in HEADLINE:
        timings[name] = round(min(seconds(queries[name], spark, folder) for _ in range(2)), 3)
    print(json.dumps({
        "metric": "headline queries, total of best of two runs",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": pathlib.Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
