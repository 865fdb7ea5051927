"""Every registered query, family by family."""

from bandwise.plans import (  # noqa: F401
    alert_queries,
    band_queries,
    extract_queries,
    merge_queries,
    normalize_queries,
    search_queries,
    source_queries,
)
from bandwise.plans.registry import ORACLES, QUERIES  # noqa: F401
