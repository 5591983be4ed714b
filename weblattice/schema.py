"""Schemas of the crawl's tables and their domains."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values, in order.
SITE_STATUS = ("unknown", "up", "flaky", "down", "dead", "auth_gated")
ENTITY_KINDS = ("btc", "xmr", "eth", "email", "pgp", "onion")

#: DDL by table; ids are allocated by snapshots.allocate.
TABLES: dict[str, str] = {
    "sites": "id long, onion string, discovered_via string, first_seen timestamp_ntz, last_seen timestamp_ntz, last_ok timestamp_ntz, status string, consecutive_failures int, next_check_at timestamp_ntz, next_allowed_at timestamp_ntz, lease_until timestamp_ntz, title string, server string, pages_fetched int",
    "frontier": "url_hash binary, url string, site_id long, depth int, priority int, next_fetch_at timestamp_ntz, attempts int",
    "blobs": "hash binary, html binary",
    "pages": "id long, site_id long, url string, url_hash binary, depth int, first_fetched timestamp_ntz, last_fetched timestamp_ntz, last_status int, current_version_id long, indexed_version_id long",
    "page_versions": "id long, page_id long, fetched_at timestamp_ntz, http_status int, content_type string, text_hash binary, simhash long, title string, text string, html_hash binary",
    "links": "src_page_id long, dst_site_id long, dst_url string, anchor_text string, is_onion boolean",
    "entities": "page_version_id long, site_id long, kind string, value string",
    "fetch_log": "ts timestamp_ntz, site_id long, url_hash binary, outcome string, http_status int, latency_ms int, bytes int, proxy string",
    "blocklist": "md5 string, source string",
    "site_analysis": "site_id long, pagerank double, component int, operator int, updated_at timestamp_ntz",
}


def faults(name: str) -> Column:
    """The names of a table's checks that a row fails, as an array."""
    checks = {
        "sites": [("onion", F.col("onion").rlike("^[a-z2-7]{56}$")), ("status", F.col("status").isin(*SITE_STATUS))],
        "blocklist": [("md5", F.col("md5").rlike("^[0-9a-f]{32}$"))],
        "entities": [("kind", F.lower("kind").isin(*ENTITY_KINDS))],
    }.get(name, [])
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(what)) for what, ok in checks]), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
