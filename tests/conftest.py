from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")

from weblattice.session import session  # noqa: E402

#: Schemas of the tables as the driver makes them.
SCHEMAS = {
    "sites": "id long, onion string, discovered_via string, first_seen timestamp_ntz, last_seen timestamp_ntz, last_ok timestamp_ntz, status string, consecutive_failures int, title string, server string, pages_fetched int",
    "pages": "id long, site_id long, url string, url_hash binary, depth int, first_fetched timestamp_ntz, last_fetched timestamp_ntz, last_status int, current_version_id long",
    "page_versions": "id long, page_id long, fetched_at timestamp_ntz, http_status int, content_type string, text_hash binary, simhash long, title string, text string",
    "links": "src_page_id long, dst_site_id long, dst_url string, anchor_text string, is_onion boolean",
    "entities": "page_version_id long, site_id long, kind string, value string",
    "fetch_log": "ts timestamp_ntz, site_id long, url_hash binary, outcome string, http_status int, latency_ms int, bytes int, proxy string, received_at timestamp_ntz",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, title string, fetched_at timestamp_ntz",
    "eval_items": "item_id long, suite string, lang string, text string",
    "lang_samples": "sample_id long, lang string, text string",
    "mix_targets": "source string, target_share double, max_repeats int",
}


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def folder(spark, tmp_path):
    """Writes the tables given, each a list of dicts of the columns that matter; the others are null, tables not given are empty."""

    def make(extra: str = "", **tables) -> str:
        for name, ddl in SCHEMAS.items():
            cols = [c.split()[0] for c in ddl.split(", ")]
            rows = [tuple(r.get(c) for c in cols) for r in tables.get(name, [])]
            df = spark.createDataFrame(rows, ddl)
            for c in extra.split():
                if c not in df.columns:
                    df = df.selectExpr("*", f"'clash' AS {c}")
            df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test data here")
    return str(DATA)
