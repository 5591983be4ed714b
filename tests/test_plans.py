from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from weblattice.plans import explore, registry, relational
from weblattice.plans.crawl import Crawl

#: Iterative or streamed queries are compared by the tests of their operators.
SLOW = {"q_sites", "q_sites_filtered", "q_sites_component", "q_sites_operator", "q_site", "q_graph_nodes", "q_analytics_graph", "q_analytics_top_rank", "q_analytics_components", "q_analytics_operators", "g_pagerank", "g_analysis"}


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck(data):
    import glob
    import os

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_equals_sql(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(registry.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(cur.description)}
    assert sorted(at) == cols
    assert got == sorted((tuple(value(r[at[c]]) for c in cols) for r in cur.fetchall()), key=repr)


def test_flagship(spark, data):
    assert registry.flagship(spark, data).count() > 0


def test_unknown_rows_are_not_found(spark, data):
    with pytest.raises(explore.NotFound):
        explore.one(explore.page(Crawl(spark, data), -5))
    assert explore.clamp("x", 3, 9) == 3 and explore.clamp("-1", 3, 9) == 3 and explore.clamp("12", 3, 9) == 9


def test_the_rest_works_without_the_text_subpackage():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for f in (root / "weblattice").rglob("*.py"):
        if "llm" not in f.parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any(n.startswith("weblattice.llm") for n in names), f


def test_postings_left_and_report_of_routed_sites(spark, folder):
    sites = [{"id": i, "onion": f"o{i}"} for i in (1, 2, 3)]
    pages = [{"id": i, "site_id": i, "url": "u", "current_version_id": i} for i in (1, 2, 3)]
    d = folder(sites=sites, pages=pages, page_versions=[{"id": i, "page_id": i, "text": t} for i, t in ((1, "fox den"), (2, "fox Lantern"), (3, "owl"))], fetch_log=[{"ts": dt.datetime(2025, 1, 1), "site_id": 1, "outcome": "ok"}])
    left = relational.QUERIES["snk_delete_postings"](spark, d).select("page_id", "term").distinct()
    assert {(2, "fox"), (2, "lantern"), (3, "owl")} <= {tuple(r) for r in left.collect()} and left.where("page_id = 1").isEmpty()
    assert [r.address for r in relational.QUERIES["snk_report_routed"](spark, d).collect()] == ["o2.onion"]


def test_pages_of_a_list():
    assert explore.pager(0, 100, 100) == (None, 100) and explore.pager(50, 7, 100) == (0, None) and explore.pager(200, 0, 100) == (100, None)
    assert explore.pager(25, 25, 25, total=50) == (0, None) and explore.pager(0, 25, 25, total=26) == (None, 25)


def test_the_core_registers_without_the_packages_of_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules.update({m: None for m in %r}); import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(k.startswith('p1_') for k in q))"
    run = lambda where, blocked: subprocess.run([sys.executable, "-c", code % (blocked,)], cwd=where, capture_output=True, text=True, check=True).stdout.split()
    core = [str(len(registry.queries())), str(len(registry.oracle_sql())), "False"]
    assert run(root, ["ahocorasick"]) == core and run(root, ["tiktoken"]) == core
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    assert run(tmp_path / "r", []) == core


def test_a_cluster_needs_a_shared_folder():
    from weblattice import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(lambda: {})  # noqa: N815

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(session.NoSharedFolder):
        session.ensure_checkpoint_dir(Session)
