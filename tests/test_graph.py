from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weblattice.operators import graph


def edges(spark, rows):
    return spark.createDataFrame(rows, "src_site_id long, dst_site_id long, n_links long")


def ranks(n, rows, rounds=40, d=0.85):
    r = [1 / n] * n
    out = [sum(w for s, _, w in rows if s == i) for i in range(n)]
    for _ in range(rounds):
        lost = sum(x for x, o in zip(r, out) if not o)
        new = [(1 - d) / n + d * lost / n] * n
        for s, t, w in rows:
            new[t] += d * r[s] * w / out[s]
        r = new
    return r


@pytest.mark.parametrize("n,rows", [(3, [(0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 0, 1)]), (2, [(0, 1, 1)]), (4, [(0, 1, 3), (1, 0, 1), (1, 2, 2)]), (2, [])])
def test_pagerank_equals_plain_iteration(spark, n, rows):
    got = {r.id: r.pagerank for r in graph.pagerank(spark.range(n), edges(spark, rows)).collect()}
    want = ranks(n, rows)
    assert sum(got.values()) == pytest.approx(1.0)
    assert [got[i] for i in range(n)] == pytest.approx(want)


def test_pagerank_leaves_out_unknown_ends_and_self_links(spark):
    e = [(0, 1, 1), (0, 9, 5), (9, 0, 5), (1, 1, 7)]
    got = {r.id: r.pagerank for r in graph.pagerank(spark.range(2), edges(spark, e)).collect()}
    assert [got[0], got[1]] == pytest.approx(ranks(2, [(0, 1, 1)]))
    assert graph.pagerank(spark.range(0), edges(spark, [])).count() == 0


def test_components_and_labels(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (5, 6), (5, 6)]
    root = {i: i for i in [*range(60), *range(100, 141)]}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    ids = spark.createDataFrame([(i,) for i in root], "id long")
    got = graph.components(ids, spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.root for r in got.collect()} == root
    lab = {r.id: r.label for r in graph.labels(got, keep_single=False).collect()}
    assert lab[100] == 0 and all((lab[i] is None) == (list(root.values()).count(root[i]) == 1) for i in root)


def test_simhash_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    h = base + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base]
    signed = [x - (1 << 64) if x >> 63 else x for x in h]
    got = {(r.a, r.b) for r in graph.simhash_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, simhash long")).collect()}
    want = {(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if bin(h[i] ^ h[j]).count("1") <= 3}
    assert got == want and len(want) >= 30


def test_copies_beyond_any_bucket_are_paired_and_grouped(spark):
    n = 2100  # more than the explorer compares
    pages = spark.range(1, n + 6).selectExpr("id", "id + 10000 AS site_id", "0 AS depth", "id AS current_version_id")
    h = f"CASE WHEN id <= {n} THEN 5L WHEN id = {n} + 1 THEN 4L WHEN id = {n} + 2 THEN -1L WHEN id = {n} + 3 THEN 255L ELSE NULL END"
    versions = spark.range(1, n + 6).selectExpr("id", f"{h} AS simhash", "CAST('x' AS BINARY) AS text_hash", "repeat('a', 200) AS text")
    pairs = graph.simhash_pairs(versions)
    assert pairs.count() == pairs.distinct().count() == n * (n + 1) // 2 and pairs.where("a >= b").isEmpty()
    (group,) = graph.home_clusters(pages, versions).collect()
    assert (group.root, group.size, group.exact) == (1, n + 1, True) and list(group.ids) == list(range(10001, 10002 + n))


def test_neighbourhood_and_pruning(spark):
    e = edges(spark, [(1, 2, 5), (3, 1, 9), (2, 4, 1), (4, 5, 1), (1, 6, 5)])
    assert {(r.id, r.ring) for r in graph.neighbourhood(e, 1, 1, 3).collect()} == {(1, 0), (3, 1), (2, 1)}
    assert {r.id for r in graph.neighbourhood(e, 1, 2, 250).collect()} == {1, 2, 3, 4, 6}
    assert {r.id for r in graph.neighbourhood(e, 1, 0).collect()} == {1}
    nodes = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    n, kept = graph.draw_prune(nodes, graph.induced(e, nodes), center=9)
    assert {r.id for r in n.collect()} == {1, 2, 9} and kept.count() == 1


def test_communities_find_two_cliques(spark):
    rows = [(i, j, 1) for g in (0, 10) for i in range(g, g + 5) for j in range(i + 1, g + 5)] + [(0, 10, 1)]
    e = edges(spark, rows).selectExpr("src_site_id AS s", "dst_site_id AS t")
    c = graph.communities(e)
    groups = {}
    for r in c.collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [list(range(5)), list(range(10, 15))]
    assert [tuple(r) for r in graph.community_edges(c, e).collect()] == [(0, 1, 1)]


def test_operator_edges_have_both_bounds(spark):
    rows = [("pgp", "k", 1), ("pgp", "k", 2), ("pgp", "k", 2), ("email", "hub", 0)] + [("email", "hub", i) for i in range(19)] + [("btc", "b", 1), ("btc", "b", 9), ("pgp", None, 3), ("pgp", None, 4)]
    got = graph.operator_edges(spark.createDataFrame(rows, "kind string, value string, site_id long"))
    assert [tuple(r) for r in got.collect()] == [(1, 2)]
    assert got.where(F.col("a") > F.col("b")).count() == 0


def test_an_analysis_replaces_the_last_one(spark):
    import datetime as dt

    t0, t1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    ddl = "site_id long, pagerank double, component int, operator int"
    old = spark.createDataFrame([(i, 0.1, 0, None, t0) for i in (1, 2, 9)], ddl + ", updated_at timestamp_ntz")
    new, sites = spark.createDataFrame([(1, 0.5, 0, 1), (3, 0.5, 1, None), (8, 0.9, 1, None)], ddl), spark.createDataFrame([(1,), (2,), (3,)], "id long")
    now = F.lit(t1).cast("timestamp_ntz")
    assert {(r.site_id, r.pagerank, r.updated_at) for r in graph.upsert_analysis(old, new, sites, now).collect()} == {(1, 0.5, t1), (3, 0.5, t1)}
    assert graph.upsert_analysis(old, new.where("false"), sites, now).count() == 3
