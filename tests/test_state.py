from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weblattice.functions import onion
from weblattice.operators import metrics, predicates, search, state
from weblattice.sources import lists, snapshots

T0 = dt.datetime(2025, 1, 1)


def test_liveness_equals_the_fold(spark):
    outcomes = ["ok", "timeout", "desc_not_found", "desc_not_found", "auth_required", "http_error", "rend_failed"]
    rows, firsts = [], {}
    for site in range(12):
        firsts[site] = T0 - dt.timedelta(days=site * 5)
        for k in range(1 + site % 6):
            rows.append((site, T0 + dt.timedelta(days=k * (site % 4) * 11, seconds=k), outcomes[(site * 3 + k) % len(outcomes)]))
    sites = spark.createDataFrame(list(firsts.items()), "id long, first_seen timestamp_ntz")
    got = {r.id: r for r in state.liveness(sites, spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, outcome string")).collect()}
    for site, first in firsts.items():
        s = state.fold(((pd.Timestamp(t), o) for i, t, o in rows if i == site), pd.Timestamp(first))
        r = got[site]
        assert (r.status, r.consecutive_failures, r.last_seen) == (s["status"], s["consecutive_failures"], s["last_seen"].to_pydatetime())
        assert r.next_check_at == s["next_check_at"].to_pydatetime()
        assert (r.last_ok is None) == pd.isna(s["last_ok"])


def test_links_expand(spark):
    a, b, bad = (onion.address_of(bytes([i]) * 32) for i in (1, 2, 3))
    links = [("/deeper#x", "x"), (f"http://{b}.onion/page", "b"), (f"http://{b}.onion/page", "again"), ("https://clear.example/y#z", "c"), (f"http://{bad}.onion/", "blocked"), ("mailto:x@y", "m")]
    page = spark.createDataFrame([(1, a, 1, f"http://{a}.onion/", links)], "page_id long, address string, depth int, base string, links array<struct<url:string,anchor:string>>")
    blocklist = spark.createDataFrame([(bad,)], "x string").select(F.md5("x").alias("md5"))
    recorded, queued = state.expand_links(page, blocklist)
    assert sorted(r.dst_url for r in recorded.collect()) == sorted([f"http://{a}.onion/deeper", f"http://{b}.onion/page", f"http://{b}.onion/page", "https://clear.example/y"])
    assert {(r.url, r.depth, r.priority) for r in queued.collect()} == {(f"http://{a}.onion/deeper", 2, 4), (f"http://{b}.onion/", 0, 0), (f"http://{b}.onion/page", 1, 3)}
    _, none = state.expand_links(page.withColumn("depth", F.lit(3)), blocklist)
    assert f"http://{a}.onion/deeper" not in {r.url for r in none.collect()}


def test_purge_leaves_no_reference(spark):
    t = {
        "sites": spark.createDataFrame([(1, "a"), (2, "b")], "id long, onion string"),
        "pages": spark.createDataFrame([(10, 1), (20, 2)], "id long, site_id long"),
        "page_versions": spark.createDataFrame([(100, 10, b"x"), (200, 20, b"y"), (201, 20, b"x")], "id long, page_id long, html_hash binary"),
        "links": spark.createDataFrame([(10, 2), (20, 1), (20, None)], "src_page_id long, dst_site_id long"),
        "entities": spark.createDataFrame([(100, 1), (200, 2)], "page_version_id long, site_id long"),
        "fetch_log": spark.createDataFrame([(1,), (2,)], "site_id long"),
        "blobs": spark.createDataFrame([(b"x",), (b"y",), (b"z",)], "hash binary"),
    }
    left = state.purge(t, spark.createDataFrame([(1,)], "site_id long"))
    assert {k: v.count() for k, v in left.items()} == {"sites": 1, "pages": 1, "page_versions": 2, "links": 2, "entities": 1, "fetch_log": 1, "blobs": 2}
    assert left["links"].where("dst_site_id = 1").count() == 0


def test_snapshots(spark, tmp_path):
    s = snapshots.Snapshots(spark, f"file://{tmp_path}")
    assert "pages" in s.bootstrap() and s.bootstrap() == []
    old = spark.createDataFrame([("a" * 32, "x"), ("b" * 32, "y")], "md5 string, source string")
    s.write("blocklist", old)
    s.write("blocklist", snapshots.upsert(s.read("blocklist"), spark.createDataFrame([("b" * 32, "z")], "md5 string, source string"), ["md5"]))
    assert {tuple(r) for r in s.read("blocklist").collect()} == {("a" * 32, "x"), ("b" * 32, "z")}
    s.write_blobs(spark.createDataFrame([("<p>",), ("<p>",), (None,)], "html string"))
    assert s.read("blobs").count() == 1
    new = snapshots.allocate(spark.createDataFrame([(7,)], "id long"), spark.createDataFrame([("c",), ("a",), ("b",)], "onion string"), "id", ["onion"])
    assert {r.onion: r.id for r in new.collect()} == {"a": 8, "b": 9, "c": 10}


def test_short_blocklists_are_refused(spark, tmp_path):
    (tmp_path / "l").write_text("junk\n" + "\n".join(f"{i:032X}" for i in range(1200)))
    assert lists.blocklist(spark, str(tmp_path / "l")).count() == 1200
    with pytest.raises(lists.BrokenList):
        lists.blocklist(spark, str(tmp_path / "l"), least=1201)


def test_search(spark):
    docs = spark.createDataFrame([(1, 1, "u1", "red fox", "a fox " * 3), (2, 1, "u2", "", "the fox and the hound " * 40), (3, 2, "u3", None, "nothing"), (4, 2, "u4", "dog", None)], "page_id long, site_id long, url string, title string, text string")
    idx = search.inverted(docs)
    hits = search.search(idx, docs, " Fox ").collect()
    assert [h.page_id for h in hits] == [1, 2] and hits[0].total == 2
    assert all(len(h.snippets) <= 2 and search.OPEN + "fox" + search.CLOSE in h.snippets[0] for h in hits)
    assert search.search(idx, docs, "  ").count() == 0 and search.search(idx, docs, "fox", start=1).count() == 1
    left, kept = search.delete_site(idx, docs, 1)
    assert left.where("term = 'fox'").count() == 0 and kept.count() == 2


def test_rates_and_quantiles(spark):
    rows = [(T0 + dt.timedelta(seconds=60 * i), v) for i, v in enumerate([0.0, 60.0, 120.0, 30.0, 90.0])]
    r = metrics.rates(spark.createDataFrame([("s", t, v) for t, v in rows], "series string, ts timestamp_ntz, value double"), ["series"], 120).orderBy("ts").collect()
    assert [x.increase for x in r] == [0, 60, 60, 30, 60] and r[-1].rate == pytest.approx(150 / 120)
    b = spark.createDataFrame([("a", "1", 50.0), ("a", "2", 100.0), ("a", "+Inf", 100.0), ("z", "1", 0.0), ("z", "+Inf", 0.0), ("i", "1", 1.0), ("i", "+Inf", 100.0)], "k string, le string, value double")
    q = {x.k: x.value for x in metrics.histogram_quantile(0.75, b, ["k"]).collect()}
    assert q["a"] == pytest.approx(1.5) and q["i"] == pytest.approx(1.0) and "z" not in q
    assert metrics.step_of(None) == (6, 72) and metrics.step_of(0) == (6, 72) and metrics.step_of(999)[0] == 168


def test_predicates(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id long, component int")
    assert df.where(predicates.all_of(predicates.optional("component", 5), predicates.optional("id", None))).count() == 1
    assert df.where(predicates.all_of()).count() == 2
    assert predicates.any_of(df, "id", []).count() == 0 and predicates.any_of(df, "id", [1, 2, 2], small=1).count() == 2


def test_a_leased_site_is_not_claimed_again(spark):
    ddl = "id long, onion string, status string, pages_fetched int, next_allowed_at timestamp_ntz, lease_until timestamp_ntz"
    sites = spark.createDataFrame([(i, f"o{i}", "up", i - 1, T0, T0) for i in (1, 2, 3)], ddl)
    frontier = spark.createDataFrame([(bytes([i]), f"u{i}", i, 0, 1, T0, 0) for i in (1, 2, 3)], "url_hash binary, url string, site_id long, depth int, priority int, next_fetch_at timestamp_ntz, attempts int")
    now = F.lit(T0).cast("timestamp_ntz")
    jobs, leased = state.claim(sites, frontier, now, n=2)
    assert {r.site_id for r in jobs.collect()} == {1, 2}
    again, _ = state.claim(leased, frontier, now, n=2)
    assert {r.site_id for r in again.collect()} == {3}
    later = F.lit(T0 + dt.timedelta(seconds=state.LEASE_S)).cast("timestamp_ntz")
    assert {r.site_id for r in state.claim(leased, frontier, later, n=5)[0].collect()} == {1, 2, 3}


def test_an_unchanged_page_changes_nothing_but_its_time(spark):
    tables = {
        "sites": spark.createDataFrame([(1, "a", "old", "srv", 1)], "id long, onion string, title string, server string, pages_fetched int"),
        "pages": spark.createDataFrame([], "id long, site_id long, url string, url_hash binary, depth int, first_fetched timestamp_ntz, last_fetched timestamp_ntz, last_status int, current_version_id long"),
        "page_versions": spark.createDataFrame([], "id long, page_id long, fetched_at timestamp_ntz, http_status int, content_type string, text_hash binary, simhash long, title string, text string, html_hash binary"),
        "links": spark.createDataFrame([], "src_page_id long, dst_site_id long, dst_url string, anchor_text string, is_onion boolean"),
        "entities": spark.createDataFrame([], "page_version_id long, site_id long, kind string, value string"),
    }

    def capture(minutes, text, html, title="t"):
        return (1, "http://a.onion/", 0, T0 + dt.timedelta(minutes=minutes), 200, "text/html", "s", title, text, html, 7, [("u", "x", "a"), ("v", "", "")], [("email", "e"), ("email", "e")])

    save = lambda t, *rows: state.save_pages(t, spark.createDataFrame(rows, state.CAPTURE))
    counts = lambda t: {k: v.count() for k, v in t.items()}
    one = save(tables, capture(0, "old", b"h"), capture(1, "text", b"h"))  # the last of a batch counts
    assert counts(one) == {"sites": 1, "pages": 1, "page_versions": 1, "links": 2, "entities": 1}
    assert one["page_versions"].first().text == "text" and one["sites"].first().pages_fetched == 2 and one["sites"].first().title == "t"
    two = save(one, capture(5, "text", b"h", title="other"))
    assert counts(two) == counts(one) and two["sites"].first().title == "t" and two["pages"].first().last_fetched == T0 + dt.timedelta(minutes=5)
    three = save(two, capture(9, "text", b"other html", title=""))  # only the HTML differs
    assert counts(three) == {"sites": 1, "pages": 1, "page_versions": 2, "links": 2, "entities": 2}
    assert three["pages"].first().current_version_id == 2 and three["sites"].first().title is None and three["sites"].first().pages_fetched == 2
    assert {(r.dst_site_id, r.is_onion) for r in three["links"].collect()} == {(1, True), (None, False)}


def test_stored_state_goes_on(spark):
    sites = spark.createDataFrame([(1, T0, T0, 4), (2, T0, None, 2), (3, T0, T0, 1)], "id long, first_seen timestamp_ntz, last_ok timestamp_ntz, consecutive_failures int")
    t = T0 + dt.timedelta(hours=1)
    log = spark.createDataFrame([(1, t, "desc_not_found"), (2, t, "ok"), (2, t + dt.timedelta(hours=1), "timeout")], "site_id long, ts timestamp_ntz, outcome string")
    got = {r.id: r for r in state.liveness(sites, log, stored=True).collect()}
    assert (got[1].status, got[1].consecutive_failures, got[1].last_ok, got[1].next_check_at) == ("down", 5, T0, t + dt.timedelta(hours=16))
    assert (got[2].status, got[2].consecutive_failures, got[2].last_ok) == ("flaky", 1, t) and 3 not in got


def test_no_crawl_without_enough_hashes(spark):
    stored = spark.createDataFrame([(f"{i:032x}", "remote" if i < 5 else "local") for i in range(9)], "md5 string, source string")
    assert lists.gate(stored, "remote", least=5) == 5
    with pytest.raises(lists.BrokenList):
        lists.gate(stored, "remote", least=6)
