"""The crawl's state as snapshots: each function takes tables and gives the next ones. Times are given, never taken from a clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weblattice.functions.fetching import ALIVE, TRANSIENT
from weblattice.functions.hashing import url_hash
from weblattice.functions.onion import canonical_any, canonical_onion, home_url
from weblattice.session import cut
from weblattice.sources.snapshots import allocate, insert_ignore, latest

MAX_LINKS, MAX_DEPTH, PAGE_CAP, URL_CHARS, MAX_ATTEMPTS = 5000, 3, 200, 2000, 3
DELAY_S, SLOWER, LEASE_S = 8, 4, 180


def after(ts: Column, seconds) -> Column:
    """A time some seconds later."""
    return (ts.cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds) if isinstance(seconds, (int, float)) else seconds)).cast("timestamp_ntz")


def expand_links(fetched: DataFrame, blocklist: DataFrame, max_depth: int = MAX_DEPTH, max_links: int = MAX_LINKS) -> tuple[DataFrame, DataFrame]:
    """(links to record, URLs to queue) of fetched pages (page_id, address, depth, base, links).

    The first max_links links of a page count. Links off the network are recorded without their fragment; those to blocked sites are dropped;
    a link within the site is queued one deeper, one to another site with that site's home page first.
    """
    each = fetched.select("page_id", "address", "depth", "base", F.posexplode(F.slice("links", 1, max_links)).alias("pos", "link"))
    each = each.withColumn("to", canonical_onion(F.col("link.url"), F.col("base")))
    blocked = blocklist.select("md5").distinct()
    both = each.where("to.address IS NOT NULL").select("to.address").distinct().select("address", F.explode(F.array(F.md5(F.concat("address", F.lit(".onion"))), F.md5("address"))).alias("md5"))
    bad = both.join(blocked, "md5", "left_semi").select(F.col("address").alias("dst")).distinct()
    onions = each.where("to.address IS NOT NULL").withColumn("dst", F.col("to.address")).join(bad, "dst", "left_anti")
    absolute = canonical_any(F.regexp_replace("link.url", "#.*$", ""), F.col("base"))
    clear = each.where("to.address IS NULL").withColumn("url", absolute).where("url IS NOT NULL")
    recorded = onions.select("page_id", F.left("to.url", F.lit(URL_CHARS)).alias("dst_url"), F.col("link.anchor").alias("anchor_text"), "dst", F.lit(True).alias("is_onion")).unionByName(
        clear.select("page_id", F.left("url", F.lit(URL_CHARS)).alias("dst_url"), F.col("link.anchor").alias("anchor_text"), F.lit(None).cast("string").alias("dst"), F.lit(False).alias("is_onion"))
    )
    own = F.col("dst") == F.col("address")
    deeper = F.struct(F.col("to.url").alias("url"), (F.col("depth") + 1).alias("depth"), (F.col("depth") + 3).alias("priority"))
    home = F.struct(home_url(F.col("dst")).alias("url"), F.lit(0).alias("depth"), F.lit(0).alias("priority"))
    deep = F.struct(F.col("to.url").alias("url"), F.lit(1).alias("depth"), F.lit(3).alias("priority"))
    found = F.when(own & (F.col("depth") + 1 <= max_depth), F.array(deeper)).when(own, F.array().cast("array<struct<url:string,depth:int,priority:int>>")).when((F.col("to.url") != home_url(F.col("dst"))) & F.lit(max_depth >= 1), F.array(home, deep)).otherwise(F.array(home))
    queued = onions.select("page_id", "pos", "dst", F.posexplode(found).alias("k", "q")).select("page_id", "pos", "k", "dst", "q.url", "q.depth", "q.priority")
    first = queued.groupBy("url").agg(F.min_by(F.struct("dst", "depth", "priority"), F.struct("page_id", "pos", "k")).alias("x"))
    return recorded, first.select("url", "x.dst", "x.depth", "x.priority")


def enqueue(sites: DataFrame, frontier: DataFrame, pages: DataFrame, found: DataFrame, now: Column, cap: int = PAGE_CAP) -> DataFrame:
    """The frontier with those of found (url, dst, depth, priority) whose site is known and under its cap and that were never stored or queued."""
    s = sites.where(F.col("pages_fetched") < cap).select(F.col("onion").alias("dst"), F.col("id").alias("site_id"))
    new = found.withColumn("url_hash", url_hash(F.col("url"))).join(s, "dst").join(pages.select("url_hash"), "url_hash", "left_anti")
    return insert_ignore(frontier, new.select("url_hash", "url", "site_id", "depth", "priority", now.alias("next_fetch_at"), F.lit(0).alias("attempts")), ["url_hash"])


def _due(frontier: DataFrame, sites: DataFrame, now: Column, cap: int) -> DataFrame:
    s = sites.select(F.col("id").alias("site_id"), "pages_fetched")
    return frontier.where(F.col("next_fetch_at") <= now).join(s, "site_id").where((F.col("pages_fetched") < cap) | (F.col("priority") <= 1))


def claim(sites: DataFrame, frontier: DataFrame, now: Column, n: int = 64, cap: int = PAGE_CAP, lease: int = LEASE_S) -> tuple[DataFrame, DataFrame]:
    """(jobs, sites): the best due URL of each of at most n due sites, new sites first, and the sites with these leased, so that no other claim gets them.

    jobs: (site_id, onion, url_hash, url, depth, attempts).
    """
    free = sites.where((F.col("next_allowed_at") <= now) & (F.col("lease_until") <= now) & (F.col("status") != "auth_gated")).select(F.col("id").alias("site_id"), "onion", "pages_fetched", "next_allowed_at")
    best = _due(frontier, sites, now, cap).groupBy("site_id").agg(F.min_by(F.struct("url_hash", "url", "depth", "attempts"), F.struct("priority", "next_fetch_at", "url_hash")).alias("f"))
    jobs = free.join(best, "site_id").orderBy(F.desc(F.col("pages_fetched") == 0), "next_allowed_at", "site_id").limit(n).select("site_id", "onion", "f.url_hash", "f.url", "f.depth", "f.attempts")
    taken = jobs.select(F.col("site_id").alias("id"), F.lit(True).alias("__taken"))
    leased = sites.join(taken, "id", "left").withColumn("lease_until", F.when(F.col("__taken"), after(now, lease)).otherwise(F.col("lease_until")))
    return jobs, leased.select(*sites.columns)


def release(sites: DataFrame, done: DataFrame, now: Column, delay: int = DELAY_S) -> DataFrame:
    """Sites with the leases of those in done (site_id, outcome) ended; a service that struggles is left alone for longer."""
    d = done.groupBy(F.col("site_id").alias("id")).agg(F.max(F.when(F.col("outcome").isin("ok", "http_error"), delay).otherwise(SLOWER * delay)).alias("wait"))
    s = sites.join(d, "id", "left")
    ended = F.col("wait").isNotNull()
    return s.withColumn("lease_until", F.when(ended, F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz")).otherwise(F.col("lease_until"))).withColumn("next_allowed_at", F.when(ended, after(now, F.col("wait"))).otherwise(F.col("next_allowed_at"))).select(*sites.columns)


def backoff_seconds(attempts: Column) -> Column:
    """30 minutes, doubled with every attempt."""
    return 1800 * F.pow(F.lit(2.0), attempts)


def finish(frontier: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """The frontier after fetches (url_hash, outcome): passing failures wait for another try, all else is taken off."""
    d = done.groupBy("url_hash").agg(F.max(F.col("outcome").isin(*TRANSIENT)).alias("again"))
    f = frontier.join(d, "url_hash", "left")
    retry = F.col("again") & (F.col("attempts") < MAX_ATTEMPTS)
    kept = f.where(F.col("again").isNull() | retry)
    return kept.withColumn("next_fetch_at", F.when(retry, after(now, backoff_seconds(F.col("attempts")))).otherwise(F.col("next_fetch_at"))).withColumn("attempts", F.when(retry, F.col("attempts") + 1).otherwise(F.col("attempts"))).select(*frontier.columns)


_HOUR, _DAY = pd.Timedelta(hours=1), pd.Timedelta(days=1)


def step(state: dict, ts: pd.Timestamp, outcome: str) -> dict:
    """A site's state after one logged fetch: what answered is up; else it is gated, dead after 30 days, down or flaky. Conditions see the state before."""
    alive = outcome in ALIVE
    since = state["last_ok"] if not pd.isna(state["last_ok"]) else state["first_seen"]
    old = not pd.isna(since) and since < ts - 30 * _DAY
    if alive:
        status, wait = "up", _DAY
    elif outcome == "auth_required":
        status, wait = "auth_gated", 30 * _DAY
    elif old:
        status, wait = "dead", 30 * _DAY
    elif outcome == "desc_not_found":
        status, wait = "down", min(_HOUR * 2 ** min(state["consecutive_failures"], 8), 7 * _DAY)
    else:
        status, wait = "flaky", 6 * _HOUR
    return {"first_seen": state["first_seen"], "last_seen": ts, "last_ok": ts if alive else state["last_ok"], "consecutive_failures": 0 if alive else state["consecutive_failures"] + 1, "status": status, "next_check_at": ts + wait}


LIVENESS = "id long, status string, consecutive_failures int, last_seen timestamp_ntz, last_ok timestamp_ntz, next_check_at timestamp_ntz"


def liveness(sites: DataFrame, log: DataFrame, stored: bool = False) -> DataFrame:
    """(LIVENESS) of the sites with logged fetches: from never seen, or with ``stored`` from the state in sites, to which log is what came since.

    The last state depends on few facts only: the last row, the last answer before it and the failures since then. So it is computed
    by aggregates, without gathering any site's log in one place.
    """
    held = (F.col("last_ok"), F.col("consecutive_failures").cast("long")) if stored else (F.lit(None).cast("timestamp_ntz"), F.lit(0).cast("long"))
    known = sites.select(F.col("id").alias("site_id"), "first_seen", held[0].alias("held_ok"), F.coalesce(held[1], F.lit(0)).alias("held_fails"))
    l = log.join(known, "site_id").select("site_id", "ts", "outcome", "first_seen", "held_ok", "held_fails", F.col("outcome").isin(*ALIVE).alias("alive"))  # noqa: E741
    ok = l.where("alive").groupBy("site_id").agg(F.max(F.struct("ts", "outcome")).alias("ok_at"))
    w = l.join(ok, "site_id", "left").withColumn("at", F.struct("ts", "outcome"))
    a = w.groupBy("site_id", "first_seen", "ok_at", "held_ok", "held_fails").agg(F.max("at").alias("last"), F.count_if(F.col("ok_at").isNull() | (F.col("at") > F.col("ok_at"))).alias("fails"))
    a = a.withColumn("fails", F.col("fails") + F.when(F.col("ok_at").isNull(), F.col("held_fails")).otherwise(0))
    ok_ts, ts = F.coalesce("ok_at.ts", "held_ok"), F.col("last.ts")
    up = F.col("ok_at").isNotNull() & (F.col("last") == F.col("ok_at"))
    gated = F.col("last.outcome") == "auth_required"
    old = F.coalesce(ok_ts, F.col("first_seen")) < after(ts, -30 * 86400)
    gone = F.col("last.outcome") == "desc_not_found"
    status = F.when(up, "up").when(gated, "auth_gated").when(old, "dead").when(gone, "down").otherwise("flaky")
    wait = F.when(up, F.lit(86400.0)).when(gated | old, F.lit(30 * 86400.0)).when(gone, F.least(3600 * F.pow(F.lit(2.0), F.least(F.col("fails") - 1, F.lit(8))), F.lit(7 * 86400.0))).otherwise(F.lit(6 * 3600.0))
    return a.select(F.col("site_id").alias("id"), status.alias("status"), F.when(up, 0).otherwise(F.col("fails")).cast("int").alias("consecutive_failures"), ts.alias("last_seen"), ok_ts.alias("last_ok"), after(ts, wait).alias("next_check_at"))


def rechecks(sites: DataFrame, frontier: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(sites, frontier) with the home pages of sites that are due for a check queued, at once and before others."""
    due = (F.col("next_check_at") <= now) & (F.col("status") != "auth_gated")
    home = sites.where(due).select(F.col("id").alias("site_id"), home_url(F.col("onion")).alias("url")).select(url_hash(F.col("url")).alias("url_hash"), "url", "site_id", F.lit(0).alias("depth"), F.lit(1).alias("priority"), now.alias("next_fetch_at"), F.lit(0).alias("attempts"), F.lit(1).alias("__new"))
    both = frontier.withColumn("__new", F.lit(0)).unionByName(home)
    first = lambda c: F.min_by(c, "__new").alias(c)
    merged = both.groupBy("url_hash").agg(*[first(c) for c in ("url", "site_id", "depth", "attempts")], F.min("priority").alias("priority"), F.min("next_fetch_at").alias("next_fetch_at"))
    return sites.withColumn("next_check_at", F.when(due, after(now, 3600)).otherwise(F.col("next_check_at"))), merged.select(*frontier.columns)


def changed_versions(captures: DataFrame, by: str = "page_id", hashes: tuple[str, ...] = ("text_hash",)) -> DataFrame:
    """The captures (with ``fetched_at`` and ``id``) whose hashes differ from the capture before of the same page; the first one always."""
    w = Window.partitionBy(by).orderBy("fetched_at", "id")
    same = [F.col(h).eqNullSafe(F.lag(h).over(w)) for h in hashes]
    is_first = F.row_number().over(w) == 1
    out = captures.withColumn("__new", is_first)
    for i, s in enumerate(same):
        out = out.withColumn(f"__s{i}", s)
    return out.where("__new OR NOT (" + " AND ".join(f"__s{i}" for i in range(len(same))) + ")").drop("__new", *[f"__s{i}" for i in range(len(same))])


CAPTURE = "site_id long, url string, depth int, fetched_at timestamp_ntz, status int, content_type string, server string, title string, text string, html_hash binary, simhash long, links array<struct<url:string,anchor:string,dst:string>>, entities array<struct<kind:string,value:string>>"


def save_pages(tables: dict[str, DataFrame], captures: DataFrame) -> dict[str, DataFrame]:
    """The tables sites, pages, page_versions, links and entities after fetched pages (CAPTURE) are stored.

    A page is known by its URL; of several captures of one in a batch the last counts. Every captured page has its time and status brought up to date.
    Only where text or HTML differ from the current version's there is a new version, which becomes the current one, takes the place of the
    page's links and brings its entities, each once; and a home page names its site then. A new page counts for its site.
    """
    old, versions, sites = tables["pages"], tables["page_versions"], tables["sites"]
    c = latest(captures.withColumn("url_hash", url_hash(F.col("url"))), ["url_hash"], ["fetched_at", "status", "text"])
    c = c.withColumn("text_hash", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    now = versions.select(F.col("id").alias("current_version_id"), F.col("text_hash").alias("__text"), F.col("html_hash").alias("__html"), F.lit(True).alias("__held"))
    held = old.select("url_hash", F.col("id").alias("page_id"), "current_version_id").join(now, "current_version_id", "left")
    c = c.join(held, "url_hash", "left")
    same = F.coalesce("__held", F.lit(False)) & F.col("__text").eqNullSafe(F.col("text_hash")) & F.col("__html").eqNullSafe(F.col("html_hash"))
    c = cut(c.withColumn("__changed", ~same).drop("__text", "__html", "__held", "current_version_id"))
    fresh = allocate(old, c.where("page_id IS NULL").select("url_hash"), "id", ["url_hash"]).withColumnRenamed("id", "__new")
    c = c.join(fresh, "url_hash", "left").withColumn("__is_new", F.col("page_id").isNull()).withColumn("page_id", F.coalesce("page_id", "__new"))
    changed = cut(allocate(versions, c.where("__changed"), "version_id", ["page_id"], held="id"))

    kept = {"id": F.col("version_id"), "http_status": F.col("status")}
    made = changed.select(*[kept.get(n, F.col(n) if n in changed.columns else F.lit(None)).cast(versions.schema[n].dataType).alias(n) for n in versions.columns])
    to = changed.select("page_id", F.col("version_id").alias("__version"))
    seen = c.select("page_id", F.col("fetched_at").alias("__at"), F.col("status").alias("__status")).join(to, "page_id", "left")
    pages = old.join(seen.withColumnRenamed("page_id", "id"), "id", "left")
    pages = pages.withColumn("last_fetched", F.coalesce("__at", "last_fetched")).withColumn("last_status", F.when(F.col("__at").isNotNull(), F.col("__status")).otherwise(F.col("last_status"))).withColumn("current_version_id", F.coalesce("__version", "current_version_id")).select(*old.columns)
    values = {"id": F.col("page_id"), "first_fetched": F.col("fetched_at"), "last_fetched": F.col("fetched_at"), "last_status": F.col("status"), "current_version_id": F.col("__version")}
    first = c.where("__is_new").join(to, "page_id", "left")
    first = first.select(*[values.get(n, F.col(n) if n in first.columns else F.lit(None)).cast(old.schema[n].dataType).alias(n) for n in old.columns])

    each = changed.select("page_id", F.explode("links").alias("link")).select("page_id", F.nullif("link.dst", F.lit("")).alias("dst"), "link.url", "link.anchor")
    target = sites.select(F.col("onion").alias("dst"), F.col("id").alias("dst_site_id"))
    links = each.join(target, "dst", "left").select(F.col("page_id").alias("src_page_id"), "dst_site_id", F.col("url").alias("dst_url"), F.col("anchor").alias("anchor_text"), F.col("dst").isNotNull().alias("is_onion"))
    gone = changed.select(F.col("page_id").alias("src_page_id"))
    told = changed.select(F.col("version_id").alias("page_version_id"), "site_id", F.explode("entities").alias("e")).select("page_version_id", "site_id", "e.kind", "e.value")

    grown = c.where("__is_new").groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("__more"))
    home = changed.where((F.col("depth") == 0) & F.col("url").endswith(".onion/")).groupBy(F.col("site_id").alias("id")).agg(F.max_by(F.struct("title", "server"), F.struct("fetched_at", "url")).alias("__home"))
    s = sites.join(grown, "id", "left").join(home, "id", "left").withColumn("pages_fetched", (F.col("pages_fetched") + F.coalesce("__more", F.lit(0))).cast("int"))
    for n in ("title", "server"):
        s = s.withColumn(n, F.when(F.col("__home").isNotNull(), F.nullif(F.col(f"__home.{n}"), F.lit(""))).otherwise(F.col(n)))
    return {
        **tables,
        "sites": s.select(*sites.columns),
        "pages": pages.unionByName(first),
        "page_versions": versions.unionByName(made),
        "links": tables["links"].join(gone, "src_page_id", "left_anti").unionByName(links),
        "entities": insert_ignore(tables["entities"], told, ["page_version_id", "kind", "value"]),
    }


def current_versions(versions: DataFrame) -> DataFrame:
    """(page_id, current_version_id): the last version of each page."""
    return versions.groupBy("page_id").agg(F.max_by("id", F.struct("fetched_at", "id")).alias("current_version_id"))


def purge(tables: dict[str, DataFrame], bad: DataFrame) -> dict[str, DataFrame]:
    """All tables without the sites in bad (site_id): pages, versions, links, entities, log rows, queue and blobs that nothing refers to any more."""
    t = dict(tables)
    gone = bad.select("site_id").distinct()
    dead_pages = t["pages"].join(gone, "site_id", "left_semi").select(F.col("id").alias("page_id"))
    t["sites"] = t["sites"].join(gone.withColumnRenamed("site_id", "id"), "id", "left_anti")
    for name in ("pages", "frontier", "entities", "fetch_log", "site_analysis"):
        if name in t:
            t[name] = t[name].join(gone, "site_id", "left_anti")
    t["page_versions"] = t["page_versions"].join(dead_pages, "page_id", "left_anti")
    links = t["links"].join(dead_pages.withColumnRenamed("page_id", "src_page_id"), "src_page_id", "left_anti")
    dst = gone.select(F.col("site_id").alias("dst_site_id"), F.lit(True).alias("__gone"))
    t["links"] = links.join(dst, "dst_site_id", "left").withColumn("dst_site_id", F.when(F.col("__gone").isNull(), F.col("dst_site_id"))).select(*tables["links"].columns)
    if "blobs" in t and "html_hash" in t["page_versions"].columns:
        t["blobs"] = t["blobs"].join(t["page_versions"].select(F.col("html_hash").alias("hash")), "hash", "left_semi")
    return t


def replace_source(blocklist: DataFrame, source: str, hashes: DataFrame) -> DataFrame:
    """The blocklist with one source's hashes replaced; a hash that another source has stays that one's."""
    return insert_ignore(blocklist.where(F.col("source") != source), hashes.select("md5", F.lit(source).alias("source")), ["md5"])


def trim_capped(sites: DataFrame, frontier: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """The frontier without the deeper URLs of sites at their cap."""
    full = sites.where(F.col("pages_fetched") >= cap).select(F.col("id").alias("site_id"), F.lit(True).alias("__full"))
    return frontier.join(full, "site_id", "left").where(F.col("__full").isNull() | (F.col("priority") <= 1)).select(*frontier.columns)


def index_delta(pages: DataFrame) -> DataFrame:
    """The pages whose current version isn't the indexed one."""
    return pages.where(~F.col("current_version_id").eqNullSafe(F.col("indexed_version_id")) & F.col("current_version_id").isNotNull())


def mark_indexed(pages: DataFrame, indexed: DataFrame) -> DataFrame:
    """pages with those of indexed (page_id, version_id) marked as indexed by that version."""
    done = indexed.select(F.col("page_id").alias("id"), F.col("version_id").alias("__done"))
    return pages.join(done, "id", "left").withColumn("indexed_version_id", F.coalesce("__done", "indexed_version_id")).select(*pages.columns)


def gauges(sites: DataFrame, frontier: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """(metric, label, value): sites by status, queued and due URLs, pages."""
    by = sites.groupBy(F.col("status").alias("label")).agg(F.count("*").alias("value")).select(F.lit("crawler_sites").alias("metric"), "label", "value")
    f = frontier.agg(F.count("*").alias("total"), F.count_if(F.col("next_fetch_at") <= now).alias("due")).select(F.explode(F.array(F.struct(F.lit("total").alias("label"), F.col("total").alias("value")), F.struct(F.lit("due").alias("label"), F.col("due").alias("value")))).alias("x")).select(F.lit("crawler_frontier").alias("metric"), "x.label", "x.value")
    return by.unionByName(f).unionByName(pages.agg(F.count("*").alias("value")).select(F.lit("crawler_pages").alias("metric"), F.lit("").alias("label"), "value"))


def route(captures: DataFrame, hit: Column) -> DataFrame:
    """(site_id, reason) of the sites to purge: blocked, or filtered by outcome or because something captured holds a term."""
    reason = F.when(F.col("outcome") == "blocked", "blocklist").when(F.col("outcome").isin("filtered", "redirect_filtered") | hit, "filter")
    return captures.select("site_id", reason.alias("reason")).where("reason IS NOT NULL").groupBy("site_id").agg(F.min("reason").alias("reason"))


def report(purged: DataFrame, sites: DataFrame, now: Column) -> DataFrame:
    """(address, ts) of sites purged by the filter, never anything of their pages."""
    return purged.where("reason = 'filter'").join(sites.select(F.col("id").alias("site_id"), "onion"), "site_id").select(F.concat("onion", F.lit(".onion")).alias("address"), now.alias("ts"))


def fold(rows: Iterator[tuple[pd.Timestamp, str]], first_seen: pd.Timestamp) -> dict:
    """step() over rows in order: what liveness() must agree with."""
    s = {"first_seen": first_seen, "last_seen": pd.NaT, "last_ok": pd.NaT, "consecutive_failures": 0, "status": "unknown", "next_check_at": pd.NaT}
    for ts, outcome in rows:
        s = step(s, ts, outcome)
    return s

