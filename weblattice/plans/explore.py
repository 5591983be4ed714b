"""Read-only queries of the explorer: overview, sites, one site, one page, entities, graph, clusters and analytics.

Each takes a Crawl and parameters; lists end with the site or page id as the last key of their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weblattice.functions.fetching import ALIVE, is_alive
from weblattice.functions.hashing import hamming, hex64
from weblattice.operators import graph, state
from weblattice.plans.crawl import Crawl, site_columns, truncated

MAX_TEXT, PAGE_SIZE, ENTITY_PAGE, MAX_OFFSET = 300_000, 100, 200, 1_000_000


class NotFound(KeyError):
    """No such site, page or series."""


def clamp(value, default: int, most: int) -> int:
    """A number from outside: default where it is none or negative, at most ``most``."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return default
    return default if n < 0 else min(n, most)


def pager(offset: int, shown: int, size: int, total: int | None = None) -> tuple[int | None, int | None]:
    """(offset of the previous page, of the next one), None where there is none.

    Where the total is known it decides whether there is a next page; else a full page is thought to have one.
    """
    more = shown >= size if total is None else offset + size < total
    return (max(0, offset - size) if offset > 0 else None), (offset + size if more else None)


def one(df: DataFrame) -> dict:
    """The only row, or NotFound."""
    rows = df.limit(1).collect()
    if not rows:
        raise NotFound("not found")
    return rows[0].asDict(recursive=True)


# ---- overview


def status_counts(c: Crawl) -> DataFrame:
    return c.sites.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def totals(c: Crawl) -> DataFrame:
    """One row; each number is a scalar subquery, so that the tables' counts run side by side."""
    n = lambda df: df.agg(F.count("*")).scalar()
    return c.spark.range(1).select(*[n(x).alias(k) for k, x in (("sites", c.sites), ("pages", c.pages), ("versions", c.versions), ("links", c.links), ("entities", c.entities), ("edges", c.edges), ("frontier", c.frontier))])


def outcomes_24h(c: Crawl) -> DataFrame:
    return c.since("24 HOURS").groupBy("outcome").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "outcome")


def top_degree(c: Crawl, end: str, n: int = 15) -> DataFrame:
    """The sites with most incoming (dst_site_id) or outgoing (src_site_id) edges; they are cut before the join."""
    top = c.edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(n)
    return c.sites.join(F.broadcast(top), "id").select(*site_columns(c.sites), "degree").orderBy(F.desc("degree"), "id")


def recent(c: Crawl) -> DataFrame:
    return c.sites.where("status = 'up'").select(*site_columns(c.sites), "first_seen").orderBy(F.desc("first_seen"), "id").limit(15)


def activity(c: Crawl) -> DataFrame:
    return c.since("48 HOURS").groupBy(truncated("hour", F.col("ts")).alias("t")).agg(F.count("*").alias("fetches"), F.count_if(F.col("outcome") == "ok").alias("ok")).orderBy("t")


# ---- sites


def _sorts():
    last = [F.asc("id")]
    zero = lambda col: F.coalesce(col, F.lit(0)).desc()
    return {"rank": [zero("pagerank"), *last], "indeg": [F.desc("indeg"), *last], "outdeg": [F.desc("outdeg"), *last], "pages": [F.desc("pages_fetched"), *last], "recent": [F.desc("first_seen"), *last], "seen": [F.desc_nulls_last("last_ok"), *last]}


def sites(c: Crawl, status: str = "", q: str = "", sort: str = "indeg", offset=0, component=None, operator=None) -> DataFrame:
    """One page of the list of sites. Only the filters given become predicates; an unknown order means ``indeg``."""
    s = graph.with_degrees(c.sites, c.edges).join(c.analysis.withColumnRenamed("site_id", "id"), "id", "left")
    if status:
        s = s.where(F.col("status") == status)
    if q := q.strip():
        s = s.where(F.col("title").ilike(f"%{q}%") | F.col("onion").like(q.lower() + "%"))
    for name, value in (("component", component), ("operator", operator)):
        if value is not None and value >= 0:
            s = s.where(F.col(name) == value)
    order = _sorts().get(sort) or _sorts()["indeg"]
    return s.select("id", "onion", F.coalesce("title", F.lit("")).alias("title"), "status", "first_seen", "last_ok", "pages_fetched", "indeg", "outdeg", F.round("pagerank", 9).alias("pagerank")).orderBy(*order).offset(clamp(offset, 0, MAX_OFFSET)).limit(PAGE_SIZE)


# ---- one site


def site(c: Crawl, id_: int) -> DataFrame:
    """One site; when it is to be checked again stands in its row, or follows from the log where the table doesn't keep it."""
    kept = c.sites
    if "next_check_at" not in kept.columns:
        kept = kept.join(state.liveness(kept.where(F.col("id") == id_), c.log).select("id", "next_check_at"), "id", "left")
    s = graph.with_degrees(kept, c.edges).where(F.col("id") == id_).join(c.analysis.withColumnRenamed("site_id", "id"), "id", "left")
    return s.select("id", "onion", F.coalesce("title", F.lit("")).alias("title"), "status", "discovered_via", "first_seen", "last_seen", "last_ok", "consecutive_failures", F.coalesce("server", F.lit("")).alias("server"), "pages_fetched", "indeg", "outdeg", F.round("pagerank", 9).alias("pagerank"), "component", "operator", "next_check_at")


def uptime(c: Crawl, id_: int | None) -> DataFrame:
    """Per day of 90: answered fetches, all, and the last outcome (of equal times, the largest); None means every site."""
    log = c.since("90 DAYS")
    keys = ["site_id"] if id_ is None else []
    log = log if id_ is None else log.where(F.col("site_id") == id_)
    return log.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.count_if(is_alive(F.col("outcome"))).alias("up"), F.count("*").alias("total"), F.max_by("outcome", F.struct("ts", "outcome")).alias("last")).orderBy(*keys, "day")


def calendar(c: Crawl, id_: int) -> DataFrame:
    """A row for each of the last 90 days: none, up, down or flaky."""
    as_of = c.log.agg(F.max("ts")).scalar()
    days = c.spark.range(1).select(F.explode(F.sequence(F.date_sub(as_of.cast("date"), 89), as_of.cast("date"))).alias("day"))
    u = uptime(c, id_).select("day", "up", "total")
    return days.join(u, "day", "left").select("day", F.when(F.col("total").isNull(), "none").when(F.col("up") == F.col("total"), "up").when(F.col("up") == 0, "down").otherwise("flaky").alias("colour")).orderBy("day")


def fetches(c: Crawl, id_: int) -> DataFrame:
    return c.log.where(F.col("site_id") == id_).select("ts", "outcome", "http_status", "latency_ms").orderBy(F.desc("ts"), "outcome", F.asc_nulls_last("latency_ms")).limit(20)


def site_pages(c: Crawl, id_: int) -> DataFrame:
    p = c.pages.where(F.col("site_id") == id_)
    n = c.versions.groupBy("page_id").agg(F.count("*").alias("versions")).withColumnRenamed("page_id", "id")
    v = c.versions.select(F.col("id").alias("current_version_id"), "title", F.length("text").alias("chars"))
    return p.join(v, "current_version_id", "left").join(n, "id", "left").select("id", "url", "depth", "last_fetched", "last_status", F.coalesce("title", F.lit("")).alias("title"), "chars", F.coalesce("versions", F.lit(0)).alias("versions")).orderBy("depth", "url", "id").limit(300)


def _linked(c: Crawl, n: DataFrame) -> DataFrame:
    return c.sites.join(n, "id").select(*site_columns(c.sites), "n").orderBy(F.desc("n"), "id").limit(300)


def links_out(c: Crawl, id_: int) -> DataFrame:
    mine = c.pages.where(F.col("site_id") == id_).select(F.col("id").alias("src_page_id"))
    return _linked(c, c.links.join(mine, "src_page_id", "left_semi").where(F.col("dst_site_id") != id_).groupBy(F.col("dst_site_id").alias("id")).agg(F.count("*").alias("n")))


def links_in(c: Crawl, id_: int) -> DataFrame:
    src = c.pages.select(F.col("id").alias("src_page_id"), "site_id")
    return _linked(c, c.links.where(F.col("dst_site_id") == id_).join(src, "src_page_id").where(F.col("site_id") != id_).groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("n")))


def clearnet(c: Crawl, id_: int) -> DataFrame:
    mine = c.pages.where(F.col("site_id") == id_).select(F.col("id").alias("src_page_id"))
    return c.links.where(~F.col("is_onion")).join(mine, "src_page_id", "left_semi").groupBy(F.col("dst_url").alias("url")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(100)


def site_entities(c: Crawl, id_: int) -> DataFrame:
    mine = c.entities.where(F.col("site_id") == id_).select("kind", "value").distinct()
    n = c.entities.join(mine, ["kind", "value"], "left_semi").groupBy("kind", "value").agg(F.count_distinct("site_id").alias("sites"))
    return n.orderBy(F.desc("sites"), "kind", "value").limit(300)


def shared(c: Crawl, id_: int) -> DataFrame:
    """Other sites that share an entity with this one."""
    mine = c.entities.where((F.col("site_id") == id_) & (F.col("kind") != "onion")).select("kind", "value").distinct()
    x = c.entities.where(F.col("site_id") != id_).join(mine, ["kind", "value"]).groupBy(F.col("site_id").alias("id")).agg(F.count_distinct(F.struct("kind", "value")).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return c.sites.join(x, "id").select(*site_columns(c.sites), "n", "kinds").orderBy(F.desc("n"), "id").limit(50)


def similar(c: Crawl, id_: int, distance: int = 6) -> DataFrame:
    """Sites whose home page's hash differs in at most ``distance`` bits; mine is the hash of the first home page, a scalar subquery."""
    homes = graph.home_pages(c.pages, c.versions)
    mine = homes.where(F.col("id") == id_).agg(F.min_by("simhash", "page_id")).scalar()
    near = homes.where((F.col("id") != id_) & (F.col("chars") >= graph.HOME_CHARS)).withColumn("distance", hamming(F.col("simhash"), mine)).where(F.col("distance") <= distance)
    return c.sites.join(near.select("id", "distance"), "id").select(*site_columns(c.sites), "distance").orderBy("distance", "id").limit(50)


# ---- one page


def page(c: Crawl, id_: int) -> DataFrame:
    s = c.sites.select(F.col("id").alias("site_id"), "onion", F.coalesce("title", F.lit("")).alias("site_title"))
    return c.pages.where(F.col("id") == id_).join(s, "site_id").select("id", "site_id", "onion", "site_title", "url", "depth", "first_fetched", "last_fetched", "last_status", "current_version_id")


def page_versions(c: Crawl, id_: int) -> DataFrame:
    return c.versions.where(F.col("page_id") == id_).select("id", "fetched_at", "http_status", F.coalesce("title", F.lit("")).alias("title"), F.length("text").alias("chars"), hex64(F.col("simhash")).alias("simhash")).orderBy(F.desc("fetched_at"), "id")


def page_version(c: Crawl, id_: int, version: int = 0) -> DataFrame:
    """One version, the current one for 0; no row where it is missing or another page's."""
    v = c.versions.where(F.col("page_id") == id_)
    if version:
        v = v.where(F.col("id") == version)
    else:
        v = v.join(c.pages.where(F.col("id") == id_).select(F.col("current_version_id").alias("id")), "id", "left_semi")
    return v.select("id", "fetched_at", F.coalesce("title", F.lit("")).alias("title"), F.left("text", F.lit(MAX_TEXT)).alias("text"), (F.length("text") > MAX_TEXT).alias("truncated"))


def page_links(c: Crawl, id_: int) -> DataFrame:
    s = c.sites.select(F.col("id").alias("dst_site_id"), F.col("title").alias("t"))
    return c.links.where(F.col("src_page_id") == id_).join(s, "dst_site_id", "left").select(F.col("dst_url").alias("url"), F.coalesce("anchor_text", F.lit("")).alias("anchor"), "is_onion", F.col("dst_site_id").alias("site_id"), F.coalesce("t", F.lit("")).alias("site_title")).limit(2000)


def page_entities(c: Crawl, id_: int) -> DataFrame:
    v = c.pages.where(F.col("id") == id_).select(F.col("current_version_id").alias("page_version_id"))
    return c.entities.join(v, "page_version_id", "left_semi").select("kind", "value").orderBy("kind", "value")


# ---- entities


def entities(c: Crawl, kind: str = "", q: str = "", offset=0) -> DataFrame:
    e = c.entities
    if kind:
        e = e.where(F.col("kind") == kind)
    if q := q.strip():
        e = e.where(F.col("value").ilike(f"%{q}%"))
    return e.groupBy("kind", "value").agg(F.count_distinct("site_id").alias("sites"), F.count("*").alias("mentions")).orderBy(F.desc("sites"), F.desc("mentions"), "value", "kind").offset(clamp(offset, 0, MAX_OFFSET)).limit(ENTITY_PAGE)


def entity(c: Crawl, kind: str, value: str) -> DataFrame:
    e = c.entities.where((F.col("kind") == kind) & (F.col("value") == value)).select("page_version_id", "site_id")
    v = c.versions.select(F.col("id").alias("page_version_id"), "page_id", "fetched_at")
    x = e.join(v, "page_version_id").groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("pages"), F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"), F.min("page_id").alias("page_id"))
    return c.sites.drop("first_seen", "last_seen").join(x, "id").select(*[F.col("id"), F.col("onion"), F.coalesce("title", F.lit("")).alias("title"), F.col("status")], "pages", "first_seen", "last_seen", "page_id").orderBy(F.desc("pages"), "id").limit(500)


# ---- graph


def graph_nodes(c: Crawl, ids: DataFrame) -> DataFrame:
    s = graph.with_degrees(c.sites.join(ids.select("id"), "id", "left_semi"), c.edges).join(c.analysis.select(F.col("site_id").alias("id"), "component"), "id", "left")
    return s.select("id", "onion", F.coalesce("title", F.lit("")).alias("title"), "status", "indeg", "outdeg", "component")


def graph_ids(c: Crawl, site: int = 0, hops=1, most=250) -> DataFrame:
    most = clamp(most, 250, 1500)
    return graph.neighbourhood(c.edges, site, clamp(hops, 1, 2), most).select("id") if site > 0 else graph.best_connected(c.edges, most)


def graph_edges(c: Crawl, ids: DataFrame) -> DataFrame:
    return graph.induced(c.edges, c.sites.select("id").join(ids.select("id"), "id", "left_semi"))


def cluster_sites(c: Crawl) -> DataFrame:
    """The sites of every cluster, a row each."""
    each = graph.home_clusters(c.pages, c.versions).select("root", "size", "exact", F.explode("ids").alias("id"))
    return c.sites.join(each, "id").select(*site_columns(c.sites), "root", "size", "exact").orderBy(F.desc("size"), "root", "id")


def clusters(c: Crawl) -> DataFrame:
    return graph.home_clusters(c.pages, c.versions).orderBy(F.desc("size"), "root")


# ---- analytics


def per_day(df: DataFrame, ts: str) -> DataFrame:
    """Rows per day and their running total; the window runs over one row per day."""
    days = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("total", F.sum("n").over(Window.orderBy("day").rangeBetween(Window.unboundedPreceding, 0))).orderBy("day")


_SHOWN = {"ok": "ok", "http_error": "http_error", "offline": "desc_not_found", "timeout": "timeout"}


def outcomes_7d(c: Crawl) -> DataFrame:
    o = F.col("outcome")
    return c.since("7 DAYS").groupBy(truncated("hour", F.col("ts")).alias("t")).agg(*[F.count_if(o == v).alias(k) for k, v in _SHOWN.items()], F.count_if(~o.isin(*_SHOWN.values())).alias("other")).orderBy("t")


def latency_3d(c: Crawl) -> DataFrame:
    """Exact percentiles, interpolated, of the latency of answered fetches per hour."""
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    x = c.since("3 DAYS").where("outcome = 'ok' AND latency_ms IS NOT NULL").groupBy(truncated("hour", F.col("ts")).alias("t")).agg(p.alias("p"))
    return x.select("t", *[F.round(F.col("p")[i], 6).alias(k) for i, k in enumerate(("p50", "p90", "p99"))]).orderBy("t")


def entity_kinds(c: Crawl) -> DataFrame:
    return c.entities.groupBy("kind").agg(F.count_distinct("value").alias("distinct"), F.count_distinct("site_id").alias("sites")).orderBy(F.desc("distinct"), "kind")


def depth(c: Crawl) -> DataFrame:
    return c.pages.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth")


#: Buckets of pages per site.
SIZE_BUCKETS = (("0", 0), ("1", 1), ("2-5", 5), ("6-20", 20), ("21-100", 100))


def site_sizes(c: Crawl) -> DataFrame:
    n = F.col("pages_fetched")
    bucket = F.lit("100+")
    ordinal = F.lit(len(SIZE_BUCKETS))
    for i, (name, most) in reversed(list(enumerate(SIZE_BUCKETS))):
        bucket, ordinal = F.when(n <= most, name).otherwise(bucket), F.when(n <= most, i).otherwise(ordinal)
    return c.sites.groupBy(bucket.alias("bucket"), ordinal.alias("ord")).agg(F.count("*").alias("sites")).orderBy("ord").select("bucket", "sites")


def graph_counts(c: Crawl) -> DataFrame:
    a = c.analysis
    at = F.max("updated_at") if "updated_at" in a.columns else F.lit(None).cast("timestamp_ntz")
    counts = a.agg(F.count("*").alias("analysed"), F.count_distinct("component").alias("components"), F.count_distinct("operator").alias("operators"), at.alias("at"))
    return counts.select("analysed", "components", "operators", F.coalesce("at", c.as_of).alias("updated_at"))  # computed now where it isn't stored


def top_rank(c: Crawl, n: int = 25) -> DataFrame:
    s = graph.with_degrees(c.sites, c.edges).join(c.analysis.select(F.col("site_id").alias("id"), "pagerank"), "id")
    return s.select("id", "onion", F.coalesce("title", F.lit("")).alias("title"), "status", F.round("pagerank", 9).alias("pagerank"), "indeg").orderBy(F.desc("pagerank"), "id").limit(n)


def _groups(c: Crawl, by: str, n: int) -> DataFrame:
    """Sites per group, and the name of the member of the highest rank; equal ranks, to 9 digits, by the least id."""
    named = c.sites.select(F.col("id").alias("site_id"), F.coalesce("title", "onion").alias("name"))
    best = F.max_by("name", F.struct(F.round("pagerank", 9), -F.col("site_id")))
    return c.analysis.where(F.col(by).isNotNull()).join(named, "site_id").groupBy(by).agg(F.count("*").alias("sites"), best.alias("top")).orderBy(F.desc("sites"), by).limit(n)


def top_components(c: Crawl) -> DataFrame:
    return _groups(c, "component", 15)


def top_operators(c: Crawl) -> DataFrame:
    kinds = c.entities.where("kind <> 'onion'").join(c.analysis.where("operator IS NOT NULL").select("site_id", "operator"), "site_id").groupBy("operator").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return _groups(c, "operator", 25).join(kinds, "operator", "left").select("operator", "sites", "top", "kinds").orderBy(F.desc("sites"), "operator")


#: Fixed values, for the oracles.
ALIVE_SQL = "(" + ", ".join(f"'{x}'" for x in ALIVE) + ")"
