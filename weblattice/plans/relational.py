"""Single operators over the crawl's tables, each under the name it has in the inventory, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weblattice.functions import display, entities as ent, fetching, hashing, html, onion, terms
from weblattice.operators import graph, metrics, predicates as pr, search, state
from weblattice.plans import explore as x
from weblattice.plans.crawl import AS_OF, EDGES, LIVE, Crawl, truncated
from weblattice.plans.explore_queries import SITE_SIZES
from weblattice.session import cut
from weblattice.sources import lists, snapshots
from weblattice.sources.tables import spread

_BLOCKED = "substr(md5(onion), 1, 1) IN ('0', '1')"
_SHARED = "(SELECT DISTINCT kind, value, site_id FROM entities WHERE kind IN ('pgp', 'email'))"


def _as_of(c: Crawl):
    return c.log.agg(F.max("ts")).scalar()


def _blocklist(c: Crawl) -> DataFrame:
    """A stand-in list: the hashes of the sites whose own begins with 0 or 1."""
    return c.sites.select(F.md5("onion").alias("md5")).where("substr(md5, 1, 1) IN ('0', '1')")


def _queue(c: Crawl) -> tuple[DataFrame, DataFrame]:
    """(sites, frontier) made from the tables: every page is queued, its depth the priority."""
    s = c.sites.withColumn("next_check_at", F.col("last_seen")).withColumn("next_allowed_at", F.coalesce("last_seen", "first_seen")).withColumn("lease_until", F.col("first_seen"))
    f = c.pages.select("url_hash", "url", "site_id", "depth", (F.col("depth") + 2).alias("priority"), F.col("last_fetched").alias("next_fetch_at"), F.when(F.col("last_status") == 200, 0).otherwise(1).alias("attempts"))
    return s, f


def _captures(c: Crawl) -> DataFrame:
    """(id, page_id, site_id, url, body): each current version as the HTML it may have come from."""
    e = lambda col: F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    d = search.documents(c.pages, c.versions)
    lines = F.concat(F.lit("<p>"), F.replace(e(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit("</p><script>x()</script><p onclick=\"y()\">")), F.lit("</p>"))
    return d.select("page_id", "site_id", "url", F.concat(F.lit("<html><head><title>"), e(F.coalesce("title", F.lit(""))), F.lit("</title></head><body><!-- c -->"), lines, F.lit("<a href=\"/x?b=2&amp;a=1#f\">next <b>page</b></a></body></html>")).alias("body"))


def html_text(c: Crawl) -> DataFrame:
    p = _captures(c).select("page_id", html.sanitized("body").alias("p"))
    return p.select("page_id", "p.title", "p.text", F.size("p.links").alias("n_links"), F.col("p.html").rlike("(?i)<script|onclick|<!--").alias("unsafe"))


def html_links(c: Crawl) -> DataFrame:
    p = _captures(c).select("page_id", "url", F.posexplode(html.sanitized("body")["links"]).alias("pos", "link"))
    return p.select("page_id", "pos", F.col("link.url").alias("raw"), F.col("link.anchor").alias("anchor"), onion.canonical_any(F.col("link.url"), F.col("url")).alias("url"))


def text_entities(c: Crawl) -> DataFrame:
    return spread(c.versions.select("id", "text")).select("id", F.explode(ent.text_entities(F.col("text"))).alias("e")).select("id", "e.kind", "e.value")


def full_align(c: Crawl) -> DataFrame:
    """Series by outcome on one time axis; no fetch is null."""
    names = ["ok", "http_error", "timeout", "desc_not_found"]
    hourly = c.since("3 DAYS").groupBy(truncated("hour", F.col("ts")).alias("t"), "outcome").agg(F.count("*").alias("n"))
    return hourly.groupBy("t").pivot("outcome", names).agg(F.first("n"))


def stacked(c: Crawl) -> DataFrame:
    """Each series on top of those before it, in the order of their names."""
    hourly = c.since("3 DAYS").groupBy(truncated("hour", F.col("ts")).alias("t"), "outcome").agg(F.count("*").alias("n"))
    w = Window.partitionBy("t").orderBy("outcome").rowsBetween(Window.unboundedPreceding, 0)
    return hourly.select("t", "outcome", F.sum("n").over(w).alias("top"))


def top_page_per_site(c: Crawl) -> DataFrame:
    """The best page of each site by depth, then by time."""
    return c.pages.groupBy("site_id").agg(F.min_by("id", F.struct("depth", "first_fetched", "id")).alias("page_id"))


def shared_pairs(c: Crawl) -> DataFrame:
    """Sites that share a key or mailbox, the pair counted once, hub values left out."""
    e = c.entities.where("kind IN ('pgp', 'email')").select("kind", "value", "site_id").distinct()
    few = e.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 18").select("kind", "value")
    e = e.join(few, ["kind", "value"])
    a, b = e.withColumnRenamed("site_id", "a"), e.withColumnRenamed("site_id", "b")
    return a.join(b, ["kind", "value"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def snapshot_upsert(c: Crawl) -> DataFrame:
    """Pages with those of depth 0 marked as fetched again."""
    new = c.pages.where("depth = 0").withColumn("last_status", F.lit(299))
    return snapshots.upsert(c.pages, new, ["id"]).select("id", "last_status")


def snapshot_insert(c: Crawl) -> DataFrame:
    known = c.sites.where("id % 2 = 0").select("id", "onion")
    return snapshots.insert_ignore(known, c.sites.select("id", "onion"), ["id"])


def _sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_WORDS = ("mirror", "archive")
_TERMS = ["# neutral terms", "second floor", "old team", "~lantern"]
_FOLD = r"trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'), ' +', ' ', 'g'))"
_TIDY = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+', ' ', 'g'))), lambda l: l <> ''), chr(10))"
_SQUEEZE = "trim(regexp_replace(coalesce(title, ''), '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+', ' ', 'g'))"
_QUEUE = "q AS (SELECT url_hash, url, site_id, depth, depth + 2 AS priority, last_fetched AS next_fetch_at, CASE WHEN last_status = 200 THEN 0 ELSE 1 END AS attempts FROM pages)"
_ALIVE = _sql_list(fetching.ALIVE)
_LAST_DAY = "WHERE date_trunc('minute', ts) > (SELECT max(date_trunc('minute', ts)) FROM fetch_log) - INTERVAL 24 HOUR"
#: Rates over five minutes of counters with a sample per minute; a series' first sample has no increase.
_RATES = """m AS (SELECT date_trunc('minute', ts) AS ts, coalesce(outcome, '') AS outcome, coalesce(proxy, '') AS proxy, count(*) AS n FROM fetch_log {where} GROUP BY 1, 2, 3),
i AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY outcome, proxy ORDER BY ts) = 1 THEN 0 ELSE n END AS inc, CAST(epoch(ts) AS BIGINT) AS sec FROM m),
r AS (SELECT *, sum(inc) OVER (PARTITION BY outcome, proxy ORDER BY sec RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) / 300.0 AS rate FROM i)"""
_QUANTILE = f"""WITH b AS (SELECT unnest({[0.0, *metrics.BUCKETS]}) AS lo, unnest({[*metrics.BUCKETS, 1e300]}) AS hi),
n AS (SELECT coalesce(outcome, '') AS outcome, lo, hi, count(*) FILTER (WHERE latency_ms / 1000.0 <= hi) AS cum, count(*) FILTER (WHERE latency_ms / 1000.0 <= lo) AS below, count(*) AS total FROM fetch_log CROSS JOIN b WHERE latency_ms IS NOT NULL GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN lo = 0 THEN 0 ELSE below END AS under, row_number() OVER (PARTITION BY outcome ORDER BY hi) AS rn FROM n WHERE cum >= 0.9 * total)
SELECT outcome, round(CASE WHEN hi > 1e299 THEN lo ELSE lo + (hi - lo) * (0.9 * total - under) / (cum - under) END, 9) AS value FROM f WHERE rn = 1"""
_BM25 = r"""WITH d AS (SELECT p.id AS page_id, v.title, v.text FROM pages p JOIN page_versions v ON v.id = p.current_version_id),
w AS (SELECT page_id, 'title' AS field, 3.0 AS boost, regexp_extract_all(lower(title), '[\p{L}\p{Nd}]+') AS ws FROM d UNION ALL SELECT page_id, 'text', 1.0, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') FROM d),
l AS (SELECT *, len(ws) AS length FROM w WHERE len(ws) > 0), st AS (SELECT field, count(*) AS n, avg(length) AS mean FROM l GROUP BY 1),
h AS (SELECT page_id, field, boost, length, t.term, len(list_filter(ws, lambda x: x = t.term)) AS tf FROM l CROSS JOIN (VALUES ('mirror'), ('archive')) t(term) WHERE list_contains(ws, t.term)),
df AS (SELECT field, term, count(*) AS df FROM h GROUP BY 1, 2),
s AS (SELECT page_id, field, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM h JOIN df USING (field, term) JOIN st USING (field) GROUP BY 1, 2),
b AS (SELECT page_id, round(max(score), 6) AS score FROM s GROUP BY 1)
SELECT page_id, score, (SELECT count(*) FROM b) AS total FROM b ORDER BY score DESC, page_id LIMIT 25"""
#: What _saved() captures: known pages, and a new one of each site. Texts are the same where their hash is.
_CAUGHT = "caught AS (SELECT p.url, p.site_id, p.depth, coalesce(v.text, '') || CASE WHEN p.depth <= 1 THEN chr(10) || 'more' ELSE '' END AS text, sha256(coalesce(v.text, '') || CASE WHEN p.depth <= 1 THEN chr(10) || 'more' ELSE '' END) IS DISTINCT FROM lower(hex(v.text_hash)) AS changed FROM pages p JOIN page_versions v ON v.id = p.current_version_id JOIN sites s ON s.id = p.site_id), fresh AS (SELECT 'http://' || onion || '.onion/brand-new' AS url, id AS site_id FROM sites)"
_COUNTED = "n AS (SELECT date_trunc('hour', ts) AS t, outcome, count(*) AS n FROM fetch_log WHERE ts > (SELECT max(ts) FROM fetch_log) - INTERVAL 3 DAY GROUP BY 1, 2)"


def _routed(c: Crawl, term: str = "lantern") -> DataFrame:
    """The sites to purge of those whose pages hold a term."""
    return state.route(c.versions.join(c.pages.select(F.col("id").alias("page_id"), "site_id"), "page_id").withColumn("outcome", F.lit("ok")), F.lower("text").contains(term))


_ALL = {
    # sources and sinks
    "src_query": (lambda c: c.spark.sql("SELECT id, url FROM {p} WHERE depth = :depth", args={"depth": 1}, p=c.pages), "SELECT id, url FROM pages WHERE depth = 1"),
    "src_seed_list": (lambda c: c.sites.select(F.explode(onion.extract_addresses(F.concat(F.lit("see HTTP://www."), F.col("onion"), F.lit(".onion/ and x.onion")))).alias("address")).distinct(), "SELECT DISTINCT onion AS address FROM sites"),
    "src_blocklist": (lambda c: lists.block_hashes(c.sites.select(F.concat(F.lit(" "), F.upper(F.md5("onion"))).alias("value")).unionByName(c.sites.select(F.col("onion").alias("value")))), "SELECT DISTINCT md5(onion) AS md5 FROM sites"),
    "src_filter_terms": (lambda c: _terms(c), "SELECT * FROM (VALUES ('phrase', 'second floor'), ('phrase', 'old team'), ('part', 'lantern')) t(kind, term)"),
    "snk_upsert": (snapshot_upsert, "SELECT id, CASE WHEN depth = 0 THEN 299 ELSE last_status END AS last_status FROM pages"),
    "snk_insert_ignore": (snapshot_insert, "SELECT id, onion FROM sites"),
    "snk_blob": (lambda c: snapshots.blobs(c.versions.select(F.col("text").alias("html"))).select(F.lower(F.hex("hash")).alias("hash"), F.length("html").alias("n")), "SELECT DISTINCT sha256(text) AS hash, strlen(text) AS n FROM page_versions WHERE text IS NOT NULL"),
    "snk_report": (lambda c: state.report(c.sites.where("id % 3 = 0").select(F.col("id").alias("site_id"), F.lit("filter").alias("reason")), c.sites, _as_of(c)), f"SELECT onion || '.onion' AS address, {AS_OF} AS ts FROM sites WHERE id % 3 = 0"),
    "snk_prom": (lambda c: metrics.from_log(c.log).groupBy("metric", F.to_json(F.array_sort(F.map_entries("labels"))).alias("series")).agg(F.max("value").alias("value")).groupBy("metric").agg(F.sum("value").alias("value"), F.count("*").alias("n")), f"SELECT 'crawler_fetches_total' AS metric, CAST(count(*) AS DOUBLE) AS value, count(DISTINCT (coalesce(outcome, ''), coalesce(proxy, ''))) AS n FROM fetch_log UNION ALL SELECT 'crawler_fetch_duration_seconds_bucket', CAST(sum(len(list_filter({list(metrics.BUCKETS)}, lambda b: latency_ms / 1000.0 <= b)) + 1) AS DOUBLE), count(DISTINCT outcome) * {len(metrics.BUCKETS) + 1} FROM fetch_log WHERE latency_ms IS NOT NULL"),
    "snk_delete_by_query": (lambda c: search.delete_site(search.inverted(search.documents(c.pages, c.versions)), search.documents(c.pages, c.versions), 1)[1].select("page_id"), "SELECT p.id AS page_id FROM pages p JOIN page_versions v ON v.id = p.current_version_id WHERE p.site_id <> 1"),
    "snk_delete_postings": (lambda c: search.delete_site(search.inverted(search.documents(c.pages, c.versions)), search.documents(c.pages, c.versions), 1)[0], None),
    "snk_report_routed": (lambda c: state.report(_routed(c), c.sites, _as_of(c)), None),
    # predicates
    "p_site_cols": (lambda c: c.sites.select(*x.site_columns(c.sites)), "SELECT id, onion, coalesce(title, '') AS title, status FROM sites"),
    "p_optional": (lambda c: c.pages.where(pr.all_of(pr.optional("depth", 1), pr.optional("url", ""), pr.optional("site_id", -1))).select("id"), "SELECT id FROM pages WHERE depth = 1"),
    "p_ilike": (lambda c: c.sites.where(pr.contains_any_case("title", "THE _")).select("id"), "SELECT id FROM sites WHERE title ILIKE '%THE _%'"),
    "p_prefix": (lambda c: c.sites.where(F.col("onion").startswith("a")).select("id"), "SELECT id FROM sites WHERE onion LIKE 'a%'"),
    "p_time_window": (lambda c: c.log.where(pr.within("ts", _as_of(c), "7 DAYS")).groupBy("site_id").agg(F.count("*").alias("n")), f"SELECT site_id, count(*) AS n FROM fetch_log WHERE ts > {AS_OF} - INTERVAL 7 DAY GROUP BY 1"),
    "p_in_set": (lambda c: c.log.where(fetching.is_alive(F.col("outcome"))).groupBy("outcome").agg(F.count("*").alias("n")), f"SELECT outcome, count(*) AS n FROM fetch_log WHERE outcome IN {_ALIVE} GROUP BY 1"),
    "p_not_in": (lambda c: c.log.where(~F.col("http_status").isin(200, 404)).groupBy("http_status").agg(F.count("*").alias("n")), "SELECT http_status, count(*) AS n FROM fetch_log WHERE http_status NOT IN (200, 404) GROUP BY 1"),
    "p_any_array": (lambda c: pr.any_of(c.pages, "site_id", range(1, 40), small=20).select("id"), "SELECT id FROM pages WHERE site_id BETWEEN 1 AND 39"),
    "p_in_subq": (lambda c: pr.on_blocklist(c.sites, _blocklist(c)).select("id"), f"SELECT id FROM sites WHERE {_BLOCKED}"),
    "p_exists": (lambda c: c.sites.join(c.pages.where("depth >= 2").select(F.col("site_id").alias("id")), "id", "left_semi").select("id"), "SELECT id FROM sites s WHERE EXISTS (SELECT 1 FROM pages p WHERE p.site_id = s.id AND p.depth >= 2)"),
    "p_not_exists": (lambda c: c.pages.join(c.links.select(F.col("src_page_id").alias("id")), "id", "left_anti").select("id"), "SELECT id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.src_page_id = p.id)"),
    "p_distinct_from": (lambda c: c.sites.where(pr.differs("last_seen", "last_ok")).select("id"), "SELECT id FROM sites WHERE last_seen IS DISTINCT FROM last_ok"),
    "p_case": (lambda c: c.log.groupBy(F.when(F.col("latency_ms").isNull(), "none").when(F.col("latency_ms") < 1000, "fast").when(F.col("latency_ms") < 5000, "slow").otherwise("worst").alias("speed")).agg(F.count("*").alias("n")), "SELECT CASE WHEN latency_ms IS NULL THEN 'none' WHEN latency_ms < 1000 THEN 'fast' WHEN latency_ms < 5000 THEN 'slow' ELSE 'worst' END AS speed, count(*) AS n FROM fetch_log GROUP BY 1"),
    "p_nullif_coalesce": (lambda c: c.links.groupBy(F.coalesce(F.nullif("anchor_text", F.lit("")), F.lit("none")).alias("anchor")).agg(F.count("*").alias("n")), "SELECT coalesce(nullif(anchor_text, ''), 'none') AS anchor, count(*) AS n FROM links GROUP BY 1"),
    "p_regex_check": (lambda c: c.sites.where(F.col("onion").rlike(onion.ADDRESS)).select("id"), "SELECT id FROM sites WHERE regexp_full_match(onion, '[a-z2-7]{56}')"),
    # joins
    "j_inner": (lambda c: c.entities.join(c.versions.select(F.col("id").alias("page_version_id"), "page_id"), "page_version_id").join(c.pages.select(F.col("id").alias("page_id"), "url"), "page_id").select("kind", "value", "url"), "SELECT e.kind, e.value, p.url FROM entities e JOIN page_versions v ON v.id = e.page_version_id JOIN pages p ON p.id = v.page_id"),
    "j_left": (lambda c: c.pages.join(c.versions.select(F.col("id").alias("current_version_id"), "http_status"), "current_version_id", "left").select("id", "http_status"), "SELECT p.id, v.http_status FROM pages p LEFT JOIN page_versions v ON v.id = p.current_version_id"),
    "j_semi": (lambda c: c.versions.join(c.pages.select(F.col("current_version_id").alias("id")), "id", "left_semi").select("id"), "SELECT id FROM page_versions WHERE id IN (SELECT current_version_id FROM pages)"),
    "j_anti": (lambda c: c.versions.join(c.pages.select(F.col("current_version_id").alias("id")), "id", "left_anti").select("id"), "SELECT id FROM page_versions v WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.current_version_id = v.id)"),
    "j_using": (lambda c: c.entities.join(c.entities.where("site_id = 1").select("kind", "value").distinct(), ["kind", "value"]).groupBy("kind", "value").agg(F.count("*").alias("n")), "SELECT kind, value, count(*) AS n FROM entities JOIN (SELECT DISTINCT kind, value FROM entities WHERE site_id = 1) USING (kind, value) GROUP BY 1, 2"),
    "j_self": (shared_pairs, f"WITH e AS {_SHARED}, few AS (SELECT kind, value FROM e GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 18) SELECT a.site_id AS a, b.site_id AS b, count(*) AS n FROM e a JOIN few USING (kind, value) JOIN e b USING (kind, value) WHERE a.site_id < b.site_id GROUP BY 1, 2"),
    "j_lateral_top1": (top_page_per_site, "SELECT site_id, min_by(id, (depth, first_fetched, id)) AS page_id FROM pages GROUP BY 1"),
    "j_scalar_subq": (x.totals, f"WITH {EDGES} SELECT (SELECT count(*) FROM sites) AS sites, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM page_versions) AS versions, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM edges) AS edges, CAST(0 AS BIGINT) AS frontier"),
    "j_corr_count": (lambda c: c.pages.join(c.versions.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")), "SELECT id, (SELECT count(*) FROM page_versions v WHERE v.page_id = p.id) AS n FROM pages p"),
    "j_corr_top1": (lambda c: c.versions.groupBy("page_id").agg(F.max_by(F.coalesce("title", F.lit("")), F.struct("fetched_at", "id")).alias("title")), "SELECT page_id, max_by(coalesce(title, ''), (fetched_at, id)) AS title FROM page_versions GROUP BY 1"),
    "j_delete_using": (lambda c: state.trim_capped(*_queue(c), cap=3).select(F.lower(F.hex("url_hash")).alias("url_hash")), f"WITH {_QUEUE} SELECT hex(url_hash).lower() AS url_hash FROM q WHERE priority <= 1 OR site_id NOT IN (SELECT id FROM sites WHERE pages_fetched >= 3)"),
    "j_update_from": (lambda c: c.sites.join(top_page_per_site(c).withColumnRenamed("site_id", "id"), "id", "left").select("id", F.when(F.col("page_id").isNotNull(), F.lit(0)).otherwise(F.col("consecutive_failures")).alias("consecutive_failures")), "SELECT id, CASE WHEN id IN (SELECT site_id FROM pages) THEN 0 ELSE consecutive_failures END AS consecutive_failures FROM sites"),
    "j_full_align": (full_align, f"WITH {_COUNTED} SELECT t, max(n) FILTER (WHERE outcome = 'ok') AS ok, max(n) FILTER (WHERE outcome = 'http_error') AS http_error, max(n) FILTER (WHERE outcome = 'timeout') AS timeout, max(n) FILTER (WHERE outcome = 'desc_not_found') AS desc_not_found FROM n GROUP BY 1"),
    # aggregates and windows
    "a_count_group": (lambda c: c.log.groupBy("outcome", "proxy").agg(F.count("*").alias("n")), "SELECT outcome, proxy, count(*) AS n FROM fetch_log GROUP BY 1, 2"),
    "a_count_filter": (lambda c: c.log.groupBy("site_id").agg(F.count_if(F.col("outcome") == "ok").alias("ok"), F.count("latency_ms").alias("timed")), "SELECT site_id, count(*) FILTER (WHERE outcome = 'ok') AS ok, count(latency_ms) AS timed FROM fetch_log GROUP BY 1"),
    "a_count_distinct": (lambda c: c.log.groupBy("site_id").agg(F.count_distinct("url_hash").alias("urls"), F.count_distinct("proxy").alias("proxies")), "SELECT site_id, count(DISTINCT url_hash) AS urls, count(DISTINCT proxy) AS proxies FROM fetch_log GROUP BY 1"),
    "a_count_distinct_row": (lambda c: c.entities.groupBy("site_id").agg(F.count_distinct(F.struct("kind", "value")).alias("n")), "SELECT site_id, count(DISTINCT (kind, value)) AS n FROM entities GROUP BY 1"),
    "a_minmax": (lambda c: c.versions.groupBy("page_id").agg(F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last")), "SELECT page_id, min(fetched_at) AS first, max(fetched_at) AS last FROM page_versions GROUP BY 1"),
    "a_array_agg_distinct": (lambda c: _gathered(c), "SELECT kind, value, list_sort(list(DISTINCT site_id)) AS sites FROM entities WHERE kind IN ('pgp', 'email') GROUP BY 1, 2 HAVING count(DISTINCT site_id) BETWEEN 2 AND 18"),
    "a_string_agg_distinct": (lambda c: c.entities.groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")), "SELECT site_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM entities GROUP BY 1"),
    "a_last_by": (lambda c: c.log.groupBy("site_id").agg(F.max_by("outcome", F.struct("ts", "outcome")).alias("last")), "SELECT site_id, max_by(outcome, (ts, outcome)) AS last FROM fetch_log GROUP BY 1"),
    "a_percentile_cont": (lambda c: c.log.where("latency_ms IS NOT NULL").groupBy("outcome").agg(F.round(F.percentile("latency_ms", 0.5), 6).alias("p50"), F.round(F.percentile("latency_ms", 0.99), 6).alias("p99")), "SELECT outcome, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM fetch_log WHERE latency_ms IS NOT NULL GROUP BY 1"),
    "a_sum_over": (lambda c: x.per_day(c.log, "ts"), "SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM fetch_log GROUP BY 1)"),
    "a_histogram_bucket": (x.site_sizes, SITE_SIZES),
    "a_share": (lambda c: c.log.groupBy("outcome").agg(F.count("*").alias("n")).select("outcome", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("share"), F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 9).alias("bar")), "SELECT outcome, round(n / sum(n) OVER (), 9) AS share, round(n / max(n) OVER (), 9) AS bar FROM (SELECT outcome, count(*) AS n FROM fetch_log GROUP BY 1)"),
    "a_having": (lambda c: c.links.groupBy("dst_site_id").agg(F.count("*").alias("n")).where("n > 10"), "SELECT dst_site_id, count(*) AS n FROM links GROUP BY 1 HAVING count(*) > 10"),
    "a_pk_dep_group": (lambda c: c.log.groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("n")).join(c.sites.select("id", "onion", "status"), "id"), "SELECT s.id, s.onion, s.status, count(*) AS n FROM fetch_log f JOIN sites s ON s.id = f.site_id GROUP BY ALL"),
    "w_running_total": (lambda c: x.per_day(c.versions, "fetched_at"), "SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM (SELECT CAST(fetched_at AS DATE) AS day, count(*) AS n FROM page_versions GROUP BY 1)"),
    "w_stack": (stacked, f"WITH {_COUNTED} SELECT t, outcome, CAST(sum(n) OVER (PARTITION BY t ORDER BY outcome ROWS UNBOUNDED PRECEDING) AS BIGINT) AS top FROM n"),
    "w_top1_per_group": (lambda c: snapshots.latest(c.versions, ["page_id"], ["fetched_at", "id"]).select("page_id", "id"), "SELECT page_id, max_by(id, (fetched_at, id)) AS id FROM page_versions GROUP BY 1"),
    # order, limits and sets
    "o_topk_agg": (lambda c: c.log.groupBy("site_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site_id").limit(15), "SELECT site_id, count(*) AS n FROM fetch_log GROUP BY 1 ORDER BY n DESC, site_id LIMIT 15"),
    "o_nulls_last": (lambda c: c.sites.orderBy(F.desc_nulls_last("last_ok"), "id").select("id", "last_ok").limit(100), "SELECT id, last_ok FROM sites ORDER BY last_ok DESC NULLS LAST, id LIMIT 100"),
    "o_bool_order": (lambda c: c.sites.orderBy(F.desc(F.col("title").isNull()), "first_seen", "id").select("id").limit(30), "SELECT id FROM sites ORDER BY (title IS NULL) DESC, first_seen, id LIMIT 30"),
    "o_offset": (lambda c: c.pages.orderBy("url", "id").offset(x.clamp("7", 0, 10)).limit(20).select("id"), "SELECT id FROM pages ORDER BY url, id LIMIT 20 OFFSET 7"),
    "s_union_all": (lambda c: c.edges.select(F.col("src_site_id").alias("id")).unionByName(c.edges.select(F.col("dst_site_id").alias("id"))).groupBy("id").agg(F.count("*").alias("n")), f"WITH {EDGES} SELECT id, count(*) AS n FROM (SELECT src_site_id AS id FROM edges UNION ALL SELECT dst_site_id FROM edges) GROUP BY 1"),
    "s_distinct": (lambda c: c.entities.select("kind", "value").distinct(), "SELECT DISTINCT kind, value FROM entities"),
    "s_dedupe_first": (lambda c: c.pages.select("id", F.array_join(F.array_distinct(F.split("url", "")), "").alias("letters")), "SELECT id, array_to_string(list_distinct_first, '') AS letters FROM (SELECT id, list_filter(string_split(url, ''), lambda x, i: list_position(string_split(url, ''), x) = i) AS list_distinct_first FROM pages)"),
    # functions
    "f_md5_pair": (lambda c: c.sites.select("id", F.array_join(hashing.md5_pair(F.col("onion")), ",").alias("md5")), "SELECT id, md5(onion || '.onion') || ',' || md5(onion) AS md5 FROM sites"),
    "f_sha256": (lambda c: c.versions.select("id", F.lower(F.hex(hashing.sha256(F.col("text")))).alias("h"), (hashing.sha256(F.col("text")) == F.col("text_hash")).alias("same")), "SELECT id, sha256(text) AS h, sha256(text) = hex(text_hash).lower() AS same FROM page_versions"),
    "f_url_hash": (lambda c: c.pages.select("id", F.lower(F.hex(hashing.url_hash(F.col("url")))).alias("h")), "SELECT id, left(sha256(url), 32) AS h FROM pages"),
    "f_fnv1a64": (lambda c: c.sites.select("id", hashing.fnv1a64("onion").alias("h")), "SELECT id, CAST(CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE CAST(u AS HUGEINT) END AS BIGINT) AS h FROM (SELECT id, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(onion, ''), lambda c: ord(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS u FROM sites)"),
    "f_simhash": (lambda c: spread(c.versions.select("id", "text")).select("id", hashing.simhash("text").alias("simhash")), None),
    "f_hamming": (lambda c: c.versions.select("id", hashing.hamming(F.col("simhash"), F.lit(-1)).alias("bits")), "SELECT id, bit_count(xor(simhash, CAST(-1 AS BIGINT))) AS bits FROM page_versions"),
    "f_hex64": (lambda c: c.versions.select("id", hashing.hex64(F.col("simhash")).alias("h")), "SELECT id, lower(printf('%016x', simhash)) AS h FROM page_versions"),
    "f_valid_v3": (lambda c: c.sites.select("id", onion.valid_address("onion").alias("valid"), onion.valid_address(F.reverse("onion")).alias("reversed")), None),
    "f_extract_addr": (lambda c: c.versions.select("id", F.explode(onion.extract_addresses("text")).alias("address")), None),
    "f_host": (lambda c: c.pages.select("id", onion.url_address("url").alias("address")), "SELECT p.id, s.onion AS address FROM pages p JOIN sites s ON s.id = p.site_id"),
    "f_canonical": (lambda c: c.links.select(onion.canonical_any("dst_url", F.lit(None).cast("string")).alias("url"), onion.canonical_onion("dst_url", F.lit(None).cast("string"))["address"].alias("address")).groupBy("url", "address").agg(F.count("*").alias("n")), None),
    "f_sanitize_html": (html_text, f"SELECT p.id AS page_id, {_SQUEEZE} AS title, CASE WHEN coalesce(text, '') = '' THEN '' ELSE {_TIDY} || chr(10) END || 'next page' AS text, CAST(1 AS INTEGER) AS n_links, false AS unsafe FROM pages p JOIN page_versions v ON v.id = p.current_version_id"),
    "f_html_links": (html_links, "SELECT p.id AS page_id, CAST(0 AS INTEGER) AS pos, '/x?b=2&a=1#f' AS raw, 'next page' AS anchor, regexp_extract(url, '^https?://[^/]+') || '/x?a=1&b=2' AS url FROM pages p WHERE current_version_id IN (SELECT id FROM page_versions)"),
    "f_entities": (text_entities, r"""WITH t AS (SELECT id, text FROM page_versions WHERE text IS NOT NULL)
SELECT DISTINCT id, kind, value FROM (SELECT id, 'btc' AS kind, unnest(regexp_extract_all(lower(text), '\bbc1[ac-hj-np-z02-9]{11,71}\b')) AS value FROM t
UNION ALL SELECT id, 'btc', unnest(regexp_extract_all(text, '\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b')) FROM t UNION ALL SELECT id, 'xmr', unnest(regexp_extract_all(text, '\b[48][0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b')) FROM t
UNION ALL SELECT id, 'eth', lower(unnest(regexp_extract_all(text, '\b0x[a-fA-F0-9]{40}\b'))) FROM t UNION ALL SELECT id, 'email', lower(unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b'))) FROM t)"""),
    "f_filter_norm": (lambda c: c.sites.select("id", terms.folded("title").alias("folded")), None),
    "f_filter_match": (lambda c: spread(c.versions.select("id", "title", "text")).where(terms.matches(c.spark, terms.Terms(_TERMS), F.col("title"), F.col("text"))).select("id"), f"WITH t AS (SELECT id, ' ' || {_FOLD.format('text')} || ' ' AS x, ' ' || {_FOLD.format('coalesce(title, chr(32))')} || ' ' AS y FROM page_versions WHERE text IS NOT NULL) SELECT id FROM t WHERE contains(x, ' second floor ') OR contains(y, ' second floor ') OR contains(x, ' old team ') OR contains(y, ' old team ') OR contains(replace(x, ' ', ''), 'lantern') OR contains(replace(y, ' ', ''), 'lantern')"),
    "f_trunc": (lambda c: c.pages.select("id", *[F.left(F.repeat("url", 60), F.lit(n)).alias(f"to_{n}") for n in (200, 300, 1000, 2000)]), "SELECT id, " + ", ".join(f"left(repeat(url, 60), {n}) AS to_{n}" for n in (200, 300, 1000, 2000)) + " FROM pages"),
    "f_outcome": (lambda c: c.versions.select("id", fetching.outcome(F.col("http_status"), F.col("content_type"), F.octet_length("text"), F.lit("<html>"), F.lit(None).cast("string")).alias("outcome")), "SELECT id, CASE WHEN http_status < 200 OR http_status > 299 THEN 'http_error' WHEN coalesce(content_type, '') <> '' AND trim(lower(split_part(content_type, ';', 1))) NOT IN ('text/html', 'application/xhtml+xml') THEN 'content_type' WHEN strlen(text) > 2097152 THEN 'too_large' ELSE 'ok' END AS outcome FROM page_versions"),
    "f_socks_outcome": (lambda c: c.spark.range(256).select(F.col("id").alias("code"), fetching.socks_outcome(F.col("id")).alias("outcome")), "SELECT i AS code, CASE i " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fetching.SOCKS_REPLIES.items()) + " ELSE 'socks_error' END AS outcome FROM range(256) t(i)"),
    "f_rendezvous": (lambda c: c.sites.select("id", fetching.pick_proxy([f"tor{i}" for i in range(6)])("onion").alias("proxy")), None),
    "f_date_trunc": (lambda c: c.log.groupBy(truncated("hour", F.col("ts")).alias("hour"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), "SELECT date_trunc('hour', ts) AS hour, CAST(ts AS DATE) AS day, count(*) AS n FROM fetch_log GROUP BY 1, 2"),
    "f_backoff": (lambda c: c.sites.select("id", state.backoff_seconds(F.least("consecutive_failures", F.lit(8))).alias("wait")), "SELECT id, 1800 * pow(2, least(consecutive_failures, 8)) AS wait FROM sites"),
    "f_left_len": (lambda c: c.versions.select("id", F.left("text", F.lit(100)).alias("start"), (F.length("text") > 100).alias("more")), "SELECT id, left(text, 100) AS start, length(text) > 100 AS more FROM page_versions"),
    "f_concat_url": (lambda c: c.sites.select("id", onion.home_url(F.col("onion")).alias("url")), "SELECT id, 'http://' || onion || '.onion/' AS url FROM sites"),
    "f_display": (lambda c: c.log.where("latency_ms IS NOT NULL").select(display.compact(F.col("bytes")).alias("size"), display.milliseconds(F.col("latency_ms")).alias("ms"), display.ago(F.col("latency_ms")).alias("ago")).groupBy("size", "ms", "ago").agg(F.count("*").alias("n")), "SELECT CASE WHEN bytes >= 1000000 THEN regexp_replace(printf('%.1f', ((bytes * 10 + 500000) // 1000000) / 10.0), '\\.0$', '') || 'M' WHEN bytes >= 1000 THEN regexp_replace(printf('%.1f', ((bytes * 10 + 500) // 1000) / 10.0), '\\.0$', '') || 'k' ELSE CAST(bytes AS VARCHAR) END AS size, CASE WHEN latency_ms >= 1000 THEN printf('%.1f s', ((latency_ms * 10 + 500) // 1000) / 10.0) ELSE latency_ms || ' ms' END AS ms, CASE WHEN latency_ms < 90 THEN latency_ms || 's ago' WHEN latency_ms < 5400 THEN CAST(round(latency_ms / 60.0) AS BIGINT) || 'm ago' WHEN latency_ms < 129600 THEN CAST(round(latency_ms / 3600.0) AS BIGINT) || 'h ago' ELSE CAST(round(latency_ms / 86400.0) AS BIGINT) || 'd ago' END AS ago, count(*) AS n FROM fetch_log WHERE latency_ms IS NOT NULL GROUP BY ALL"),
    "f_short_address": (lambda c: c.sites.select("id", display.short_address(F.col("onion")).alias("short")), "SELECT id, left(onion, 10) || '…' || right(onion, 6) || '.onion' AS short FROM sites"),
    "f_rank_scaled": (lambda c: c.sites.select("id", display.scaled_rank(F.col("pages_fetched") / F.lit(1000.0)).alias("r")), "SELECT id, round(pages_fetched / 1000.0 * 1e6, 1) AS r FROM sites"),
    "f_rows_to_points": (lambda c: x.activity(c).select(F.unix_timestamp(F.col("t").cast("timestamp")).alias("t"), F.col("fetches").cast("double").alias("v")), f"SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS t, CAST(count(*) AS DOUBLE) AS v FROM fetch_log WHERE ts > {AS_OF} - INTERVAL 48 HOUR GROUP BY 1"),
    # state
    "u_enqueue": (lambda c: _enqueued(c), f"WITH found AS (SELECT DISTINCT dst_url AS url, dst_site_id AS site_id FROM links WHERE is_onion AND dst_site_id IS NOT NULL) SELECT url, min(site_id) AS site_id FROM found JOIN sites s ON s.id = found.site_id WHERE s.pages_fetched < {state.PAGE_CAP} AND url NOT IN (SELECT url FROM pages) GROUP BY 1"),
    "u_link_expand": (lambda c: _expanded(c), None),
    "u_claim": (lambda c: state.claim(*_queue(c), _as_of(c), 20, 50)[0].select("site_id", "url"), f"WITH {_QUEUE}, due AS (SELECT q.*, s.pages_fetched, s.onion, coalesce(s.last_seen, s.first_seen) AS nxt, row_number() OVER (PARTITION BY site_id ORDER BY priority, next_fetch_at, url_hash) AS rn FROM q JOIN sites s ON s.id = q.site_id WHERE next_fetch_at <= {AS_OF} AND (pages_fetched < 50 OR priority <= 1) AND s.status <> 'auth_gated' AND coalesce(s.last_seen, s.first_seen) <= {AS_OF} AND s.first_seen <= {AS_OF}) SELECT site_id, url FROM due WHERE rn = 1 ORDER BY pages_fetched = 0 DESC, nxt, site_id LIMIT 20"),
    "u_claim_lease": (lambda c: state.claim(*_queue(c), _as_of(c), 20, 50)[1].select("id", "lease_until"), f"WITH {_QUEUE}, best AS (SELECT DISTINCT site_id FROM q JOIN sites s ON s.id = q.site_id WHERE next_fetch_at <= {AS_OF} AND (pages_fetched < 50 OR priority <= 1)), taken AS (SELECT id FROM sites SEMI JOIN (SELECT site_id AS id FROM best) b USING (id) WHERE status <> 'auth_gated' AND coalesce(last_seen, first_seen) <= {AS_OF} AND first_seen <= {AS_OF} QUALIFY row_number() OVER (ORDER BY pages_fetched = 0 DESC, coalesce(last_seen, first_seen), id) <= 20) SELECT s.id, CASE WHEN t.id IS NULL THEN first_seen ELSE {AS_OF} + to_seconds({state.LEASE_S}) END AS lease_until FROM sites s LEFT JOIN taken t ON t.id = s.id"),
    "u_enqueue_queued": (lambda c: _enqueued_again(c), f"WITH found AS (SELECT dst_url AS url, bool_or(coalesce(anchor_text, '') <> '') AS queued FROM links l JOIN sites s ON s.id = l.dst_site_id WHERE is_onion AND s.pages_fetched < {state.PAGE_CAP} GROUP BY 1) SELECT url, CAST(CASE WHEN queued THEN 9 ELSE 3 END AS INTEGER) AS priority FROM found WHERE queued OR url NOT IN (SELECT url FROM pages)"),
    "u_save_pages": (lambda c: _saved(c, "pages"), f"WITH {_CAUGHT} SELECT p.url, CASE WHEN k.url IS NULL THEN p.last_status ELSE 210 END AS last_status, k.url IS NOT NULL AND k.changed AS renewed FROM pages p LEFT JOIN caught k ON k.url = p.url UNION ALL SELECT url, 210, true FROM fresh"),
    "u_save_versions": (lambda c: _saved(c, "versions"), f"WITH {_CAUGHT} SELECT sha256(text) AS h, count(*) AS n FROM (SELECT coalesce(text, '') AS text FROM page_versions UNION ALL SELECT text FROM caught WHERE changed UNION ALL SELECT 'new page' FROM fresh) GROUP BY 1"),
    "u_save_links": (lambda c: _saved(c, "links"), f"WITH {_CAUGHT}, new_ AS (SELECT url, site_id FROM caught WHERE changed UNION ALL SELECT url, site_id FROM fresh) SELECT p.url AS src, l.dst_url AS dst, l.dst_site_id, l.is_onion, count(*) AS n FROM links l JOIN pages p ON p.id = l.src_page_id WHERE p.url NOT IN (SELECT url FROM new_) GROUP BY ALL UNION ALL SELECT url, 'http://home/', site_id, true, 1 FROM new_ UNION ALL SELECT url, 'https://clear.example/', NULL, false, 1 FROM new_"),
    "u_save_entities": (lambda c: _saved(c, "entities"), f"WITH {_CAUGHT} SELECT kind, value, count(*) AS n FROM (SELECT kind, value FROM entities UNION ALL SELECT 'email', 'a@b.example' FROM caught WHERE changed UNION ALL SELECT 'email', 'a@b.example' FROM fresh) GROUP BY ALL"),
    "u_save_sites": (lambda c: _saved(c, "sites"), f"WITH {_CAUGHT}, home AS (SELECT DISTINCT site_id FROM caught WHERE changed AND depth = 0 AND ends_with(url, '.onion/')) SELECT s.id, pages_fetched + 1 AS pages_fetched, CASE WHEN h.site_id IS NULL THEN s.title ELSE 'named' END AS title, CASE WHEN h.site_id IS NULL THEN s.server END AS server FROM sites s LEFT JOIN home h ON h.site_id = s.id"),
    "u_mark_indexed": (lambda c: state.mark_indexed(c.pages.withColumn("indexed_version_id", F.lit(None).cast("long")), c.pages.where("depth = 1").select(F.col("id").alias("page_id"), F.col("current_version_id").alias("version_id"))).select("id", "indexed_version_id"), "SELECT id, CASE WHEN depth = 1 THEN current_version_id END AS indexed_version_id FROM pages"),
    "u_liveness_stored": (lambda c: state.liveness(c.sites, c.since("7 DAYS"), stored=True).select("id", "status", "consecutive_failures", "last_ok"), f"""WITH l AS (SELECT s.id, s.first_seen, s.last_ok, coalesce(s.consecutive_failures, 0) AS held, f.ts, f.outcome, list_contains({list(fetching.ALIVE)}, f.outcome) AS alive FROM fetch_log f JOIN sites s ON s.id = f.site_id WHERE f.ts > {AS_OF} - INTERVAL 7 DAY),
g AS (SELECT id, any_value(first_seen) AS first_seen, any_value(last_ok) AS last_ok, any_value(held) AS held, max((ts, outcome)) AS z, max(CASE WHEN alive THEN (ts, outcome) END) AS ok, list((ts, outcome)) AS rows_ FROM l GROUP BY id),
k AS (SELECT *, ok IS NOT NULL AND ok = z AS up, CASE WHEN ok IS NULL THEN held + len(rows_) ELSE len(list_filter(rows_, lambda e: e > ok)) END AS fails, coalesce(ok[1], last_ok) AS answered_at FROM g)
SELECT id, CASE WHEN up THEN 'up' WHEN z[2] = 'auth_required' THEN 'auth_gated' WHEN coalesce(answered_at, first_seen) < z[1] - INTERVAL 30 DAY THEN 'dead' WHEN z[2] = 'desc_not_found' THEN 'down' ELSE 'flaky' END AS status, CAST(CASE WHEN up THEN 0 ELSE fails END AS INTEGER) AS consecutive_failures, answered_at AS last_ok FROM k"""),
    "u_release": (lambda c: state.release(_queue(c)[0], c.since("1 DAY"), _as_of(c)).select("id", "next_allowed_at"), f"WITH d AS (SELECT site_id, max(CASE WHEN outcome IN ('ok', 'http_error') THEN 8 ELSE 32 END) AS wait FROM fetch_log WHERE ts > {AS_OF} - INTERVAL 1 DAY GROUP BY 1) SELECT s.id, CASE WHEN wait IS NULL THEN coalesce(s.last_seen, s.first_seen) ELSE {AS_OF} + to_seconds(wait) END AS next_allowed_at FROM sites s LEFT JOIN d ON d.site_id = s.id"),
    "u_finish": (lambda c: state.finish(_queue(c)[1], c.since("3 DAYS").select("url_hash", "outcome"), _as_of(c)).select("url", "next_fetch_at", "attempts"), f"WITH {_QUEUE}, d AS (SELECT url_hash, bool_or(outcome IN {_sql_list(fetching.TRANSIENT)}) AS again FROM fetch_log WHERE ts > {AS_OF} - INTERVAL 3 DAY GROUP BY 1) SELECT url, CASE WHEN again THEN {AS_OF} + to_seconds(1800 * pow(2, attempts)) ELSE next_fetch_at END AS next_fetch_at, CASE WHEN again THEN attempts + 1 ELSE attempts END AS attempts FROM q LEFT JOIN d USING (url_hash) WHERE again IS NULL OR again"),
    "u_liveness": (lambda c: state.liveness(c.sites, c.log), LIVE),
    "u_recheck": (lambda c: state.rechecks(*_queue(c), _as_of(c))[1].select("url", "site_id", "priority", "next_fetch_at"), f"WITH {_QUEUE}, home AS (SELECT 'http://' || onion || '.onion/' AS url, id AS site_id, 1 AS priority, {AS_OF} AS next_fetch_at FROM sites WHERE last_seen <= {AS_OF} AND status <> 'auth_gated') SELECT url, min(site_id) AS site_id, min(priority) AS priority, min(next_fetch_at) AS next_fetch_at FROM (SELECT url, site_id, priority, next_fetch_at FROM q UNION ALL SELECT * FROM home) GROUP BY 1"),
    "u_save_page": (lambda c: state.changed_versions(c.versions).select("id", "page_id"), "SELECT id, page_id FROM (SELECT id, page_id, text_hash, lag(text_hash) OVER w AS before, row_number() OVER w AS rn FROM page_versions WINDOW w AS (PARTITION BY page_id ORDER BY fetched_at, id)) WHERE rn = 1 OR text_hash IS DISTINCT FROM before"),
    "u_current_version": (lambda c: state.current_versions(c.versions), "SELECT page_id, max_by(id, (fetched_at, id)) AS current_version_id FROM page_versions GROUP BY 1"),
    "u_purge": (lambda c: _purged(c), f"WITH bad AS (SELECT id FROM sites WHERE {_BLOCKED}) SELECT 'sites' AS name, count(*) AS n FROM sites WHERE id NOT IN (FROM bad) UNION ALL SELECT 'pages', count(*) FROM pages WHERE site_id NOT IN (FROM bad) UNION ALL SELECT 'page_versions', count(*) FROM page_versions v JOIN pages p ON p.id = v.page_id WHERE p.site_id NOT IN (FROM bad) UNION ALL SELECT 'links', count(*) FROM links l JOIN pages p ON p.id = l.src_page_id WHERE p.site_id NOT IN (FROM bad) UNION ALL SELECT 'entities', count(*) FROM entities WHERE site_id NOT IN (FROM bad) UNION ALL SELECT 'fetch_log', count(*) FROM fetch_log WHERE site_id NOT IN (FROM bad) UNION ALL SELECT 'known targets', count(*) FROM links l JOIN pages p ON p.id = l.src_page_id WHERE p.site_id NOT IN (FROM bad) AND l.dst_site_id NOT IN (FROM bad)"),
    "u_replace_source": (lambda c: state.replace_source(_blocklist(c).withColumn("source", F.lit("local")), "remote", c.sites.select(F.md5("onion").alias("md5"))), f"SELECT md5(onion) AS md5, CASE WHEN {_BLOCKED} THEN 'local' ELSE 'remote' END AS source FROM sites"),
    "u_blocked_sites": (lambda c: pr.on_blocklist(c.sites, _blocklist(c)).select("id", "onion"), f"SELECT id, onion FROM sites WHERE {_BLOCKED}"),
    "u_trim_capped": (lambda c: state.trim_capped(*_queue(c), cap=10).groupBy("site_id").agg(F.count("*").alias("n")), f"WITH {_QUEUE} SELECT site_id, count(*) AS n FROM q WHERE priority <= 1 OR site_id NOT IN (SELECT id FROM sites WHERE pages_fetched >= 10) GROUP BY 1"),
    "u_index_delta": (lambda c: state.index_delta(c.pages.withColumn("indexed_version_id", F.when(F.col("depth") > 0, F.col("current_version_id")))).select("id"), "SELECT id FROM pages WHERE depth = 0 AND current_version_id IS NOT NULL"),
    "u_gauges": (lambda c: state.gauges(*_queue(c), c.pages, _as_of(c)), f"SELECT 'crawler_sites' AS metric, status AS label, count(*) AS value FROM sites GROUP BY 2 UNION ALL SELECT 'crawler_frontier', 'total', count(*) FROM pages UNION ALL SELECT 'crawler_frontier', 'due', count(*) FROM pages WHERE last_fetched <= {AS_OF} UNION ALL SELECT 'crawler_pages', '', count(*) FROM pages"),
    "u_route_purge": (lambda c: _routed(c, "password list"), "SELECT DISTINCT p.site_id, 'filter' AS reason FROM page_versions v JOIN pages p ON p.id = v.page_id WHERE contains(lower(text), 'password list')"),
    "u_guard": (lambda c: c.pages.where(~terms.matches(c.spark, terms.Terms(["~kb"]), F.col("url"))).select("id"), "SELECT id FROM pages WHERE NOT contains(regexp_replace(lower(url), '[^\\p{L}\\p{Nd}]+', '', 'g'), 'kb')"),
    # search and metrics
    "q_search": (lambda c: _searched(c), None),
    "st_index_terms": (lambda c: search.inverted(search.documents(c.pages, c.versions)).groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")), r"WITH d AS (SELECT p.id, v.title, v.text FROM pages p JOIN page_versions v ON v.id = p.current_version_id), w AS (SELECT id, 'title' AS f, unnest(regexp_extract_all(lower(title), '[\p{L}\p{Nd}]+')) AS term FROM d UNION ALL SELECT id, 'text', unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) FROM d) SELECT term, count(DISTINCT (id, f)) AS n, count(*) AS tf FROM w GROUP BY 1"),
    "q_search_scores": (lambda c: _searched(c).select("page_id", "score", "total"), _BM25),
    "q_prom_fetch_rate": (lambda c: _series(c, "fetch_rate", 24), f"WITH {_RATES.format(where=_LAST_DAY)}, s AS (SELECT (sec // 288) * 288 AS t, outcome, proxy, avg(rate) AS rate FROM r GROUP BY 1, 2, 3) SELECT outcome AS name, t, round(sum(rate), 9) AS value FROM s GROUP BY 1, 2"),
    "q_prom_latency": (lambda c: _series(c, "latency", 24), None),
    "a_hist_quantile": (lambda c: _quantiles(c), _QUANTILE),
    "a_ratio": (lambda c: metrics.error_ratio(metrics.from_log(c.log), 3600).withColumn("value", F.round("value", 9)), f"WITH {_RATES.format(where='')} SELECT (sec // 3600) * 3600 AS t, proxy, CASE WHEN sum(rate) > 0 THEN round(sum(CASE WHEN outcome NOT IN ('ok', 'http_error') THEN rate ELSE 0 END) / sum(rate), 9) END AS value FROM r GROUP BY 1, 2"),
    "a_rate": (lambda c: _rates(c), f"WITH {_RATES.format(where='')} SELECT ts, outcome, proxy, round(rate, 9) AS rate FROM r"),
    "w_rolling_rate": (lambda c: _rates(c).where("rate > 0"), f"WITH {_RATES.format(where='')} SELECT ts, outcome, proxy, round(rate, 9) AS rate FROM r WHERE round(rate, 9) > 0"),
    # other names of the inventory
    "j_cross_theta": (lambda c: x.similar(c, 1, 26), "WITH homes AS (SELECT p.site_id AS id, p.id AS page_id, v.simhash, length(v.text) AS chars FROM pages p JOIN page_versions v ON v.id = p.current_version_id WHERE p.depth = 0), me AS (SELECT simhash FROM homes WHERE id = 1 ORDER BY page_id LIMIT 1) SELECT s.id, s.onion, coalesce(s.title, '') AS title, s.status, bit_count(xor(h.simhash, me.simhash)) AS distance FROM me, homes h JOIN sites s ON s.id = h.id WHERE h.id <> 1 AND h.chars >= 200 AND bit_count(xor(h.simhash, me.simhash)) <= 26 ORDER BY distance, s.id LIMIT 50"),
    "j_band": (lambda c: graph.simhash_pairs(c.versions.where("length(text) >= 200"), 2), "SELECT a.id AS a, b.id AS b FROM page_versions a JOIN page_versions b ON a.id < b.id AND length(a.text) >= 200 AND length(b.text) >= 200 AND bit_count(xor(a.simhash, b.simhash)) <= 2"),
    "j_calendar_left": (lambda c: x.calendar(c, 2), f"""WITH u AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE outcome IN {_ALIVE}) AS up, count(*) AS total FROM fetch_log WHERE site_id = 2 AND ts > {AS_OF} - INTERVAL 90 DAY GROUP BY 1)
SELECT CAST(g.day AS DATE) AS day, CASE WHEN total IS NULL THEN 'none' WHEN up = total THEN 'up' WHEN up = 0 THEN 'down' ELSE 'flaky' END AS colour FROM (SELECT unnest(generate_series(CAST({AS_OF} AS DATE)::TIMESTAMP - INTERVAL 89 DAY, CAST({AS_OF} AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS day) g LEFT JOIN u ON u.day = CAST(g.day AS DATE)"""),
    "o_topk_ring": (lambda c: graph.neighbourhood(c.edges, 2, 2, 30), f"""WITH {EDGES}, both_ AS (SELECT src_site_id AS x, dst_site_id AS id, n_links FROM edges UNION ALL SELECT dst_site_id, src_site_id, n_links FROM edges),
r1 AS (SELECT id FROM both_ WHERE x = 2 AND id <> 2 GROUP BY 1 ORDER BY sum(n_links) DESC, id LIMIT 29), c1 AS (SELECT 2::BIGINT AS id UNION ALL SELECT id FROM r1),
r2 AS (SELECT id, row_number() OVER (ORDER BY sum(n_links) DESC, id) AS pos FROM both_ WHERE x IN (SELECT id FROM r1) AND id NOT IN (SELECT id FROM c1) GROUP BY 1)
SELECT 2::BIGINT AS id, 0 AS ring UNION ALL SELECT id, 1 FROM r1 UNION ALL SELECT id, 2 FROM r2 WHERE pos <= 30 - (SELECT count(*) FROM c1)"""),
    "g_similar": (lambda c: x.similar(c, 3, 28), "WITH homes AS (SELECT p.site_id AS id, p.id AS page_id, v.simhash, length(v.text) AS chars FROM pages p JOIN page_versions v ON v.id = p.current_version_id WHERE p.depth = 0), me AS (SELECT simhash FROM homes WHERE id = 3 ORDER BY page_id LIMIT 1) SELECT s.id, s.onion, coalesce(s.title, '') AS title, s.status, bit_count(xor(h.simhash, me.simhash)) AS distance FROM me, homes h JOIN sites s ON s.id = h.id WHERE h.id <> 3 AND h.chars >= 200 AND bit_count(xor(h.simhash, me.simhash)) <= 28 ORDER BY distance, s.id LIMIT 50"),
    "a_sum_by": (lambda c: _summed(c), f"WITH {_RATES.format(where='')}, s AS (SELECT (sec // 900) * 900 AS t, outcome, proxy, avg(rate) AS rate FROM r WHERE outcome IN ('content_type', 'too_large', 'sniff') GROUP BY ALL) SELECT t, proxy, round(sum(rate), 9) AS value FROM s GROUP BY ALL"),
}


def _enqueued(c: Crawl) -> DataFrame:
    found = c.links.where("is_onion AND dst_site_id IS NOT NULL").join(c.sites.select(F.col("id").alias("dst_site_id"), F.col("onion").alias("dst")), "dst_site_id").select(F.col("dst_url").alias("url"), "dst").distinct().withColumn("depth", F.lit(1)).withColumn("priority", F.lit(3))
    first = found.groupBy("url").agg(F.min("dst").alias("dst"), F.min("depth").alias("depth"), F.min("priority").alias("priority"))
    empty = _queue(c)[1].where(F.lit(False))
    return state.enqueue(c.sites, empty, c.pages, first, _as_of(c)).select("url", "site_id")


def _expanded(c: Crawl) -> DataFrame:
    pages = c.pages.join(c.sites.select(F.col("id").alias("site_id"), F.col("onion").alias("address")), "site_id").select(F.col("id").alias("src_page_id"), "address", "depth", F.col("url").alias("base"))
    links = c.links.groupBy("src_page_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("dst_url", F.lit("")).alias("url"), F.coalesce("anchor_text", F.lit("")).alias("anchor")))).alias("links"))
    fetched = pages.join(links, "src_page_id").withColumnRenamed("src_page_id", "page_id")
    return state.expand_links(fetched, _blocklist(c))[1].groupBy("depth", "priority").agg(F.count("*").alias("n"))


def _purged(c: Crawl) -> DataFrame:
    bad = pr.on_blocklist(c.sites, _blocklist(c)).select(F.col("id").alias("site_id"))
    left = state.purge({"sites": c.sites, "pages": c.pages, "page_versions": c.versions, "links": c.links, "entities": c.entities, "fetch_log": c.log}, bad)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in left.items()]
    counts.append(left["links"].where("dst_site_id IS NOT NULL").agg(F.count("*").alias("n")).select(F.lit("known targets").alias("name"), "n"))
    out = counts[0]
    for d in counts[1:]:
        out = out.unionByName(d)
    return out


def _searched(c: Crawl) -> DataFrame:
    """The index is a table that is read three times: written once to the shared folder here, kept by snk_bulk_index in a crawl."""
    docs = search.documents(c.pages, c.versions)
    return search.search(cut(search.inverted(docs)), docs, " ".join(_WORDS))


def _series(c: Crawl, name: str, hours: int) -> DataFrame:
    return metrics.series(metrics.from_log(c.log), name, hours).withColumn("value", F.round("value", 9))


def _quantiles(c: Crawl) -> DataFrame:
    last = metrics.from_log(c.log).where("metric = 'crawler_fetch_duration_seconds_bucket'").groupBy(metrics.label("outcome").alias("outcome"), metrics.label("le").alias("le")).agg(F.max("value").alias("value"))
    return metrics.histogram_quantile(0.9, last, ["outcome"]).withColumn("value", F.round("value", 9))


def _rates(c: Crawl) -> DataFrame:
    mine = metrics.from_log(c.log).where("metric = 'crawler_fetches_total'").select("ts", metrics.label("outcome").alias("outcome"), metrics.label("proxy").alias("proxy"), "value")
    return metrics.rates(mine, ["outcome", "proxy"], 300).select("ts", "outcome", "proxy", F.round("rate", 9).alias("rate"))


def _terms(c: Crawl) -> DataFrame:
    t = terms.Terms(_TERMS)
    return c.spark.createDataFrame([("phrase", x.strip()) for x in t.phrases] + [("part", x) for x in t.parts], "kind string, term string")


def _enqueued_again(c: Crawl) -> DataFrame:
    """The queue after all links to other pages are offered to it, those with a name being queued already."""
    found = c.links.where("is_onion AND dst_site_id IS NOT NULL").join(c.sites.where(F.col("pages_fetched") < state.PAGE_CAP).select(F.col("id").alias("dst_site_id"), F.col("onion").alias("dst")), "dst_site_id")
    each = found.groupBy(F.col("dst_url").alias("url")).agg(F.min("dst").alias("dst"), F.min("dst_site_id").alias("site_id"), F.max(F.coalesce("anchor_text", F.lit("")) != "").alias("queued"))
    queue = each.where("queued").select(hashing.url_hash(F.col("url")).alias("url_hash"), "url", "site_id", F.lit(1).alias("depth"), F.lit(9).alias("priority"), _as_of(c).alias("next_fetch_at"), F.lit(0).alias("attempts"))
    return state.enqueue(c.sites, queue, c.pages, each.select("url", "dst", F.lit(1).alias("depth"), F.lit(3).alias("priority")), _as_of(c)).select("url", "priority")


def _saved(c: Crawl, name: str) -> DataFrame:
    """Every current version captured again, those of deeper pages with a line more, and a new page of each site."""
    at, links = _as_of(c), lambda onion_: F.array(F.struct(F.lit("http://home/").alias("url"), F.lit("home").alias("anchor"), onion_.alias("dst")), F.struct(F.lit("https://clear.example/").alias("url"), F.lit("clear").alias("anchor"), F.lit("").alias("dst")))
    found = F.array(F.struct(F.lit("email").alias("kind"), F.lit("a@b.example").alias("value")), F.struct(F.lit("email").alias("kind"), F.lit("a@b.example").alias("value")))
    v = c.versions.select(F.col("id").alias("current_version_id"), F.coalesce("text", F.lit("")).alias("text"))
    onions = c.sites.select(F.col("id").alias("site_id"), "onion")
    rest = lambda url, depth, text: (F.col("site_id"), url.alias("url"), depth.cast("int").alias("depth"), at.alias("fetched_at"), F.lit(210).alias("status"), F.lit("text/html").alias("content_type"), F.lit("").alias("server"), F.lit("named").alias("title"), text.alias("text"), F.lit(None).cast("binary").alias("html_hash"), F.lit(0).cast("long").alias("simhash"), links(F.col("onion")).alias("links"), found.alias("entities"))
    again = c.pages.join(v, "current_version_id").join(onions, "site_id").select(*rest(F.col("url"), F.col("depth"), F.when(F.col("depth") <= 1, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))))
    new = onions.select(*rest(F.concat(onion.home_url(F.col("onion")), F.lit("brand-new")), F.lit(1), F.lit("new page")))
    tables = {"sites": c.sites, "pages": c.pages, "page_versions": c.versions.withColumn("html_hash", F.lit(None).cast("binary")), "links": c.links, "entities": c.entities}
    t = state.save_pages(tables, again.unionByName(new))
    if name == "pages":
        last = c.versions.agg(F.max("id")).scalar()
        return t["pages"].select("url", "last_status", F.coalesce(F.col("current_version_id") > last, F.lit(False)).alias("renewed"))
    if name == "versions":
        return t["page_versions"].groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.count("*").alias("n"))
    if name == "links":
        return t["links"].join(t["pages"].select(F.col("id").alias("src_page_id"), F.col("url").alias("src")), "src_page_id").groupBy("src", F.col("dst_url").alias("dst"), "dst_site_id", "is_onion").agg(F.count("*").alias("n"))
    if name == "entities":
        return t["entities"].groupBy("kind", "value").agg(F.count("*").alias("n"))
    return t["sites"].select("id", "pages_fetched", "title", "server")


def _summed(c: Crawl) -> DataFrame:
    """Refused fetches per second and proxy, in steps of 15 minutes."""
    mine = metrics.from_log(c.log).where("metric = 'crawler_fetches_total'").where(metrics.matches("outcome", "=~", "content_type|too_large|sniff"))
    mine = mine.withColumn("series", F.to_json(F.array_sort(F.map_entries("labels"))))
    return metrics.sum_by(metrics.rates(mine, ["series"], 300), ("proxy",), 900).withColumn("value", F.round("value", 9))


def _gathered(c: Crawl) -> DataFrame:
    """The sites of each key or mailbox on 2 to 18 of them; values are counted first, so that no value's sites beyond 18 are gathered."""
    e = c.entities.where("kind IN ('pgp', 'email')").select("kind", "value", "site_id").distinct()
    few = e.groupBy("kind", "value").agg(F.count("site_id").alias("n")).where("n BETWEEN 2 AND 18").select("kind", "value")
    return e.join(few, ["kind", "value"], "left_semi").groupBy("kind", "value").agg(F.array_sort(F.collect_list("site_id")).alias("sites"))


def _q(f):
    return lambda spark, d: f(Crawl(spark, d))


def schema_check(spark: SparkSession, d: str) -> DataFrame:
    from weblattice.schema import faults

    return Crawl(spark, d).sites.where(F.size(faults("sites")) > 0).select("id")


QUERIES = {**{k: _q(f) for k, (f, _) in _ALL.items()}, "src_schema": schema_check}
SQL = {**{k: sql for k, (_, sql) in _ALL.items() if sql}, "src_schema": "SELECT id FROM sites WHERE NOT regexp_full_match(onion, '[a-z2-7]{56}') OR status NOT IN ('unknown', 'up', 'flaky', 'down', 'dead', 'auth_gated')"}
