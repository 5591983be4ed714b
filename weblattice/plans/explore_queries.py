"""The explorer's queries with the parameters they are checked with, and their SQL."""

from __future__ import annotations

from weblattice.functions.fetching import ALIVE
from weblattice.operators import graph
from weblattice.plans import explore as x
from weblattice.plans.crawl import AS_OF, DEGREES, EDGES, LIVE, SITE, WITH_ANALYSIS, Crawl

ME = 1  # the site with most pages
PAGE = 1
DEG = "coalesce(d.indeg, 0) AS indeg, coalesce(d.outdeg, 0) AS outdeg"
WITH_EDGES = f"WITH {EDGES}"
WITH_DEGREES = f"WITH {EDGES}, {DEGREES}"
SITE_LIST = f"{SITE}, s.first_seen, s.last_ok, s.pages_fetched, {DEG}, round(an.pagerank, 9) AS pagerank FROM sites s LEFT JOIN deg d ON d.id = s.id LEFT JOIN analysis an ON an.site_id = s.id"
HOMES = "homes AS (SELECT p.site_id AS id, p.id AS page_id, v.simhash, v.text_hash, length(v.text) AS chars FROM pages p JOIN page_versions v ON v.id = p.current_version_id WHERE p.depth = 0)"
EGO = """ego AS (SELECT 1::BIGINT AS id, 0 AS ring UNION ALL SELECT id, 1 FROM (SELECT id, sum(n_links) AS w FROM
  (SELECT dst_site_id AS id, n_links FROM edges WHERE src_site_id = 1 UNION ALL SELECT src_site_id, n_links FROM edges WHERE dst_site_id = 1) WHERE id <> 1 GROUP BY 1 ORDER BY w DESC, id LIMIT 9))"""
#: Pages per site as ranges that a site falls into.
SITE_SIZES = "WITH size(bucket, lo, hi) AS (VALUES ('0', 0, 0), ('1', 1, 1), ('2-5', 2, 5), ('6-20', 6, 20), ('21-100', 21, 100), ('100+', 101, 2147483647)) SELECT bucket, count(*) AS sites FROM size JOIN sites ON pages_fetched BETWEEN lo AND hi GROUP BY bucket"
_FETCHES = f"SELECT site_id, ts, ts::DATE AS day, outcome, CASE WHEN list_contains({list(ALIVE)}, outcome) THEN 1 ELSE 0 END AS answered FROM fetch_log WHERE ts + INTERVAL 90 DAY > {AS_OF}"
TOP = "top AS (SELECT id FROM (SELECT src_site_id AS id FROM edges UNION ALL SELECT dst_site_id FROM edges) GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 40)"


#: Each home page long enough to compare with the least page it is linked to.
_GROUPED = f"""WITH RECURSIVE {HOMES}, h AS (SELECT page_id AS id, id AS site_id, simhash, text_hash FROM homes WHERE chars >= 200),
e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON bit_count(xor(a.simhash, b.simhash)) <= 3),
r AS (SELECT id AS a, id AS b FROM h UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), placed AS (SELECT h.id, site_id, text_hash, min(r.b) AS root FROM r JOIN h ON h.id = r.a GROUP BY ALL)"""


def _q(f):
    return lambda spark, d: f(Crawl(spark, d))


_ALL = {
    "q_overview_status": (x.status_counts, "SELECT status, count(*) AS n FROM sites GROUP BY 1"),
    "q_overview_totals": (x.totals, f"{WITH_EDGES} SELECT (SELECT count(*) FROM sites) AS sites, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM page_versions) AS versions, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM edges) AS edges, CAST(0 AS BIGINT) AS frontier"),
    "q_overview_outcomes": (x.outcomes_24h, f"SELECT outcome, count(*) AS n FROM fetch_log WHERE ts > {AS_OF} - INTERVAL 24 HOUR GROUP BY 1"),
    "q_overview_hubs": (lambda c: x.top_degree(c, "dst_site_id"), f"{WITH_EDGES} SELECT {SITE}, e.n AS degree FROM (SELECT dst_site_id AS id, count(*) AS n FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) e JOIN sites s ON s.id = e.id"),
    "q_overview_directories": (lambda c: x.top_degree(c, "src_site_id"), f"{WITH_EDGES} SELECT {SITE}, e.n AS degree FROM (SELECT src_site_id AS id, count(*) AS n FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) e JOIN sites s ON s.id = e.id"),
    "q_overview_recent": (x.recent, f"SELECT {SITE}, s.first_seen FROM sites s WHERE s.status = 'up' ORDER BY s.first_seen DESC, s.id LIMIT 15"),
    "q_overview_activity": (x.activity, f"SELECT date_trunc('hour', ts) AS t, count(*) AS fetches, count(*) FILTER (WHERE outcome = 'ok') AS ok FROM fetch_log WHERE ts > {AS_OF} - INTERVAL 48 HOUR GROUP BY 1"),
    "q_sites": (lambda c: x.sites(c, sort="rank"), f"{WITH_ANALYSIS} SELECT {SITE_LIST} ORDER BY coalesce(round(an.pagerank, 9), 0) DESC, s.id LIMIT 100"),
    "q_sites_filtered": (lambda c: x.sites(c, status="up", q="the", sort="seen"), f"{WITH_ANALYSIS} SELECT {SITE_LIST} WHERE s.status = 'up' AND (s.title ILIKE '%the%' OR s.onion LIKE 'the%') ORDER BY s.last_ok DESC NULLS LAST, s.id LIMIT 100"),
    "q_sites_component": (lambda c: x.sites(c, component=0, sort="pages", offset=5), f"{WITH_ANALYSIS} SELECT {SITE_LIST} WHERE an.component = 0 ORDER BY s.pages_fetched DESC, s.id LIMIT 100 OFFSET 5"),
    "q_sites_operator": (lambda c: x.sites(c, operator=0, sort="no such order"), f"{WITH_ANALYSIS} SELECT {SITE_LIST} WHERE an.operator = 0 ORDER BY coalesce(d.indeg, 0) DESC, s.id LIMIT 100"),
    "q_site": (lambda c: x.site(c, ME), f"{WITH_ANALYSIS} SELECT {SITE}, s.discovered_via, s.first_seen, s.last_seen, s.last_ok, s.consecutive_failures, coalesce(s.server, '') AS server, s.pages_fetched, {DEG}, round(an.pagerank, 9) AS pagerank, an.component, an.operator, w.next_check_at FROM sites s LEFT JOIN deg d ON d.id = s.id LEFT JOIN analysis an ON an.site_id = s.id LEFT JOIN ({LIVE}) w ON w.id = s.id WHERE s.id = {ME}"),
    "q_site_uptime": (lambda c: x.uptime(c, ME), f"WITH f AS ({_FETCHES} AND site_id = {ME}), l AS (SELECT DISTINCT ON (day) day, outcome AS last FROM f ORDER BY day, ts DESC, outcome DESC) SELECT day, CAST(sum(answered) AS BIGINT) AS up, count(*) AS total, any_value(l.last) AS last FROM f JOIN l USING (day) GROUP BY day"),
    "q_sites_uptime": (lambda c: x.uptime(c, None), f"WITH f AS ({_FETCHES}), l AS (SELECT DISTINCT ON (site_id, day) site_id, day, outcome AS last FROM f ORDER BY site_id, day, ts DESC, outcome DESC) SELECT site_id, day, CAST(sum(answered) AS BIGINT) AS up, count(*) AS total, any_value(l.last) AS last FROM f JOIN l USING (site_id, day) GROUP BY ALL"),
    "q_site_fetches": (lambda c: x.fetches(c, ME), f"SELECT ts, outcome, http_status, latency_ms FROM fetch_log WHERE site_id = {ME} ORDER BY ts DESC, outcome, latency_ms NULLS LAST LIMIT 20"),
    "q_site_pages": (lambda c: x.site_pages(c, ME), f"WITH mine AS (FROM pages WHERE site_id = {ME}), held AS (SELECT page_id, count(*) AS versions FROM page_versions SEMI JOIN (SELECT id AS page_id FROM mine) m USING (page_id) GROUP BY page_id), now_ AS (SELECT id AS current_version_id, title, length(text) AS chars FROM page_versions) SELECT mine.id, url, depth, last_fetched, last_status, coalesce(now_.title, '') AS title, chars, coalesce(versions, 0) AS versions FROM mine LEFT JOIN now_ USING (current_version_id) LEFT JOIN held ON held.page_id = mine.id QUALIFY row_number() OVER (ORDER BY depth, url, mine.id) <= 300"),
    "q_site_out": (lambda c: x.links_out(c, ME), f"{WITH_EDGES} SELECT {SITE}, n_links AS n FROM sites s JOIN edges ON s.id = dst_site_id AND src_site_id = {ME} QUALIFY row_number() OVER (ORDER BY n_links DESC, s.id) <= 300"),
    "q_site_in": (lambda c: x.links_in(c, ME), f"{WITH_EDGES} SELECT {SITE}, n_links AS n FROM sites s JOIN edges ON s.id = src_site_id AND dst_site_id = {ME} QUALIFY row_number() OVER (ORDER BY n_links DESC, s.id) <= 300"),
    "q_site_clearnet": (lambda c: x.clearnet(c, ME), f"WITH u AS (SELECT dst_url AS url FROM links SEMI JOIN (SELECT id AS src_page_id FROM pages WHERE site_id = {ME}) m USING (src_page_id) WHERE is_onion IS FALSE), k AS (SELECT url, count(*) AS n FROM u GROUP BY url) FROM k QUALIFY row_number() OVER (ORDER BY n DESC, url) <= 100"),
    "q_site_entities": (lambda c: x.site_entities(c, ME), f"WITH holders AS (SELECT DISTINCT kind, value, site_id FROM entities WHERE kind IS NOT NULL AND value IS NOT NULL), k AS (SELECT kind, value, count(site_id) AS sites, bool_or(site_id = {ME}) AS here FROM holders GROUP BY ALL) SELECT kind, value, sites FROM k WHERE here QUALIFY row_number() OVER (ORDER BY sites DESC, kind, value) <= 300"),
    "q_site_shared": (lambda c: x.shared(c, ME), f"WITH known AS (SELECT DISTINCT kind, value, site_id FROM entities WHERE kind <> 'onion' AND value IS NOT NULL), common AS (FROM known SEMI JOIN (FROM known WHERE site_id = {ME}) mine USING (kind, value)), k AS (SELECT site_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM common WHERE site_id <> {ME} GROUP BY site_id) SELECT {SITE}, n, kinds FROM k JOIN sites s ON s.id = k.site_id QUALIFY row_number() OVER (ORDER BY n DESC, s.id) <= 50"),
    "q_site_similar": (lambda c: x.similar(c, ME), f"WITH {HOMES}, me AS (SELECT simhash FROM homes WHERE id = {ME} ORDER BY page_id LIMIT 1) SELECT {SITE}, bit_count(xor(h.simhash, me.simhash)) AS distance FROM me, homes h JOIN sites s ON s.id = h.id WHERE h.id <> {ME} AND h.chars >= 200 AND bit_count(xor(h.simhash, me.simhash)) <= 6 ORDER BY distance, s.id LIMIT 50"),
    "q_liveness_calendar": (lambda c: x.calendar(c, ME), f"""WITH u AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE outcome IN {x.ALIVE_SQL}) AS up, count(*) AS total FROM fetch_log WHERE site_id = {ME} AND ts > {AS_OF} - INTERVAL 90 DAY GROUP BY 1)
SELECT CAST(g.day AS DATE) AS day, CASE WHEN total IS NULL THEN 'none' WHEN up = total THEN 'up' WHEN up = 0 THEN 'down' ELSE 'flaky' END AS colour FROM (SELECT unnest(generate_series(CAST({AS_OF} AS DATE)::TIMESTAMP - INTERVAL 89 DAY, CAST({AS_OF} AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS day) g LEFT JOIN u ON u.day = CAST(g.day AS DATE)"""),
    "q_page": (lambda c: x.page(c, PAGE), f"SELECT p.id, p.site_id, s.onion, coalesce(s.title, '') AS site_title, p.url, p.depth, p.first_fetched, p.last_fetched, p.last_status, p.current_version_id FROM pages p JOIN sites s ON s.id = p.site_id WHERE p.id = {PAGE}"),
    "q_page_versions": (lambda c: x.page_versions(c, PAGE), f"SELECT id, fetched_at, http_status, coalesce(title, '') AS title, length(text) AS chars, lower(printf('%016x', simhash)) AS simhash FROM page_versions WHERE page_id = {PAGE}"),
    "q_page_version": (lambda c: x.page_version(c, PAGE), f"SELECT v.id, v.fetched_at, coalesce(v.title, '') AS title, left(v.text, 300000) AS text, length(v.text) > 300000 AS truncated FROM page_versions v JOIN pages p ON p.current_version_id = v.id WHERE v.page_id = {PAGE} AND p.id = {PAGE}"),
    "q_page_links": (lambda c: x.page_links(c, 3), "SELECT l.dst_url AS url, coalesce(l.anchor_text, '') AS anchor, l.is_onion, l.dst_site_id AS site_id, coalesce(s.title, '') AS site_title FROM links l LEFT JOIN sites s ON s.id = l.dst_site_id WHERE l.src_page_id = 3"),
    "q_page_entities": (lambda c: x.page_entities(c, PAGE), f"SELECT e.kind, e.value FROM entities e JOIN pages p ON p.current_version_id = e.page_version_id WHERE p.id = {PAGE}"),
    "q_entities": (lambda c: x.entities(c), "SELECT kind, value, count(DISTINCT site_id) AS sites, count(*) AS mentions FROM entities GROUP BY 1, 2 ORDER BY sites DESC, mentions DESC, value, kind LIMIT 200"),
    "q_entities_filtered": (lambda c: x.entities(c, kind="email", q="post", offset=3), "SELECT kind, value, count(DISTINCT site_id) AS sites, count(*) AS mentions FROM entities WHERE kind = 'email' AND value ILIKE '%post%' GROUP BY 1, 2 ORDER BY sites DESC, mentions DESC, value, kind LIMIT 200 OFFSET 3"),
    "q_entity": (lambda c: _most_used(c), f"""WITH m AS (SELECT kind, value FROM entities WHERE kind <> 'onion' GROUP BY 1, 2 ORDER BY count(*) DESC, kind, value LIMIT 1)
SELECT {SITE}, count(*) AS pages, min(v.fetched_at) AS first_seen, max(v.fetched_at) AS last_seen, min(p.id) AS page_id FROM entities e JOIN m USING (kind, value) JOIN sites s ON s.id = e.site_id JOIN page_versions v ON v.id = e.page_version_id JOIN pages p ON p.id = v.page_id GROUP BY ALL ORDER BY pages DESC, s.id LIMIT 500"""),
    "q_graph_nodes": (lambda c: x.graph_nodes(c, x.graph_ids(c, most=40)), f"{WITH_ANALYSIS}, {TOP} SELECT {SITE}, {DEG}, an.component FROM sites s JOIN top ON top.id = s.id LEFT JOIN deg d ON d.id = s.id LEFT JOIN analysis an ON an.site_id = s.id"),
    "q_graph_edges": (lambda c: x.graph_edges(c, x.graph_ids(c, most=40)), f"{WITH_EDGES}, {TOP} SELECT src_site_id AS s, dst_site_id AS t, n_links AS w FROM edges WHERE src_site_id IN (SELECT id FROM top) AND dst_site_id IN (SELECT id FROM top) AND src_site_id IN (SELECT id FROM sites) AND dst_site_id IN (SELECT id FROM sites)"),
    "q_graph_site": (lambda c: x.graph_edges(c, x.graph_ids(c, site=ME, hops=1, most=10)), f"{WITH_EDGES}, {EGO} SELECT src_site_id AS s, dst_site_id AS t, n_links AS w FROM edges WHERE src_site_id IN (SELECT id FROM ego) AND dst_site_id IN (SELECT id FROM ego) AND src_site_id IN (SELECT id FROM sites) AND dst_site_id IN (SELECT id FROM sites)"),
    "q_clusters": (x.clusters, f"""WITH RECURSIVE {HOMES}, h AS (SELECT page_id AS id, id AS site_id, simhash, text_hash FROM homes WHERE chars >= 200),
e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON bit_count(xor(a.simhash, b.simhash)) <= 3),
r AS (SELECT id AS a, id AS b FROM h UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), roots AS (SELECT a AS id, min(b) AS root FROM r GROUP BY 1)
SELECT root, count(*) AS size, min(text_hash) = max(text_hash) AS exact, list_sort(list(site_id)) AS ids FROM roots JOIN h USING (id) GROUP BY 1 HAVING count(*) > 1"""),
    "q_clusters_sites": (x.cluster_sites, f"{_GROUPED}, sized AS (SELECT root, count(*) AS size, count(DISTINCT text_hash) = 1 AS exact FROM placed GROUP BY root) SELECT {SITE}, root, size, exact FROM placed JOIN sized USING (root) JOIN sites s ON s.id = placed.site_id WHERE size > 1"),
    "q_analytics_discovery": (lambda c: x.per_day(c.sites, "first_seen"), "SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM (SELECT CAST(first_seen AS DATE) AS day, count(*) AS n FROM sites GROUP BY 1)"),
    "q_analytics_pages": (lambda c: x.per_day(c.pages, "first_fetched"), "SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM (SELECT CAST(first_fetched AS DATE) AS day, count(*) AS n FROM pages GROUP BY 1)"),
    "q_analytics_outcomes": (x.outcomes_7d, f"WITH named AS (SELECT date_trunc('hour', ts) AS t, CASE outcome WHEN 'ok' THEN 'ok' WHEN 'http_error' THEN 'http_error' WHEN 'desc_not_found' THEN 'offline' WHEN 'timeout' THEN 'timeout' ELSE 'other' END AS shown FROM fetch_log WHERE outcome IS NOT NULL AND age({AS_OF}, ts) < INTERVAL 7 DAY), wide AS (PIVOT named ON shown IN ('ok', 'http_error', 'offline', 'timeout', 'other') USING count(*) GROUP BY t) FROM wide"),
    "q_analytics_latency": (x.latency_3d, f"SELECT date_trunc('hour', ts) AS t, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.9), 6) AS p90, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM fetch_log WHERE ts > {AS_OF} - INTERVAL 3 DAY AND outcome = 'ok' AND latency_ms IS NOT NULL GROUP BY 1"),
    "q_analytics_status": (x.status_counts, "SELECT status, count(*) AS n FROM sites GROUP BY 1"),
    "q_analytics_entity_kinds": (x.entity_kinds, 'WITH v AS (SELECT kind, count(value) AS "distinct" FROM (SELECT DISTINCT kind, value FROM entities) GROUP BY kind), h AS (SELECT kind, count(site_id) AS sites FROM (SELECT DISTINCT kind, site_id FROM entities) GROUP BY kind) SELECT v.kind, "distinct", sites FROM v JOIN h ON h.kind IS NOT DISTINCT FROM v.kind'),
    "q_analytics_depth": (x.depth, "SELECT depth, count(*) AS n FROM pages GROUP BY 1"),
    "q_analytics_site_sizes": (x.site_sizes, SITE_SIZES),
    "q_analytics_graph": (x.graph_counts, f"{WITH_ANALYSIS} SELECT count(*) AS analysed, count(DISTINCT component) AS components, count(DISTINCT operator) AS operators, {AS_OF} AS updated_at FROM analysis"),
    "q_analytics_top_rank": (x.top_rank, f"{WITH_ANALYSIS} SELECT {SITE}, round(an.pagerank, 9) AS pagerank, coalesce(d.indeg, 0) AS indeg FROM analysis an JOIN sites s ON s.id = an.site_id LEFT JOIN deg d ON d.id = s.id ORDER BY round(an.pagerank, 9) DESC, s.id LIMIT 25"),
    "q_analytics_components": (x.top_components, f"{WITH_ANALYSIS} SELECT component, count(*) AS sites, max_by(coalesce(s.title, s.onion), (round(pagerank, 9), -site_id)) AS top FROM analysis a JOIN sites s ON s.id = a.site_id GROUP BY 1 ORDER BY sites DESC, component LIMIT 15"),
    "q_analytics_operators": (x.top_operators, f"""{WITH_ANALYSIS}, g AS (SELECT operator, count(*) AS sites, max_by(coalesce(s.title, s.onion), (round(pagerank, 9), -site_id)) AS top FROM analysis a JOIN sites s ON s.id = a.site_id WHERE operator IS NOT NULL GROUP BY 1 ORDER BY sites DESC, operator LIMIT 25),
k AS (SELECT operator, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM entities e JOIN analysis a ON a.site_id = e.site_id WHERE operator IS NOT NULL AND kind <> 'onion' GROUP BY 1) SELECT operator, sites, top, kinds FROM g LEFT JOIN k USING (operator)"""),
    "g_site_edges": (lambda c: c.edges, f"{WITH_EDGES} SELECT * FROM edges"),
    "g_degree": (lambda c: graph.degrees(c.edges), f"{WITH_DEGREES} SELECT id, indeg, outdeg FROM deg"),
    "g_pagerank": (lambda c: _rounded(graph.pagerank(c.sites, c.edges)), f"{WITH_ANALYSIS} SELECT site_id AS id, round(pagerank, 9) AS pagerank FROM analysis"),
    "g_wcc": (lambda c: _components(c), f"{WITH_ANALYSIS} SELECT site_id AS id, component AS label FROM analysis"),
    "g_operator": (lambda c: _operators(c), f"{WITH_ANALYSIS} SELECT site_id AS id, operator AS label FROM analysis"),
    "g_analysis": (lambda c: _rounded(c.analysis), f"{WITH_ANALYSIS} SELECT site_id, round(pagerank, 9) AS pagerank, component, operator FROM analysis"),
    "g_ego": (lambda c: graph.neighbourhood(c.edges, ME, 1, 10), f"{WITH_EDGES}, {EGO} SELECT id, ring FROM ego"),
    "g_top": (lambda c: graph.best_connected(c.edges, 40), f"{WITH_EDGES}, {TOP} SELECT id FROM top"),
    "g_near_dup": (lambda c: _home_pairs(c), f"WITH {HOMES} SELECT a.page_id AS a, b.page_id AS b FROM homes a JOIN homes b ON a.page_id < b.page_id AND a.chars >= 200 AND b.chars >= 200 AND bit_count(xor(a.simhash, b.simhash)) <= 3"),
    "g_version_pairs": (lambda c: graph.simhash_pairs(c.versions.where("simhash <> 0"), 3), "SELECT a.id AS a, b.id AS b FROM page_versions a JOIN page_versions b ON a.id < b.id AND a.simhash <> 0 AND b.simhash <> 0 AND bit_count(xor(a.simhash, b.simhash)) <= 3"),
    "g_louvain": (lambda c: graph.communities(x.graph_edges(c, x.graph_ids(c, most=1500))), None),
    "g_meta_edges": (lambda c: _meta(c), None),
    "g_draw_prune": (lambda c: graph.draw_prune(x.graph_ids(c, most=40), x.graph_edges(c, x.graph_ids(c, most=40)))[0], f"{WITH_EDGES}, {TOP}, e AS (SELECT * FROM edges WHERE src_site_id IN (SELECT id FROM top) AND dst_site_id IN (SELECT id FROM top) AND src_site_id IN (SELECT id FROM sites) AND dst_site_id IN (SELECT id FROM sites)) SELECT DISTINCT id FROM (SELECT src_site_id AS id FROM e UNION ALL SELECT dst_site_id FROM e)"),
}


def _most_used(c: Crawl):
    """The entity with most mentions; its name is two scalars that the plan looks up itself."""
    from pyspark.sql import functions as F

    most = c.entities.where("kind <> 'onion'").groupBy("kind", "value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "value").limit(1)
    return x.entity(c, most.select("kind").scalar(), most.select("value").scalar())


def _rounded(df):
    from pyspark.sql import functions as F

    return df.withColumn("pagerank", F.round("pagerank", 9))


def _components(c: Crawl):
    from pyspark.sql import functions as F

    return graph.labels(graph.components(c.sites, c.edges.select(F.col("src_site_id").alias("a"), F.col("dst_site_id").alias("b"))), True)


def _operators(c: Crawl):
    return graph.labels(graph.components(c.sites, graph.operator_edges(c.entities.join(c.sites.selectExpr("id AS site_id"), "site_id", "left_semi"))), False)


def _home_pairs(c: Crawl):
    homes = graph.home_pages(c.pages, c.versions).where("chars >= 200")
    return graph.simhash_pairs(homes.selectExpr("page_id AS id", "simhash"))


def _meta(c: Crawl):
    e = x.graph_edges(c, x.graph_ids(c, most=1500))
    return graph.community_edges(graph.communities(e), e)


QUERIES = {k: _q(f) for k, (f, _) in _ALL.items()}
SQL = {k: sql for k, (_, sql) in _ALL.items() if sql}
