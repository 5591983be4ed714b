"""The crawl tables of one folder, and expressions that many queries share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weblattice.functions.fetching import ALIVE
from weblattice.operators import graph
from weblattice.schema import TABLES
from weblattice.session import cut
from weblattice.sources.tables import table

_analyses: dict[tuple[str, str], DataFrame] = {}


def truncated(unit: str, ts: Column) -> Column:
    """date_trunc of a time without zone, without one."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


class Crawl:
    """Tables are read when first asked for; ``as_of`` is the log's last time, in the place of now()."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def sites(self) -> DataFrame:
        return self.table("sites")

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def versions(self) -> DataFrame:
        return self.table("page_versions")

    @cached_property
    def links(self) -> DataFrame:
        return self.table("links")

    @cached_property
    def entities(self) -> DataFrame:
        return self.table("entities")

    @cached_property
    def log(self) -> DataFrame:
        return self.table("fetch_log")

    @cached_property
    def frontier(self) -> DataFrame:
        """The queue; a folder without one has nothing queued."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/frontier.parquet")
        if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.table("frontier")
        return self.spark.createDataFrame([], TABLES["frontier"])

    @property
    def as_of(self) -> Column:
        """The log's last time, as a scalar subquery."""
        return self.log.agg(F.max("ts")).scalar()

    @cached_property
    def edges(self) -> DataFrame:
        return graph.site_edges(self.links, self.pages)

    def since(self, interval: str) -> DataFrame:
        """The log after as_of less an interval, the bound left out."""
        as_of = self.log.agg(F.max("ts")).scalar()
        return self.log.where(F.col("ts") > as_of - F.expr(f"INTERVAL {interval}"))

    @property
    def analysis(self) -> DataFrame:
        """Ranks, components and operators, computed once for a session and folder and kept in the checkpoint folder."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _analyses:
            _analyses[key] = cut(graph.analysis(self.sites, self.edges, self.entities))
        return _analyses[key]


def site_columns(s: DataFrame) -> list[Column]:
    """The columns by which every list names a site."""
    return [s["id"], s["onion"], F.coalesce(s["title"], F.lit("")).alias("title"), s["status"]]


#: SQL of the edges of sites, for the oracles.
EDGES = "edges AS (SELECT p.site_id AS src_site_id, l.dst_site_id, count(*) AS n_links FROM links l JOIN pages p ON p.id = l.src_page_id WHERE l.dst_site_id IS NOT NULL AND l.dst_site_id <> p.site_id GROUP BY 1, 2)"
DEGREES = "deg AS (SELECT id, CAST(sum(i) AS BIGINT) AS indeg, CAST(sum(o) AS BIGINT) AS outdeg FROM (SELECT dst_site_id AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src_site_id, 0, 1 FROM edges) GROUP BY 1)"
AS_OF = "(SELECT max(ts) FROM fetch_log)"
SITE = "s.id, s.onion, coalesce(s.title, '') AS title, s.status"
#: Ranks by 40 rounds over the dense matrix of transitions, components and operators by reachability: for small tables only.
ANALYSIS = f"""
{EDGES}, {DEGREES},
known AS (SELECT * FROM edges WHERE src_site_id IN (SELECT id FROM sites) AND dst_site_id IN (SELECT id FROM sites)),
outw AS (SELECT src_site_id, sum(n_links) AS w FROM known GROUP BY 1),
nn AS (SELECT count(*) AS n FROM sites),
trans AS (SELECT a.id AS s, b.id AS t, CASE WHEN o.w IS NULL THEN 1.0 / n ELSE coalesce(k.n_links / o.w, 0) END AS p
  FROM sites a CROSS JOIN sites b CROSS JOIN nn LEFT JOIN outw o ON o.src_site_id = a.id LEFT JOIN known k ON k.src_site_id = a.id AND k.dst_site_id = b.id),
pr AS (SELECT 0 AS i, id, 1.0::DOUBLE / n AS r FROM sites CROSS JOIN nn UNION ALL
  SELECT pr.i + 1, t.t, 0.15 / n + 0.85 * sum(pr.r * t.p) FROM pr JOIN trans t ON t.s = pr.id CROSS JOIN nn WHERE pr.i < 40 GROUP BY pr.i, t.t, n),
ce AS (SELECT src_site_id AS a, dst_site_id AS b FROM known UNION SELECT dst_site_id, src_site_id FROM known),
cr AS (SELECT id AS a, id AS b FROM sites UNION SELECT cr.a, ce.b FROM cr JOIN ce ON ce.a = cr.b),
croot AS (SELECT a AS id, min(b) AS root FROM cr GROUP BY 1),
cl AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS label FROM croot GROUP BY root),
ok AS (SELECT DISTINCT kind, value, site_id FROM entities WHERE kind IN ('pgp', 'email') AND value IS NOT NULL AND site_id IN (SELECT id FROM sites)),
oka AS (SELECT DISTINCT kind, value, site_id FROM ok),
few AS (SELECT kind, value FROM oka GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 18),
oe AS (SELECT DISTINCT x.site_id AS a, y.site_id AS b FROM oka x JOIN few USING (kind, value) JOIN oka y USING (kind, value)),
orr AS (SELECT id AS a, id AS b FROM sites UNION SELECT orr.a, oe.b FROM orr JOIN oe ON oe.a = orr.b),
oroot AS (SELECT a AS id, min(b) AS root FROM orr GROUP BY 1),
ol AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS label FROM oroot GROUP BY root HAVING count(*) > 1),
analysis AS (SELECT s.id AS site_id, pr.r AS pagerank, cl.label AS component, ol.label AS operator FROM sites s JOIN pr ON pr.id = s.id AND pr.i = 40
  JOIN croot c ON c.id = s.id JOIN cl ON cl.root = c.root JOIN oroot o ON o.id = s.id LEFT JOIN ol ON ol.root = o.root)"""
WITH_ANALYSIS = f"WITH RECURSIVE {ANALYSIS}"


_ALIVE = "(" + ", ".join(f"'{x}'" for x in ALIVE) + ")"
#: The state of every site with logged fetches, from never seen.
LIVE = f"""WITH l AS (SELECT f.site_id, f.ts, f.outcome, s.first_seen, f.outcome IN {_ALIVE} AS alive FROM fetch_log f JOIN sites s ON s.id = f.site_id),
o AS (SELECT site_id, max((ts, outcome)) AS ok FROM l WHERE alive GROUP BY 1),
a AS (SELECT l.site_id, first_seen, o.ok, max((ts, outcome)) AS last, count(*) FILTER (WHERE o.ok IS NULL OR (ts, outcome) > o.ok) AS fails FROM l LEFT JOIN o USING (site_id) GROUP BY 1, 2, 3),
b AS (SELECT site_id, first_seen, ok[1] AS ok_ts, last[1] AS ts, last[2] AS outcome, ok IS NOT NULL AND last = ok AS up, fails, coalesce(ok[1], first_seen) < last[1] - INTERVAL 30 DAY AS old FROM a)
SELECT site_id AS id, CASE WHEN up THEN 'up' WHEN outcome = 'auth_required' THEN 'auth_gated' WHEN old THEN 'dead' WHEN outcome = 'desc_not_found' THEN 'down' ELSE 'flaky' END AS status,
CAST(CASE WHEN up THEN 0 ELSE fails END AS INTEGER) AS consecutive_failures, ts AS last_seen, ok_ts AS last_ok,
ts + CASE WHEN up THEN INTERVAL 24 HOUR WHEN outcome = 'auth_required' OR old THEN INTERVAL 30 DAY WHEN outcome = 'desc_not_found' THEN to_seconds(least(3600 * pow(2, least(fails - 1, 8)), 604800)) ELSE INTERVAL 6 HOUR END AS next_check_at FROM b"""
