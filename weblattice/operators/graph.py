"""The graph of sites: edges, ranks, components, operators, neighbourhoods and near-duplicate home pages.

Loops are cut from their lineage through the shared checkpoint folder, so that plans stay short and a lost executor costs no more
than its running tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from weblattice.functions.hashing import hamming
from weblattice.session import cut
from weblattice.sources.snapshots import numbered, upsert

DAMPING, ROUNDS = 0.85, 40
#: Kinds that tell an operator, and the most sites that a value may be on.
OPERATOR_KINDS, OPERATOR_SITES = ("pgp", "email"), (2, 18)
#: Near-duplicate home pages: least length, largest distance, bands, and rows of a key that are compared in one part.
HOME_CHARS, HOME_DISTANCE, BANDS, BLOCK = 200, 3, 4, 1000


def site_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src_site_id, dst_site_id, n_links) between different sites; links off the network are left out."""
    src = pages.select(F.col("id").alias("src_page_id"), F.col("site_id").alias("src_site_id"))
    hop = links.where("dst_site_id IS NOT NULL").select("src_page_id", "dst_site_id").join(src, "src_page_id")
    return hop.where("src_site_id <> dst_site_id").groupBy("src_site_id", "dst_site_id").agg(F.count("*").alias("n_links"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, indeg, outdeg) of every site with an edge, in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst_site_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src_site_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.i").alias("indeg"), F.sum("x.o").alias("outdeg"))


def with_degrees(sites: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return sites.join(d, "id", "left").withColumn("indeg", F.coalesce("indeg", F.lit(0))).withColumn("outdeg", F.coalesce("outdeg", F.lit(0)))


def _series(sums: list[float], n: int, rounds: int, damping: float) -> list[float]:
    """Weights of the powers in the ranks after so many rounds; sums[j] is the sum over all sites of the j-th power."""
    a = [1.0 / n]
    for _ in range(rounds):
        lost = 1.0 - sum(x * s for x, s in zip(a, sums[1:]))
        a = [(1.0 - damping + damping * lost) / n, *(damping * x for x in a)]
    return a


def pagerank(sites: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(id, pagerank) of every site after a fixed number of rounds.

    Links weigh; the rank of sites without outgoing edges is spread over all. Self links and edges with unknown ends are left out.

    As every round is linear, the ranks are a weighted sum of the powers of the matrix of shares, applied to one for every site,
    and the weights depend on the powers' sums only. So a round is one join and one aggregation without any
    global number in between, is read once by the next, and the sums are taken together at the end.
    """
    nodes = cut(sites.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("pagerank", F.lit(0.0))
    e = edges.where("src_site_id <> dst_site_id").join(nodes.withColumnRenamed("id", "src_site_id"), "src_site_id", "left_semi").join(nodes.withColumnRenamed("id", "dst_site_id"), "dst_site_id", "left_semi")
    out = e.groupBy("src_site_id").agg(F.sum("n_links").alias("w"))
    shares = cut(e.join(out, "src_site_id").select(F.col("src_site_id").alias("id"), F.col("dst_site_id").alias("dst"), (F.col("n_links") / F.col("w")).alias("share")))
    power = nodes.withColumn("v", F.lit(1.0))
    powers = []
    for j in range(1, rounds + 1):
        power = cut(shares.join(power, "id").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("v") * F.col("share")).alias("v")))
        powers.append(power.withColumn("j", F.lit(j)))
    if not powers:
        return nodes.withColumn("pagerank", F.lit(1.0 / n))
    every = reduce(DataFrame.unionByName, powers)
    sums = {r.j: r.s for r in every.groupBy("j").agg(F.sum("v").alias("s")).collect()}  # a row per round
    a = _series([float(n), *(sums.get(j, 0.0) for j in range(1, rounds + 1))], n, rounds, damping)
    weight = F.element_at(F.array(*map(F.lit, a[1:])), F.col("j"))
    got = every.groupBy("id").agg(F.sum(F.col("v") * weight).alias("got"))
    return nodes.join(got, "id", "left").select("id", (F.lit(a[0]) + F.coalesce("got", F.lit(0.0))).alias("pagerank"))


def components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root): the least vertex that each vertex is linked to, itself if none.

    Alternating large-star and small-star steps: every vertex is tied to ever smaller ones until only stars are left.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().where("a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = cut(small.select("x.a", "x.b").where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
            return vertices.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        before = now
    raise RuntimeError(f"components were not stable after {max_rounds} rounds")


def labels(roots: DataFrame, keep_single: bool) -> DataFrame:
    """(id, label): groups numbered from 0 by falling size, equal sizes by their least vertex; singles have none unless kept."""
    size = roots.groupBy("root").agg(F.count("*").alias("n"))
    if not keep_single:
        size = size.where("n > 1")
    number = numbered(size, "label", [F.desc("n"), F.asc("root")]).select("root", F.col("label").cast("int").alias("label"))
    return roots.join(number, "root", "left").select("id", "label")


def operator_edges(entities: DataFrame) -> DataFrame:
    """Star edges (a, b) between the sites of each key or mailbox that is on 2 to 18 sites."""
    known = entities.where(F.col("kind").isin(*OPERATOR_KINDS)).select("kind", "value", "site_id").dropna().distinct()
    few = known.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("site_id").alias("a")).where(F.col("n").between(*OPERATOR_SITES))
    return known.join(few, ["kind", "value"]).where("site_id <> a").select("a", F.col("site_id").alias("b"))


def analysis(sites: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(site_id, pagerank, component, operator) of every site."""
    rank = pagerank(sites, edges)
    component = labels(components(sites, edges.select(F.col("src_site_id").alias("a"), F.col("dst_site_id").alias("b"))), True)
    known = sites.select(F.col("id").alias("site_id"))
    operator = labels(components(sites, operator_edges(entities.join(known, "site_id", "left_semi"))), False)
    return rank.join(component.withColumnRenamed("label", "component"), "id").join(operator.withColumnRenamed("label", "operator"), "id").withColumnRenamed("id", "site_id")


def upsert_analysis(old: DataFrame, new: DataFrame, sites: DataFrame, now) -> DataFrame:
    """The stored analysis after a run: its rows in the place of old ones, none of sites that have gone since, and no row of an earlier run.

    An empty run leaves the last one as it is.
    """
    fresh = new.join(sites.select(F.col("id").alias("site_id")), "site_id", "left_semi").withColumn("updated_at", now)
    both = upsert(old, fresh.select(*old.columns), ["site_id"])
    return both.where(F.col("updated_at") >= both.agg(F.max("updated_at")).scalar())


def neighbourhood(edges: DataFrame, center: int, hops: int = 1, limit: int = 250) -> DataFrame:
    """(id, ring) of the centre and what is within so many steps of it, at most limit in all.

    Each ring is ranked by the weight of the edges, in both directions, that tie it to the ring before; ties by id.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("src_site_id").alias("x"), F.col("dst_site_id").alias("id"), "n_links").unionByName(edges.select(F.col("dst_site_id").alias("x"), F.col("src_site_id").alias("id"), "n_links"))
    chosen = spark.range(1).select(F.lit(center).cast("long").alias("id"), F.lit(0).alias("ring"))
    for hop in range(1, min(max(hops, 0), 2) + 1):
        ring = chosen.where(F.col("ring") == hop - 1).select(F.col("id").alias("x"))
        weight = both.join(ring, "x", "left_semi").join(chosen.select("id"), "id", "left_anti").groupBy("id").agg(F.sum("n_links").alias("w"))
        room = F.lit(limit) - chosen.agg(F.count("*")).scalar()
        ranked = weight.orderBy(F.desc("w"), "id").limit(limit).withColumn("at", F.row_number().over(Window.orderBy(F.desc("w"), "id")))
        chosen = chosen.unionByName(ranked.where(F.col("at") <= room).select("id", F.lit(hop).alias("ring")))
    return chosen


def best_connected(edges: DataFrame, limit: int = 250) -> DataFrame:
    """(id) of the sites with most edges, ties by id."""
    ends = edges.select(F.explode(F.array("src_site_id", "dst_site_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(limit).select("id")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(s, t, w): the edges whose ends are both among ids."""
    return edges.join(ids.select(F.col("id").alias("src_site_id")), "src_site_id", "left_semi").join(ids.select(F.col("id").alias("dst_site_id")), "dst_site_id", "left_semi").select(F.col("src_site_id").alias("s"), F.col("dst_site_id").alias("t"), F.col("n_links").alias("w"))


def _parts(n: str):
    """Parts that the rows of a key with so many are dealt to, so that no task compares all of them."""
    return F.ceil(F.col(n) / BLOCK).cast("int")


def near_hashes(hashes: DataFrame, distance: int = HOME_DISTANCE, bands: int = BANDS) -> DataFrame:
    """(ha, hb), ha < hb, of distinct hashes (simhash) that differ in at most ``distance`` < bands bits.

    Such hashes agree in one band of bits at least: they are joined on their bands' values.
    """
    if distance >= bands:
        raise ValueError("one band of each pair must agree: distance has to be below the number of bands")
    width = 64 // bands
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("simhash", width * i).bitwiseAND(F.lit((1 << width) - 1)).alias("key")) for i in range(bands)]))
    keyed = hashes.select("simhash", band.alias("k")).select("simhash", "k.band", "k.key")
    sized = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key", _parts("n").alias("parts"))
    keyed = keyed.join(sized, ["band", "key"])
    a = keyed.select("band", "key", F.col("simhash").alias("ha"), F.pmod(F.xxhash64("simhash"), F.col("parts")).cast("int").alias("part"))
    b = keyed.select("band", "key", F.col("simhash").alias("hb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["band", "key", "part"]).where((F.col("ha") < F.col("hb")) & (hamming(F.col("ha"), F.col("hb")) <= distance)).select("ha", "hb").distinct()


def simhash_pairs(rows: DataFrame, distance: int = HOME_DISTANCE, bands: int = BANDS) -> DataFrame:
    """(a, b), a < b, of rows (id, simhash) whose hashes differ in at most ``distance`` < bands bits.

    Each hash is compared once, however many rows have it; pairs of hashes are written out as pairs of rows at the end.
    """
    rows = rows.where("simhash IS NOT NULL").select("id", "simhash")
    hashes = rows.groupBy("simhash").agg(F.count("*").alias("n"))
    same = hashes.where("n > 1").select(F.col("simhash").alias("ha"), F.col("simhash").alias("hb"))
    pairs = near_hashes(hashes.select("simhash"), distance, bands).unionByName(same)
    parts = hashes.select(F.col("simhash").alias("hb"), _parts("n").alias("parts"))
    left = pairs.join(rows.select(F.col("id").alias("x"), F.col("simhash").alias("ha")), "ha").join(parts, "hb").select("x", "ha", "hb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = rows.withColumnRenamed("simhash", "hb").join(parts, "hb").select("hb", F.col("id").alias("y"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    both = left.join(right, ["hb", "part"]).where("ha <> hb OR x < y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def home_pages(pages: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, page_id, simhash, text_hash, chars): the current home pages; id is the site's."""
    v = versions.select(F.col("id").alias("current_version_id"), "simhash", "text_hash", F.length("text").alias("chars"))
    return pages.where("depth = 0").select(F.col("site_id").alias("id"), F.col("id").alias("page_id"), "current_version_id").join(v, "current_version_id").drop("current_version_id")


def home_clusters(pages: DataFrame, versions: DataFrame, distance: int = HOME_DISTANCE) -> DataFrame:
    """(root, size, exact, ids) of home pages that are near one another; exact where their texts are all the same.

    Only the first page of each hash takes part in the search for groups, the others follow it; ids lists every site of a group.
    """
    homes = cut(home_pages(pages, versions).where((F.col("chars") >= HOME_CHARS) & F.col("simhash").isNotNull()).select(F.col("page_id").alias("id"), F.col("id").alias("site_id"), "simhash", "text_hash"))
    first = cut(homes.groupBy("simhash").agg(F.min("id").alias("id")))
    near = near_hashes(first.select("simhash"), distance)
    edges = near.join(first.toDF("ha", "a"), "ha").join(first.toDF("hb", "b"), "hb").select("a", "b")
    roots = first.join(components(first, edges), "id").select("simhash", "root")
    groups = homes.join(roots, "simhash").groupBy("root").agg(F.count("*").alias("size"), (F.min("text_hash") == F.max("text_hash")).alias("exact"), F.array_sort(F.collect_list("site_id")).alias("ids"))
    return groups.where("size > 1").select("root", "size", "exact", "ids")


def communities(edges: DataFrame, resolution: float = 1.1, least: int = 3, top: int = 24) -> DataFrame:
    """(id, community) by modularity, on a graph that is small by construction (an induced one of at most 1500 sites).

    One group, one task: local moving and aggregation until modularity rests; node order and so the result are deterministic.
    """

    def louvain(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf[["s", "t"]].to_numpy().ravel())
        at = {v: i for i, v in enumerate(ids)}
        w: list[dict[int, float]] = [{} for _ in ids]
        for s, t in {tuple(sorted(p)) for p in pdf[["s", "t"]].itertuples(index=False) if p[0] != p[1]}:
            w[at[s]][at[t]] = w[at[t]][at[s]] = 1.0
        member = list(range(len(ids)))
        total = sum(map(len, w)) or 1
        while True:
            n = len(w)
            comm, k = list(range(n)), [sum(x.values()) for x in w]
            tot, moved = k[:], True
            changed = False
            while moved:
                moved = False
                for i in range(n):
                    near: dict[int, float] = {}
                    for j, x in w[i].items():
                        if j != i:
                            near[comm[j]] = near.get(comm[j], 0.0) + x
                    old = comm[i]
                    tot[old] -= k[i]
                    gain = lambda c: near.get(c, 0.0) - resolution * k[i] * tot[c] / total  # noqa: E731, B023
                    best = max(sorted({old, *near}), key=lambda c: (gain(c) + (1e-12 if c == old else 0.0), -c))
                    tot[best] += k[i]
                    if best != old:
                        comm[i], moved, changed = best, True, True
            if not changed:
                break
            names = {c: i for i, c in enumerate(sorted(set(comm)))}
            member = [names[comm[m]] for m in member]
            new: list[dict[int, float]] = [{} for _ in names]
            for i in range(n):
                for j, x in w[i].items():
                    a, b = names[comm[i]], names[comm[j]]
                    new[a][b] = new[a].get(b, 0.0) + x
            w = new
        sizes = pd.Series(member).value_counts()
        order = [c for c, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])) if n >= least][:top]
        rank = {c: i for i, c in enumerate(order)}
        return pd.DataFrame({"id": ids, "community": [rank.get(c, -1) for c in member]})

    return edges.select(F.lit(0).alias("all"), F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t")).groupBy("all").applyInPandas(louvain, "id long, community int").where("community >= 0")


def draw_prune(nodes: DataFrame, edges: DataFrame, center: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What is drawn: edges between different nodes that are both there, and nodes with such an edge, the centre in any case."""
    e = edges.where("s <> t").join(nodes.select(F.col("id").alias("s")), "s", "left_semi").join(nodes.select(F.col("id").alias("t")), "t", "left_semi")
    used = e.select(F.explode(F.array("s", "t")).alias("id")).distinct()
    kept = nodes.join(used, "id", "left_semi")
    return (kept if center is None else kept.unionByName(nodes.where(F.col("id") == center).join(used, "id", "left_anti"))), e


def community_edges(member: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n): edges between different communities, unordered."""
    m = member.select("id", "community")
    e = edges.join(m.toDF("s", "cs"), "s").join(m.toDF("t", "ct"), "t").where("cs <> ct")
    return e.groupBy(F.least("cs", "ct").alias("a"), F.greatest("cs", "ct").alias("b")).agg(F.count("*").alias("n"))
