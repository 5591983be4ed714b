"""Consolidating pairwise matches into groups by hash-to-min.

The cluster sets are rows (vertex, member), never arrays, so that no set, however large, has to
fit into one task: a round is one aggregation (the least member of every set) and one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weblattice.session import cut


def star_edges(pairs: DataFrame, key: list[str], vertex: str) -> DataFrame:
    """Edges (a, b) that tie all vertices with the same key to the least of them.

    A key with n vertices gives n - 1 edges instead of n (n - 1) / 2 pairs. Rows with a null key or vertex are left out.
    """
    clean = pairs.dropna(subset=[*key, vertex]).select(*key, vertex).distinct()
    least = clean.groupBy(*key).agg(F.min(vertex).alias("__least"))
    return clean.join(least, key).where(F.col(vertex) != F.col("__least")).select(F.col("__least").alias("a"), F.col(vertex).alias("b"))


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(vertex, group_id) of every vertex that has an edge; group_id is the least vertex it is linked to.

    In each round every vertex sends its whole set to the set's least member and that least member to
    all others, until no row changes. Rounds grow as the logarithm of a chain's length. Self links,
    repeated and reversed edges and edges with a null end are harmless; an empty table gives no rows.
    Each round is cut from its lineage through the shared checkpoint folder.
    """
    e = edges.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("u")).dropna().where("v <> u")
    sets = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
    sets = cut(sets.unionByName(sets.select("v", F.col("v").alias("u"))).distinct())
    before = None
    for _ in range(max_rounds):
        least = sets.groupBy("v").agg(F.min("u").alias("m"))
        sent = sets.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
        sets = cut(sent.select("x.v", "x.u").distinct())
        state = sets.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            return sets.groupBy("v").agg(F.min("u").alias("group_id")).select(F.col("v").alias("vertex"), "group_id")
        before = state
    raise RuntimeError(f"hash-to-min was not stable after {max_rounds} rounds")
