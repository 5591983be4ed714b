"""Problem 9: mixing sources to target weights.

Weights are propagated down a tree domain - language - source; what a leaf can't give, its epochs being capped, is asked of its
siblings before it is asked of the leaves of the next ancestor. A leaf's budget is whole epochs of all its documents and a
prefix, counted in tokens, of one more epoch in seeded order. The prefix is found through a histogram of
the order's leading bits, so that only the one bucket in which a budget ends is put in order, however large a source is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weblattice.llm.p3_languages import normal_label
from weblattice.session import cut
from weblattice.sources.tables import spread, table

#: Where the public tokenizers' files are; a parameter of token_counts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary parts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 9
#: Buckets of the seeded order.
BUCKET_BITS = 12

_encoding: dict = {}


def _tokenizer(vocabulary: bytes) -> tiktoken.Encoding:
    key = hash(vocabulary)
    if key not in _encoding:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _encoding[key] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoding[key]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, tokens) with the tokens of a public byte-level BPE; null and empty texts have none.

    The vocabulary's file is read once, on the driver, and broadcast; it has about 0.8 MB.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(shared.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokens"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(count, "doc_id long, source string, lang string, tokens long")


@dataclass
class Leaf:
    """A source in the tree."""

    path: tuple[str, ...]
    share: float
    tokens: int
    repeats: int
    budget: float = 0.0

    @property
    def capacity(self) -> int:
        return self.tokens * max(0, self.repeats)


def _fill(leaves: list[Leaf], amount: float) -> float:
    """Gives amount to the leaves by their shares, as far as they go; what is left over. Exact water-filling."""
    open_ = [x for x in leaves if x.budget < x.capacity and x.share > 0]
    while amount > 1e-9 and open_:
        weight = sum(x.share for x in open_)
        step = min(amount / weight, min((x.capacity - x.budget) / x.share for x in open_))
        for x in open_:
            x.budget += step * x.share
        amount -= step * weight
        open_ = [x for x in open_ if x.capacity - x.budget > 1e-9]
    return max(0.0, amount)


def budgets(leaves: list[Leaf], total: float) -> list[Leaf]:
    """Budgets of all leaves for a mixture of total tokens.

    Every leaf first gets its own share; shortages go to the siblings under the same node by their shares, what these can't take to
    the leaves under the next ancestor, and at last to all.
    """
    weight = sum(x.share for x in leaves) or 1.0
    short: dict[tuple[str, ...], float] = {}
    for x in leaves:
        want = total * x.share / weight
        x.budget = min(want, float(x.capacity))
        short[x.path[:-1]] = short.get(x.path[:-1], 0.0) + want - x.budget
    depth = max((len(x.path) for x in leaves), default=1) - 1
    for d in range(depth, -1, -1):
        up: dict[tuple[str, ...], float] = {}
        for node, amount in sorted(short.items()):
            if len(node) == d:
                left = _fill([x for x in leaves if x.path[:d] == node], amount)
                up[node[:-1]] = up.get(node[:-1], 0.0) + left
            else:
                up[node] = up.get(node, 0.0) + amount
        short = up
    return leaves


def feasible_total(leaves: list[Leaf]) -> float:
    """The largest mixture in which every leaf that has tokens reaches its share of what the leaves with tokens sum to."""
    having = [x for x in leaves if x.capacity > 0 and x.share > 0]
    weight = sum(x.share for x in having)
    return min((x.capacity * weight / x.share for x in having), default=0.0)


def domain(source: str) -> str:
    """A source's domain: what its name has after the last hyphen, such as ``forum``; ``other`` without one."""
    return source.rpartition("-")[2] if "-" in source else "other"


@dataclass
class Plan:
    counts: DataFrame
    leaves: list[Leaf]
    total: float


def plan(spark: SparkSession, d: str, total: float | None = None, vocabulary: str = VOCABULARY) -> Plan:
    """Token counts of the documents of listed sources, and the budgets.

    total is the tokens asked for; None means the largest mixture that reaches all shares. Only sums per listed source reach the
    driver, one row each. Sources without documents stay in the tree with nothing to give; target rows with null
    sources or shares are left out.
    """
    targets = table(spark, d, "mix_targets", "source", "target_share", "max_repeats").dropna()
    docs = spread(table(spark, d, "documents", "doc_id", "source", "lang", "text")).join(targets.select("source"), "source", "left_semi")
    counts = cut(token_counts(docs, vocabulary))
    by_lang = counts.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"))
    top = by_lang.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max_by("lang", F.when(F.col("lang").isNotNull(), F.col("tokens"))).alias("lang"))
    rows = targets.join(top, "source", "left").orderBy("source").collect()
    leaves = [Leaf((domain(r.source), normal_label(r.lang) or "unknown", r.source), float(r.target_share), int(r.tokens or 0), int(r.max_repeats)) for r in rows]
    want = feasible_total(leaves) if total is None else total
    return Plan(counts, budgets(leaves, want), want)


def select(spark: SparkSession, p: Plan, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, repeats): the chosen documents.

    The last epoch's prefix ends with the last document that fits wholly into the budget.
    """
    rows = []
    for x in p.leaves:
        if x.tokens > 0:
            budget = min(x.budget + 1e-6, float(x.capacity))  # sums of shares may fall short of whole epochs by rounding
            rows.append((x.path[-1], int(budget // x.tokens), budget % x.tokens))
    asked = F.broadcast(spark.createDataFrame(rows, "source string, epochs int, rest double"))  # a row per listed source
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    docs = p.counts.join(asked, "source").withColumn("place", order).withColumn("bucket", F.shiftrightunsigned(F.col("place"), 64 - BUCKET_BITS).cast("int"))
    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))  # at most 2 ** BUCKET_BITS rows per listed source
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("source", "bucket", F.coalesce("before", F.lit(0)).alias("before"), "n")
    placed = docs.join(before, ["source", "bucket"])
    whole = placed.where(F.col("before") + F.col("n") <= F.col("rest")).withColumn("taken", F.lit(True))
    none = placed.where(F.col("before") > F.col("rest")).withColumn("taken", F.lit(False))
    edge = placed.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy(F.col("place") < 0, "place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("taken", F.col("before") + upto <= F.col("rest"))
    cols = ["doc_id", "source", "tokens", (F.col("epochs") + F.col("taken").cast("int")).alias("repeats")]
    return whole.select(*cols).unionByName(edge.select(*cols)).unionByName(none.select(*cols)).where("repeats > 0")


def report(spark: SparkSession, p: Plan, chosen: DataFrame) -> DataFrame:
    """One row per listed source: target and reached share, tokens, documents and the most repeats used."""
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"))
    leaves = spark.createDataFrame([(x.path[-1], x.path[0], x.path[1], x.share, x.repeats, x.tokens, float(x.budget)) for x in p.leaves], "source string, domain string, lang string, target_share double, max_repeats int, available_tokens long, budget double")
    total = got.agg(F.sum("tokens")).scalar()
    return leaves.join(got, "source", "left").select(
        "source", "domain", "lang", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / total, 6).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "available_tokens",
        F.round("budget", 3).alias("budget"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats, for the largest mixture that reaches all shares."""
    return select(spark, plan(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """What p9_mix reaches, by source."""
    p = plan(spark, d)
    return report(spark, p, select(spark, p))


def p9_shares_all(spark: SparkSession, d: str) -> DataFrame:
    """What a mixture as large as one epoch of all listed sources reaches: shortages are redistributed through the tree."""
    p = plan(spark, d)
    p.total = float(sum(x.tokens for x in p.leaves))
    budgets(p.leaves, p.total)
    return report(spark, p, select(spark, p))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_shares_all": p9_shares_all}
