"""Problem 4: page versions whose texts agree but for small edits.

Each text gets a signature of COORDINATES coordinates, each of which combines JOINED minima of permuted shingle hashes. Texts are posted
under (coordinate, value), and the lists of postings are joined with themselves. A pair is kept that collides in MATCHES coordinates or
more. The SKIPPED longest lists of a text are not merged, only its prefix of the others. As lists have one order for all texts, the
shared list of rank r, from the longest, has at least rank r in either text: all but SKIPPED of a pair's collisions are in both prefixes. So
pairs with MATCHES - SKIPPED collisions there are probed on their signatures, and lose none. Kept pairs are verified on their exact
shingle sets. Equal texts are posted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weblattice.llm.linking import hash_to_min
from weblattice.llm.words import WordHashes, shingle_hashes, words
from weblattice.session import cut
from weblattice.sources.tables import spread, table

SHINGLE, THRESHOLD, MIN_CHARS = 3, 0.7, 200
#: A pair at the threshold collides in a coordinate with probability 0.7 ** 2 = 0.49; fewer than 6 of 32 collisions happen in 1 of 10,000 such pairs.
COORDINATES, JOINED, MATCHES = 32, 2, 6
#: Longest lists of a text that are skipped. The more, the fewer are merged, but the less the collisions in the prefix tell.
SKIPPED = 3
#: Texts of a list that are merged in one part.
BLOCK = 1000

_rng = np.random.default_rng(4)
_MUL = (_rng.integers(1, 2**63, COORDINATES * JOINED, np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, COORDINATES * JOINED, np.uint64)
_MIX = (_rng.integers(1, 2**62, JOINED, np.uint64) << np.uint64(1)) | np.uint64(1)
_CHUNK = 1 << 16


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of COORDINATES values per text; flat has the texts' shingle hashes one after the other, starts where each begins (none empty)."""
    out = np.empty((len(starts), COORDINATES), np.int64)
    for c in range(COORDINATES):
        key = np.full(len(starts), c, np.uint64)
        for j in range(JOINED):
            k = c * JOINED + j
            # the product's upper half decides the order
            low = np.minimum.reduceat((flat * _MUL[k] + _ADD[k]) >> np.uint64(16), starts)
            key = (key ^ low) * _MIX[j]
            key ^= key >> np.uint64(31)
        out[:, c] = key.view(np.int64)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        ids, pages, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for at in range(0, len(ids), 512):
            keep, parts, same = [], [], []
            for k, text in enumerate(texts.slice(at, 512).to_pylist(), at):
                h = np.fromiter(map(cache.__getitem__, words(text)), np.uint64)
                s = shingle_hashes(h, SHINGLE)
                if len(s):
                    keep.append(k)
                    parts.append(s)
                    same.append(int((s * (np.arange(len(s), dtype=np.uint64) * np.uint64(2) + np.uint64(0x2545F4914F6CDD1D))).sum(dtype=np.uint64)) & (2**63 - 1))
            if not keep:
                continue
            starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
            sig = signatures(np.concatenate(parts), starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in keep], pa.int64()), pa.array([pages[k] for k in keep], pa.int64()), pa.array(same, pa.int64()), pa.ListArray.from_arrays(np.arange(0, (len(keep) + 1) * COORDINATES, COORDINATES, dtype=np.int32), sig.ravel())],
                ["id", "page_id", "same", "sig"],
            )


def signed(versions: DataFrame) -> DataFrame:
    """(id, page_id, same, sig): versions with at least MIN_CHARS characters and SHINGLE words; ``same`` is equal for equal word sequences.

    Null texts give no row. The table is small beside the texts (200 bytes a row) and is cut from its lineage, so that the texts are parsed once.
    """
    long = versions.where(F.length("text") >= MIN_CHARS).select("id", "page_id", "text")
    return cut(spread(long).mapInArrow(_sign, "id long, page_id long, same long, sig array<long>"))


def copies(sig: DataFrame) -> DataFrame:
    """(id, rep, lo, hi) of the signed versions whose words another one has too: the least of them, and the least and largest of their pages."""
    named = sig.select("id", "page_id", "same", F.element_at("sig", 1).alias("s1"))
    groups = named.groupBy("same", "s1").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).where("n > 1")
    return cut(named.select("id", "same", "s1").join(groups.drop("n"), ["same", "s1"]).select("id", "rep", "lo", "hi"))


def members(sig: DataFrame, copied: DataFrame) -> DataFrame:
    """(rep, id, page_id): every signed version with the least version of the same words."""
    return sig.select("id", "page_id").join(copied.select("id", "rep"), "id", "left").select(F.coalesce("rep", "id").alias("rep"), "id", "page_id")


def _merged(prefix: DataFrame) -> DataFrame:
    """(a, b), a < b, of the texts that have MATCHES - SKIPPED lists of prefix (rep, key, n) in common.

    Lists of more than BLOCK texts are dealt out in parts, so that no task merges all of such a list; the others are joined as they are,
    whose exchange serves both sides.
    """
    short = prefix.where(F.col("n") <= BLOCK).select("rep", "key")
    few = short.toDF("a", "key").join(short.toDF("b", "key"), "key").where("a < b").select("a", "b")
    long = prefix.where(F.col("n") > BLOCK).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    a = long.select(F.col("rep").alias("a"), "key", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"))
    b = long.select(F.col("rep").alias("b"), "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return few.unionByName(a.join(b, ["key", "part"]).where("a < b").select("a", "b")).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= MATCHES - SKIPPED).select("a", "b")


def candidates(sig: DataFrame, copied: DataFrame) -> DataFrame:
    """(a, b), a < b: representatives that collide in MATCHES coordinates or more and are not all of one page.

    Lists of one text are dropped before anything is joined. Signatures stay where they are but for those of the pairs found.
    """
    # the page that all copies are of, or else the representative's id made negative, which equals no other
    only = F.when(F.coalesce("lo", "page_id") == F.coalesce("hi", "page_id"), F.coalesce("lo", "page_id")).otherwise(-F.col("id") - 1)
    reps = sig.join(copied, "id", "left").where("rep IS NULL OR rep = id").select(F.col("id").alias("rep"), only.alias("only"), "sig")
    posts = reps.select("rep", F.explode("sig").alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # lists in one order for all texts; those of one text, which are left out, would be the shortest
    longest_first = Window.partitionBy("rep").orderBy(F.desc("n"), F.desc("key"))
    prefix = cut(posts.join(lists, "key").withColumn("place", F.row_number().over(longest_first)).where(F.col("place") > SKIPPED).select("rep", "key", "n"))
    hits = cut(_merged(prefix))
    ends = hits.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    found = reps.join(ends, "rep", "left_semi")
    both = hits.join(found.toDF("a", "only_a", "sig_a"), "a").join(found.toDF("b", "only_b", "sig_b"), "b").where("only_a <> only_b")
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.where(same >= MATCHES).select("a", "b")


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()

    def grams(text):
        return np.unique(shingle_hashes(np.fromiter(map(cache.__getitem__, words(text)), np.uint64), SHINGLE))

    for batch in batches:
        out, last, sa = [], None, None
        for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if ta is not last:
                last, sa = ta, grams(ta)
            sb = grams(tb)
            both = len(np.intersect1d(sa, sb, assume_unique=True))
            out.append(both / max(1, len(sa) + len(sb) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "jaccard"])


def verified(pairs: DataFrame, versions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard) of the pairs whose distinct shingles agree by threshold or more."""
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    text = cut(versions.where(F.length("text") >= MIN_CHARS).select("id", "text").join(wanted, "id", "left_semi"))  # only these texts move
    both = pairs.join(text.toDF("a", "text_a"), "a").join(text.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_jaccard, "a long, b long, jaccard double").where(F.col("jaccard") >= threshold)


def near_duplicates(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives that agree, membership of every version in its group of equal texts)."""
    sig = signed(versions)
    copied = copies(sig)
    return verified(candidates(sig, copied), versions), members(sig, copied)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of versions of different pages that agree; groups of equal texts are compared once and written out as pairs at the end."""
    versions = table(spark, d, "page_versions", "id", "page_id", "text")
    pairs, all_members = near_duplicates(versions)
    m = all_members
    left = pairs.join(m.toDF("a", "x", "page_x"), "a").join(m.toDF("b", "y", "page_y"), "b")
    equal = m.toDF("a", "x", "page_x").join(m.toDF("a", "y", "page_y"), "a").where("x < y")
    both = left.select("x", "y", "page_x", "page_y").unionByName(equal.select("x", "y", "page_x", "page_y")).where("page_x <> page_y")
    return both.select(F.least("x", "y").alias("version_a"), F.greatest("x", "y").alias("version_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per version long enough to compare: the least version it is linked to, and the number of representatives its own one agrees with.

    Copies are not written out as pairs: a version is tied to its representative and representatives to one another.
    """
    pairs, m = near_duplicates(table(spark, d, "page_versions", "id", "page_id", "text"))
    pairs = cut(pairs)
    groups = hash_to_min(pairs).withColumnRenamed("vertex", "rep")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return m.join(groups, "rep", "left").join(ends, "rep", "left").select(F.col("id").alias("version_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


SQL = {
    "p4_found": r"""
WITH t AS (SELECT id, page_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM page_versions WHERE length(text) >= 200),
s AS (SELECT DISTINCT id, page_id, g FROM (SELECT id, page_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id AND a.page_id <> b.page_id GROUP BY 1, 2)
SELECT a AS version_a, b AS version_b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.7 * (x.n + y.n - c)"""
}
QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
