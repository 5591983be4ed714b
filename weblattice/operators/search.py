"""Full-text search: an inverted index and BM25 over two fields, of which the better counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from weblattice.functions.words import plain, words, WORD

K1, B = 1.2, 0.75
BOOST = {"title": 3.0, "text": 1.0}
PAGE, MAX_FROM = 25, 9900
#: Runs of letters and decimal digits.
WORDS = r"[\p{L}\p{Nd}]+"
FRAGMENTS, FRAGMENT_CHARS, OPEN, CLOSE = 2, 160, "\u0001", "\u0002"


def documents(pages: DataFrame, versions: DataFrame) -> DataFrame:
    """(page_id, site_id, url, title, text) of the current versions."""
    v = versions.select(F.col("id").alias("current_version_id"), "title", "text")
    return pages.select(F.col("id").alias("page_id"), "site_id", "url", "current_version_id").join(v, "current_version_id").drop("current_version_id")


def inverted(docs: DataFrame) -> DataFrame:
    """(term, field, page_id, tf, length): the postings. Null fields have none.

    A document's words are counted where it is read, so that a posting is shuffled once however often its term occurs.
    """
    each = None
    for f in BOOST:
        part = docs.where(F.col(f).isNotNull()).select("page_id", F.lit(f).alias("field"), F.regexp_extract_all(f, F.lit(f"({WORDS})"), F.lit(1)).alias("words"))
        each = part if each is None else each.unionByName(part)
    one = each.select("page_id", "field", F.size("words").alias("length"), F.explode("words").alias("word"))
    term = F.lower(F.replace("word", F.lit("Σ"), F.lit("σ")))
    return one.groupBy(term.alias("term"), "field", "page_id", "length").agg(F.count("*").cast("int").alias("tf")).select("term", "field", "page_id", "tf", "length")


def statistics(index: DataFrame) -> DataFrame:
    """(field, n_docs, mean_length): a row per field."""
    return index.select("field", "page_id", "length").distinct().groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))


def search(index: DataFrame, docs: DataFrame, q: str, start: int = 0, size: int = PAGE) -> DataFrame:
    """One page of hits by falling score, ties by page: (page_id, site_id, url, title, score, total, snippets).

    Only the query's terms are read from the index; hits are cut before they are joined with their texts. A blank query has none.
    """
    terms = list(dict.fromkeys(words(q.strip())))
    start = min(max(start, 0), MAX_FROM)
    hits = index.where(F.col("term").isin(*terms) if terms else F.lit(False))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(statistics(index)), "field")  # a row per term and field
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    boost = F.create_map(*[F.lit(x) for kv in BOOST.items() for x in kv])
    by_field = scored.groupBy("page_id", "field").agg(F.sum(idf * tf * F.element_at(boost, F.col("field"))).alias("score"))
    best = by_field.groupBy("page_id").agg(F.round(F.max("score"), 6).alias("score"))
    total = best.agg(F.count("*")).scalar()
    page = best.orderBy(F.desc("score"), "page_id").offset(start).limit(size)
    return docs.join(F.broadcast(page), "page_id").select("page_id", "site_id", "url", F.coalesce("title", F.lit("")).alias("title"), "score", total.alias("total"), snippets(terms)(F.col("text")).alias("snippets")).orderBy(F.desc("score"), "page_id")


def snippet(text: str | None, terms: set[str]) -> list[str]:
    """At most FRAGMENTS pieces of the text around the first hits, hits between marks."""
    out: list[str] = []
    if not text:
        return out
    spans = [m.span() for m in WORD.finditer(plain(text)) if m.group().lower() in terms]
    i = 0
    while i < len(spans) and len(out) < FRAGMENTS:
        a = max(0, spans[i][0] - FRAGMENT_CHARS // 4)
        b = min(len(text), a + FRAGMENT_CHARS)
        piece, at = "", a
        while i < len(spans) and spans[i][1] <= b:
            s, e = spans[i]
            piece += text[at:s] + OPEN + text[s:e] + CLOSE
            at, i = e, i + 1
        if at == a:  # a word longer than a fragment
            i += 1
            continue
        out.append(" ".join((piece + text[at:b]).split()))
    return out


def snippets(terms: list[str]):
    wanted = set(terms)

    @pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: snippet(t, wanted))

    return cut


def delete_site(index: DataFrame, docs: DataFrame, site_id: int) -> tuple[DataFrame, DataFrame]:
    """The index and its documents without a site's."""
    kept = docs.where(F.col("site_id") != site_id)
    return index.join(kept.select("page_id"), "page_id", "left_semi"), kept
