r"""Problem 10: text cut off by a field's limit or a broken transfer.

Lengths of a source's texts, in characters and in bytes, have a discrete hazard: of the texts at least that long, the share that ends
there. A limit shows as a hazard far beyond that of the neighbouring lengths, each with its own survivors; each is tested
by the log-likelihood ratio with false-discovery control. Endings are then read from the last line: at significant lengths
whatever didn't end on its own is cut. A transfer breaks off at any length, so elsewhere what stops inside a sentence or word is
cut as well; p10_sources counts both apart. All of it is built-in expressions; a text is read once, and a few numbers of it are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weblattice.llm.significance import g_squared, significant_from
from weblattice.session import cut
from weblattice.sources.tables import table

FDR = 0.001
#: Neighbouring lengths: from NEAR to FAR apart on either side.
NEAR, FAR = 5, 80
#: Least number of texts of one length, and least multiple of the neighbours' hazard, that make a limit.
MIN_TEXTS, MIN_RATIO = 4, 6.0
#: A last line that so many texts share (and this share of all texts) is a closing phrase.
CLOSING_TEXTS, CLOSING_SHARE = 3, 2e-4

#: Marks that are put after a cut.
_MORE = r"\s*\((?i:more|read more|weiterlesen|mehr|suite|lire la suite|más|leer más|mais|altro|continua|meer|далее|ещё)\)"
_MARKS = rf"(?:{_MORE}|\s*\[\s*(?:…|\.\.\.)\s*\]|\s*(?:…|\.\.\.+))\s*$"
_LOST = "�+\\s*$"
_MARKUP = r"(?:\s*&#?[A-Za-z0-9]{0,8};?|\s*</?[A-Za-z!][^<>]{0,80}>?|\s*</?)$"
#: Sentence ends, with closing quotes and brackets.
_ENDED = r"[.!?…。！？]['\"”“»«)\]’\s]*$"
#: Lines that end on their own without a full stop.
_SIGNATURE = r"^\s*(?:--+|[—–~])\s*\S+(?:\s\S+){0,2}\s*$"
_SIGNED = r"[.!?]['\"”»)]*\s+(?:--?|[—–])\s*\S+(?:\s\S+){0,2}$"
_ADDRESS = r"(?:\S@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}|://\S*\.onion(?:[/?#:]\S*)?|://[\w-]+(?:\.[\w-]+)+(?:[/?#:]\S*)?|:\s*(?=\w*\d)\w{14,})[.)\]>]?$"
_LINKS = r"^\s*\[.*\]\s*$|\S\s+[|·•»]\s+\S.*\S\s+[|·•»]\s+\S"
_LIST = r"^\s*(?:[*•·▪+-]|\d{1,3}[.)])\s+\S+(?:\s\S+){0,7}$"
_ASIDE = r"^\s*[(\[].*[)\]]\s*$"
#: Closing phrases, as letters only.
_CLOSINGS = ("tobecontinued", "andsoon", "morenextweek", "theend", "end", "thanksforreading", "fortsetzungfolgt", "àsuivre", "continuará", "continua", "wordtvervolgd", "продолжениеследует", "finis", "fin", "ende")


def endings(docs: DataFrame) -> DataFrame:
    """(doc_id, source, chars, bytes, ended, natural, torn, phrase) of every document with text; nulls and blank texts are left out.

    ended: the last line ends as a sentence does. natural: it ends on its own in another way. torn: a mark of a broken
    transfer follows. phrase: the letters of a short last line that did not end, as a possible closing phrase.
    """
    last = F.substring_index(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), "\n", -1)
    base = docs.where("text IS NOT NULL").select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("same"), last.alias("line")).where("line <> ''")
    torn = F.col("line").rlike(_LOST) | F.col("line").rlike(_MARKUP) & ~F.col("line").rlike(_ADDRESS)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("line"), _LOST, ""), _MARKUP, ""), _MARKS, "")
    base = base.withColumn("torn", torn).withColumn("marked", F.col("line").rlike(_MARKS)).withColumn("body", body)
    opened = F.length(F.regexp_replace("body", r"[^(]", "")) > F.length(F.regexp_replace("body", r"[^)]", ""))
    natural = F.lit(False)
    for p in (_SIGNATURE, _SIGNED, _ADDRESS, _LINKS, _LIST, _ASIDE):
        natural = natural | F.col("line").rlike(p)
    letters = F.lower(F.regexp_replace("body", r"[^\p{L}]+", ""))
    short = (F.size(F.split(F.trim("body"), r"\s+")) <= 6) & (F.length("body") <= 60)
    return base.select(
        "doc_id", "source", "chars", "bytes", "same", "torn", "marked",
        (F.col("body").rlike(_ENDED) & ~opened).alias("ended"),
        (natural & ~(F.col("marked") & ~F.col("line").rlike(_ASIDE) & ~F.col("line").rlike(_LINKS))).alias("natural"),
        F.when(short & ~F.col("torn"), letters).alias("phrase"),
    )


def hazards(ends: DataFrame) -> DataFrame:
    """(source, unit, size, n, at_risk, n_near, risk_near): how many texts end at a length and how many are at least that long, there and summed over the neighbouring lengths.

    unit is ``chars`` or ``bytes``. Null sources count as one source, copies of a text as one text. Windows run over the distinct lengths of a source.
    """
    texts = ends.select(F.coalesce("source", F.lit("")).alias("source"), "chars", "bytes", "same").distinct()
    sizes = texts.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("x")).groupBy("source", F.col("x.unit").alias("unit"), F.col("x.size").alias("size")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("source", "unit").orderBy("size")
    # from the longest down: such a frame only grows, while one without an end would be summed anew for each length
    down = Window.partitionBy("source", "unit").orderBy(F.desc("size"))
    survivors = lambda first: F.coalesce(F.sum("n").over(down.rangeBetween(Window.unboundedPreceding, -first)), F.lit(0))
    h = sizes.withColumn("size", F.col("size").cast("long")).withColumn("before", F.coalesce(F.lag("size").over(of), F.lit(0))).withColumn("at_risk", survivors(0))
    h = h.withColumn("trials", F.col("at_risk") * (F.col("size") - F.col("before")))  # one at each length since the last one at which a text ended
    near, risk = [], []
    for first, last in ((-FAR, -NEAR), (NEAR, FAR)):
        w = of.rangeBetween(first, last)
        a, z = F.greatest(F.col("size") + first, F.lit(1)), F.col("size") + last
        least, most = F.min(F.struct("size", "before", "at_risk")).over(w), F.max("size").over(w)
        # the trials at the lengths from a to z: up to each length in the window at which a text ends, and beyond the last of them
        within = F.sum("trials").over(w) - least["at_risk"] * F.greatest(a - 1 - least["before"], F.lit(0)) + survivors(last + 1) * (z - most)
        near.append(F.coalesce(F.sum("n").over(w), F.lit(0)))
        risk.append(F.coalesce(within, survivors(last + 1) * F.greatest(z - a + 1, F.lit(0))))
    h = h.withColumn("n_near", near[0] + near[1]).withColumn("risk_near", F.greatest(risk[0] + risk[1], F.col("n_near"), F.lit(1)))
    return h.select("source", "unit", "size", "n", "at_risk", "n_near", "risk_near")


def limits(ends: DataFrame, fdr: float = FDR) -> DataFrame:
    """(source, unit, size, n, g2): lengths at which a source's texts end significantly more often than at the neighbouring ones."""
    scored = hazards(ends).withColumn("g2", g_squared(F.col("n"), F.col("at_risk"), F.col("n_near"), F.col("risk_near")))
    scored = cut(scored)
    m = scored.agg(F.count("*")).scalar()
    least = significant_from(scored, m, fdr)
    ratio = (F.col("n") / F.col("at_risk")) / ((F.col("n_near") + 0.5) / F.col("risk_near"))
    return scored.where((F.col("g2") >= least) & (F.col("n") >= MIN_TEXTS) & (ratio >= MIN_RATIO)).select("source", "unit", "size", "n", "g2")


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, source, at_limit, cut) of every document with text."""
    ends = cut(endings(docs))
    found = limits(ends)
    n_all = ends.agg(F.count("*")).scalar()
    common = (
        ends.where("phrase IS NOT NULL AND phrase <> '' AND NOT natural AND (NOT ended OR marked)")
        .select("phrase", "same").distinct().groupBy("phrase").agg(F.count("*").alias("texts"))
        .where((F.col("texts") >= CLOSING_TEXTS) & (F.col("texts") >= n_all * CLOSING_SHARE))
        .select("phrase", F.lit(True).alias("closing"))
    )
    e = ends.withColumn("phrase", F.coalesce(F.when(F.col("phrase") != "", F.col("phrase")), F.concat(F.lit("#"), F.col("doc_id").cast("string"))))
    e = e.withColumn("source_key", F.coalesce("source", F.lit("")))
    by = {u: found.where(F.col("unit") == u).select(F.col("source").alias("source_key"), F.col("size").cast("int").alias(u), F.lit(True).alias(f"limit_{u}")) for u in ("chars", "bytes")}
    e = e.join(common, "phrase", "left").join(by["chars"], ["source_key", "chars"], "left").join(by["bytes"], ["source_key", "bytes"], "left")
    at_limit = F.coalesce("limit_chars", "limit_bytes", F.lit(False))
    closing = F.coalesce("closing", F.lit(False)) | F.col("phrase").isin(*_CLOSINGS)
    stops = F.col("torn") | at_limit & ~F.col("ended") | ~F.col("ended") & ~F.col("natural") & ~closing
    return e.select("doc_id", "source", at_limit.alias("at_limit"), stops.alias("cut"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose text was cut off."""
    return truncated(table(spark, d, "documents", "doc_id", "source", "text")).where("cut").select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents with text, those cut off, those of them at one of the source's limits and elsewhere, and the share cut off."""
    t = truncated(table(spark, d, "documents", "doc_id", "source", "text"))
    return t.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_at_limit"), F.count_if(F.col("cut") & ~F.col("at_limit")).alias("n_broken")).withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_documents"), 6))


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    """The lengths at which sources cut, with the evidence."""
    return limits(endings(table(spark, d, "documents", "doc_id", "source", "text"))).select("source", "unit", F.col("size").cast("long").alias("size"), "n", F.round("g2", 3).alias("g2"))


QUERIES = {"p10_found": p10_found, "p10_sources": p10_sources, "p10_limits": p10_limits}
