"""Problem 5: pages made of keywords, tags or links.

A site's repeated lines are set aside. A page's language is the one most of whose function words it has; each of its lines is judged by
shares whose thresholds are calibrated on the labelled samples of that language: function words, separators, repeated words and n-grams,
links and tags. A page is spam where the judged lines are mostly such and prose is a small part of them; a lesser part is enough where
duplicate lines, separators or link names make much of the page. The links table adds the share of the text that is link names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weblattice.llm.p6_lines import MIN_PAGES, MIN_SHARE, letters_of, line_keys
from weblattice.llm.sampling import labelled
from weblattice.sources.tables import table

#: Words that stand in so many of a language's samples, the most frequent ones of at most so many letters, are its function words.
FUNCTION_SHARE, FUNCTION_WORDS, FUNCTION_LETTERS = 0.2, 16, 7
#: A line of this share of function words or more, relative to its language's low quantile in the samples, is prose.
LOW_QUANTILE = 0.02
#: How much more than the high quantile of prose a line must repeat, and what part of the low quantile of letters a word torn words have.
REPETITION_MARGIN, LETTERS_PART = 0.12, 0.65
#: A line is of another language than its page from so many of that language's function words.
OTHER_LANGUAGE = 2
#: Least words in lines of keywords or links, and their least share among all judged words.
LEAST_WORDS, LEAST_SHARE = 20, 0.55
#: Cover text of more than COVER_WORDS may make at most COVER_SHARE of the judged words.
COVER_WORDS, COVER_SHARE = 110, 0.25
#: A page with so much of its text in link names or bare links needs a lesser share.
LINK_SHARE, LEAST_SHARE_LINKS = 0.5, 0.4
#: So does one with so many duplicate lines, or so many separators a word.
DUPLICATE_SHARE, SEPARATOR_DENSITY = 0.3, 0.25
#: A pair of words that makes so much of a line, three times at least, is a keyword.
PAIR_SHARE = 0.25
#: Lines in a row, each of at most LIST_WORDS words and without function words, or longer and together poor in them, that make a bare list.
LIST_LINES, LIST_WORDS = 6, 5

_WORD = re.compile(r"[^\W\d_]+")
_URL = re.compile(r"\b(?:https?://|www\.)\S+|\b[a-z2-7]{56}(?:\.onion)?\S*")
_TAG = re.compile(r"#\w[\w'-]*")
_SEPARATOR = re.compile(r"\s[|·•*/>»]\s|[;,](?=\s)|\s[–-]\s|·|\|")
_SENTENCE = re.compile(r"[^\W\d_]['\"”»)]*[.!?…]['\"”»)]*(?:\s|$)")


def _quantile(values: list[float], part: float, default: float) -> float:
    return sorted(values)[min(len(values) - 1, int(part * len(values)))] if values else default


@dataclass
class Thresholds:
    """What prose of one language keeps within: from the quantiles of its samples' sentences."""

    low: float  # least share of function words
    repetition: float  # share of repeated words or pairs from which a line is keywords
    part: float  # words between separators up to which a line is keywords
    letters: float  # letters a word below which a line is torn by a wrong charset


class Calibration:
    """Function words by language, and the thresholds of each."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({x for x, _ in samples})
        self.of: dict[str, tuple[int, ...]] = {}  # the languages whose function word a word is
        self.thresholds: list[Thresholds] = []
        sentences = {}
        for k, lang in enumerate(self.languages):
            texts = [t.lower() for x, t in samples if x == lang]
            df = Counter(w for t in texts for w in set(_WORD.findall(t)))
            for w in [w for w, n in df.most_common() if n >= FUNCTION_SHARE * len(texts) and len(w) <= FUNCTION_LETTERS][:FUNCTION_WORDS]:
                self.of[w] = (*self.of.get(w, ()), k)
            sentences[k] = [(ws, line) for t in texts for line in re.split(r"(?<=[.!?])\s|\n", t) if len(ws := _WORD.findall(line)) >= 8]
        pooled = _quantile([_repetition(ws) for of in sentences.values() for ws, _ in of], 1 - LOW_QUANTILE, 0.0)
        for k in range(len(self.languages)):
            of = sentences[k]
            self.thresholds.append(
                Thresholds(
                    max(_quantile([sum(k in self.of.get(w, ()) for w in ws) / len(ws) for ws, _ in of], LOW_QUANTILE, 0.0), 0.02),
                    (_quantile([_repetition(ws) for ws, _ in of], 1 - LOW_QUANTILE, pooled) + pooled) / 2 + REPETITION_MARGIN,
                    _quantile([len(ws) / (len(_SEPARATOR.findall(line)) + 1) for ws, line in of], LOW_QUANTILE, 5.5),
                    LETTERS_PART * _quantile([sum(map(len, ws)) / len(ws) for ws, _ in of], LOW_QUANTILE, 4.0),
                )
            )

    def hits(self, words: list[str]) -> list[int]:
        """Function words of each language."""
        out = [0] * len(self.languages)
        get = self.of.get
        for w in words:
            for k in get(w, ()):
                out[k] += 1
        return out

    def language(self, hits: list[int]) -> int:
        """The likeliest language by its function words; the first of equal ones."""
        return max(range(len(hits)), key=hits.__getitem__, default=0)

    def relative(self, words: list[str], page: int) -> float:
        """The share of function words, relative to the least that prose of the page's language has, or of another language of which the line has several."""
        n = len(words)
        if not n or not self.languages:
            return 0.0
        hits = self.hits(words)
        best = max((h / t.low for k, (h, t) in enumerate(zip(hits, self.thresholds)) if k == page or h >= OTHER_LANGUAGE), default=0.0)
        return best / n


def _repetition(words: list[str]) -> float:
    """The share of words that repeat an earlier pair of words, or an earlier word, whichever is the less."""
    n = len(words)
    if n < 8:
        return 0.0
    pairs = len(set(zip(words, words[1:])))
    return 1 - max(pairs / (n - 1), len(set(words)) / n)


def _run_end(kept: list[tuple], i: int, kinds: tuple[str, ...]) -> int:
    while i < len(kept) and kept[i][0] in kinds:
        i += 1
    return i


def _weight(line: tuple) -> int:
    """The words that a judged line counts for: its own, three for each link of a line of links."""
    kind, n, _, _, k = line
    return max(n, 3 * k) if kind == "link" else max(n, 1)


def judge(cal: Calibration, text: str) -> dict:
    """Words in lines of keywords, of links and of prose, and the shares that tell."""
    stuffed = prose = linked = chars = url_chars = separators = 0
    lists = 0
    lines = [x for x in text.split("\n") if x.strip()]
    seen: Counter = Counter()
    phrases: Counter = Counter()
    kept = []
    page = cal.language(cal.hits(_WORD.findall(text.lower())))
    own = cal.thresholds[page] if cal.thresholds else Thresholds(0.02, 0.25, 5.5, 2.6)
    for line in lines:
        low = line.lower()
        urls = _URL.findall(low)
        bare = _URL.sub(" ", low) if urls else low
        tags = _TAG.findall(bare)
        words = _WORD.findall(bare)
        chars += len(line)
        n_url = sum(map(len, urls))
        url_chars += n_url
        sep = len(_SEPARATOR.findall(bare))
        separators += sep
        n = len(words)
        kind = ""
        rel = cal.relative(words, page) if n >= 3 else 0.0
        rep = _repetition(words)
        if n_url >= 0.6 * len(line):
            kind = "link"
        elif n >= 8 and sum(map(len, words)) < own.letters * n and not bare.isascii():
            kind = "torn"  # letters that a wrong charset has torn apart tell nothing
        elif n >= 8 and (top := max(Counter(zip(words, words[1:])).values())) >= 3 and top * 2 >= PAIR_SHARE * n:
            kind = "keyword"
        elif len(tags) >= 4 and len(tags) * 2 >= n / 2:
            kind = "tag"
        elif rep >= own.repetition or sep >= 4 and n and rel < 1.0 and n / (sep + 1) <= own.part:
            kind = "keyword"
        elif rel < 0.5 and n >= 8 and not _SENTENCE.search(line):
            kind = "keyword"
        elif rel >= 1.0 and n >= 6 and (_SENTENCE.search(line) or n >= 12):
            kind = "prose"
        elif n <= LIST_WORDS and not _SENTENCE.search(line) and "@" not in line and "©" not in line and (rel < 1.0 or n < 3):
            kind = "item"
        elif n > LIST_WORDS and not _SENTENCE.search(line) and "@" not in line and "©" not in line:
            kind = "phrase"
        seen[low] += 1
        kept.append((kind, n, words, low, max(len(urls), 1)))
        if n >= 4:
            phrases.update(set(zip(words, words[1:])))
    # phrases that come again and again in different lines are keywords even among function words
    often = {p for p, k in phrases.items() if k >= 4 and k >= 0.25 * len(kept)}
    i = done = 0
    while i < len(kept):
        kind, n, words, low, _ = kept[i]
        if i >= done and kind in ("item", "link", "phrase"):
            done = _run_end(kept, i, ("item", "link", "phrase"))
            if done - i >= LIST_LINES and any(x[0] == "phrase" for x in kept[i:done]) and cal.relative([w for x in kept[i:done] for w in x[2]], page) < 1.0:
                stuffed += sum(map(_weight, kept[i:done]))
                lists += done - i
                i = done
                continue
        if kind == "item":
            j = _run_end(kept, i, ("item", "link"))
            listed = j - i >= LIST_LINES
            stuffed += sum(_weight(x) for x in kept[i:j] if listed or x[0] == "link")
            linked += sum(_weight(x) for x in kept[i:j] if not listed and x[0] == "link")
            lists += (j - i) * listed
            i = j
            continue
        if kind in ("link", "tag", "keyword"):
            stuffed += _weight(kept[i])
            linked += _weight(kept[i]) if kind == "link" else 0
        elif kind == "prose":
            keyed = sum(p in often for p in zip(words, words[1:]))
            if keyed >= 0.3 * (n - 1) or seen[low] > 2:
                stuffed += n
            else:
                prose += n
        elif seen[low] > 2:
            stuffed += n
        elif n >= 4 and sum(p in often for p in zip(words, words[1:])) >= 0.3 * (n - 1):
            stuffed += n
        i += 1
    repeated = sum(k - 1 for k in seen.values()) / max(1, len(lines))
    return {"stuffed": stuffed, "prose": prose, "words": sum(x[1] for x in kept), "linked": linked, "listed": lists, "url_share": url_chars / max(1, chars), "chars": chars, "repeated_lines": repeated, "separators": separators}


def fitted(spark: SparkSession, d: str) -> Calibration:
    """Calibrated on all labelled samples."""
    return Calibration(labelled(spark, d, most=None))


_SCHEMA = "page_id long, version_id long, aside int, words int, stuffed int, prose int, listed int, url_share double, chars int, repeated_lines double, separators int"


def repeated_keys(versions: DataFrame, pages: DataFrame) -> DataFrame:
    """(site_id, keys): the keys of the lines that a site repeats, by the counts of problem 6; sites without such lines give no row.

    A page has but so many lines, and each of these is on a good part of a site's pages: a site's list stays short.
    """
    counts = line_keys(versions).select("page_id", "k1").distinct().join(pages.select("page_id", "site_id"), "page_id").groupBy("site_id", "k1").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    per_site = pages.groupBy("site_id").agg(F.count("*").alias("site_pages"))
    return counts.join(per_site, "site_id").where(F.col("n") >= MIN_SHARE * F.col("site_pages")).groupBy("site_id").agg(F.collect_list("k1").alias("keys"))


def own_texts(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, version_id, aside, text) of each page's current text without the lines that its site repeats; a text of nothing else stays whole.

    aside: characters that were set aside.
    The keys go to the pages first, so that each text moves once.
    """
    versions = table(spark, d, "page_versions", "id", "page_id", "text")
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), "site_id", F.col("current_version_id").alias("version_id"))
    current = pages.where("version_id IS NOT NULL").join(repeated_keys(versions, pages), "site_id", "left").select("page_id", "version_id", "keys")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = versions.where("text IS NOT NULL AND trim(text) <> ''").select(F.col("id").alias("version_id"), "text").repartition(parts, "version_id").join(current, "version_id")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("keys", F.xxhash64(letters_of(x)))), "\n")
    own = texts.withColumn("own", F.when(F.col("keys").isNotNull(), kept))
    own = own.select("page_id", "version_id", "text", F.when(F.col("own").rlike(r"\p{L}"), F.col("own")).otherwise(F.col("text")).alias("own"))
    return own.select("page_id", "version_id", (F.length("text") - F.length("own")).alias("aside"), F.col("own").alias("text"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """The shares of every page's current text, calibrated per language; null and blank texts give no row."""
    shared = spark.sparkContext.broadcast(fitted(spark, d))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cal = shared.value
        for batch in batches:
            rows = [(r["words"], r["stuffed"], r["prose"], r["listed"], r["url_share"], r["chars"], r["repeated_lines"], r["separators"]) for t in batch.column(3).to_pylist() for r in (judge(cal, t),)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds))], [c.split()[0] for c in _SCHEMA.split(", ")])

    return own_texts(spark, d).mapInArrow(scan, _SCHEMA)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """One row per page with a current text: its shares, those of its links, and whether it is spam.

    Links are summed per page before they are joined, so that no page's links are gathered. Link names are thought to fill the lines
    set aside first. Where the rest is mostly names and bare links, so many of its words as are names count as stuffed, however
    its lines were judged; repeated rows of links and names that are themselves addresses don't count for that.
    """
    anchor = F.coalesce("anchor_text", F.lit(""))
    named = F.when(F.lower(anchor).rlike(r"^\s*(https?://|www\.|[a-z2-7]{56})"), 0).otherwise(F.length(anchor))
    links = table(spark, d, "links", "src_page_id", "dst_url", "anchor_text").select(F.col("src_page_id").alias("page_id"), F.xxhash64("dst_url", "anchor_text").alias("k"), F.length(anchor).alias("chars"), named.alias("named"))
    links = links.groupBy("page_id", "k").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.max("named").alias("named"))
    anchors = links.groupBy("page_id").agg(F.sum("n").alias("n_links"), F.sum("chars").alias("anchor_chars"), F.sum("named").alias("name_chars"))
    f = features(spark, d).join(anchors, "page_id", "left")
    part = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)) - F.col("aside")) / F.greatest("chars", F.lit(1))
    link_share, name_share = F.least(F.lit(1.0), part("anchor_chars") + F.col("url_share")), F.least(F.lit(1.0), part("name_chars"))
    f = f.withColumn("link_share", link_share).withColumn("names", F.when(name_share + F.col("url_share") >= LINK_SHARE, F.floor(name_share * F.col("words"))).otherwise(0))

    def spam(stuffed, prose, linked) -> tuple[Column, Column]:
        share = stuffed / F.greatest(stuffed + prose, F.lit(1))
        cover = F.greatest(F.lit(COVER_WORDS), COVER_SHARE * (stuffed + prose))
        return share, (stuffed >= LEAST_WORDS) & (prose <= cover) & ((share >= LEAST_SHARE) | linked & (share >= LEAST_SHARE_LINKS))

    much = (F.col("link_share") >= LINK_SHARE) | (F.col("repeated_lines") >= DUPLICATE_SHARE) | (F.col("separators") >= SEPARATOR_DENSITY * F.greatest("words", F.lit(1)))
    _, judged = spam(F.col("stuffed"), F.col("prose"), much)
    stuffed = F.greatest("stuffed", "names").cast("int")
    prose = F.when(F.col("names") > F.col("stuffed"), F.least("prose", F.col("words") - F.col("names"))).otherwise(F.col("prose")).cast("int")
    share, by_names = spam(stuffed, prose, F.lit(False))
    return f.select("page_id", "version_id", stuffed.alias("stuffed"), prose.alias("prose"), "listed", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.round("link_share", 6).alias("link_share"), F.round(share, 6).alias("share"), F.round("repeated_lines", 6).alias("repeated_lines"), "separators", (judged | by_names).alias("spam"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The pages whose current version is spam."""
    return scored(spark, d).where("spam").select("page_id")


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    """The shares of every page with a current text."""
    return scored(spark, d)


QUERIES = {"p5_found": p5_found, "p5_scores": p5_scores}
