"""Problem 2: template residue, filler and error pages.

Character n-gram models of filler, of placeholders, of notices, of prose that speaks of any of them and of natural prose are fitted on
seeds from public knowledge. A first fit sorts the texts and lines of the whole corpus; those it finds natural, and the
texts it finds to be notices, are counted, and the models are fitted again with these counts. HTTP statuses correct the first fit: an
n-gram whose rows answer with errors no more often than other rows do is no notice's. The log-likelihood ratio to natural prose
is summed over windows: filler is residue wherever a window of it stands and its sentence doesn't speak of it; a
notice excludes a text that it covers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weblattice.llm.residue_seeds import CONTENT, FILLER, MENTION, NOTICE, placeholders
from weblattice.llm.sampling import labelled
from weblattice.sources.tables import spread, table

#: What the counts of the whole corpus weigh in the models, in n-grams: natural prose, and what was found of notices and of filler in shares of the seeds'.
NATURAL_WEIGHT, FOUND_WEIGHT = 1.5e6, 1.0
N, BUCKETS, SMOOTH, CLIP = 5, 1 << 18, 300.0, 5.0
#: Window length in characters, and the mean log-likelihood ratio from which it is filler.
WINDOW, FILLER_RATIO = 24, 2.0
#: Share of a text that notices must cover, by windows of at least this ratio.
COVERAGE, NOTICE_RATIO = 0.6, 0.6
#: Windows below this ratio are natural prose; a notice must cover at least this share of the text in any case.
PROSE_RATIO, LEAST_NOTICE = -0.3, 0.2
#: A text of fewer letters is no notice.
LEAST_LETTERS = 6
#: Mean ratio of a sentence without its residue from which it speaks of residue.
MENTION_RATIO = 0.0
#: Mean ratio of a candidate from which it is a placeholder; characters before and after a value that are seen with it.
PLACE_RATIO, PLACE_AROUND = 0.5, 12
#: Share of a text that notices must cover, and of a line that filler must cover, for their n-grams to be counted as such; from the lesser
#: share on a text may be a notice, and its statuses tell.
LEARN_COVERAGE, DOUBT_COVERAGE = 0.9, 0.5
#: From this status on a row is an error; log odds that a text is a notice which the first fit is sure of, as far as statuses don't tell;
#: how much less a row tells than if all were independent.
ERROR_STATUS, SURE_ODDS, STATUS_PART = 400, 3.0, 0.5
#: Mean ratios of a line, and of a window of it, from which it is not counted as natural prose.
NATURAL_MENTION, NATURAL_FILLER = 0.3, 1.0

#: What may be a placeholder by the syntax of common template languages; what it names doesn't matter, nor how long it is: a body ends
#: with its closing mark. No body holds its opening mark again, so that a text is read once however many are never closed.
_NAME = r"[A-Za-z_0-9][\w.-]*(?:\(['\"\w., ]*\))?"
CANDIDATE = re.compile(
    r"\{\{(?:[^{}]|\{(?!\{)|\}(?!\}))*\}\}|\{%(?:[^{%]|\{(?!%)|%(?!\}))*%\}|<%(?:[^<%]|<(?!%)|%(?!>))*%>|<!--\s*#(?:[^<-]|<(?!!--)|-(?!->))*-->|<\?(?:php|=)(?:[^<?]|<(?!\?)|\?(?!>))*\?>|[$#]\{[^{}]+\}"
    rf"|(?<![\w{{]){{{_NAME}}}(?![\w}}])|%%{_NAME}%%|(?<![\w%])%(?=[A-Za-z_]{{3}}){_NAME}%(?![\w%])|\[\[{_NAME}\]\]|(?<!\w)__(?=[A-Za-z]){_NAME}?__(?!\w)|(?<!\w)__[A-Za-z]\w*\(['\"\w., ]*\)__|@@{_NAME}@@"
    r"|(?<![\w%])%[sd](?!\w)|\[\s*(?i:insert|your|enter|add|hier|votre|su|inserte)\s[^\[\]\n]+\]|\[(?:First|Last|Full|Company|Your|User|Site|Customer)\s?[A-Z]?[a-z]*\]|\[object [A-Z]\w*\]|\b(?:NaN|undefined|null)\b"
)


def skeleton(text: str) -> str:
    """The text in lower case with digits as 0; its length stays."""
    low = text.lower()
    return re.sub(r"\d", "0", low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text))


def buckets(text: str) -> np.ndarray:
    """Bucket of the n-gram that ends at each character; the text is seen with blanks before it."""
    codes = np.frombuffer((" " * (N - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(text), np.uint32)
    for i in range(N):
        h = (h ^ codes[i : i + len(text)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(13)
    return h & np.uint32(BUCKETS - 1)


def _counts(texts) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for t in texts:
        out += np.bincount(buckets(skeleton(t)), minlength=BUCKETS)
    return out


def _ratio(of: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each n-gram, both models smoothed towards what they have together; 0 where neither has it."""
    both = (of + against) / (of.sum() + against.sum())
    p = (of + SMOOTH * both) / (of.sum() + SMOOTH)
    q = (against + SMOOTH * both) / (against.sum() + SMOOTH)
    out = np.zeros(BUCKETS, np.float32)
    seen = both > 0
    out[seen] = np.clip(np.log(p[seen] / q[seen]), -CLIP, CLIP)
    return out


def _window_means(lr: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Mean of the window that begins at each place; a text shorter than a window is one window, filled up with nought."""
    c = np.concatenate(([0.0], np.cumsum(lr, dtype=np.float64)))
    if len(lr) <= size:
        return np.array([c[-1] / max(12, len(lr))])
    return (c[size:] - c[:-size]) / size


_INNER = re.compile(r"[A-Za-z0-9_].*[A-Za-z0-9_)]|[A-Za-z0-9_]", re.DOTALL)
_FIELD = re.compile(r"\[\s*(insert|your|enter|add|hier|votre|su|inserte)\s.*?(\shere)?\s*\]", re.IGNORECASE | re.DOTALL)
_VALUE = re.compile(r"\[object [A-Z]\w*\]|NaN|undefined|null")
_WHOLE = re.compile(r"\[(?:First|Last|Full|Company|Your|User|Site|Customer)\s?[A-Z]?[a-z]*\]|%[sd]")


def masked(placeholder: str) -> str:
    """A candidate whose name is x, as names tell nothing; values and fields of letters stay."""
    if _VALUE.fullmatch(placeholder) or _WHOLE.fullmatch(placeholder):
        return placeholder
    if m := _FIELD.fullmatch(placeholder):
        return f"[{m[1]} x{m[2] or ''}]"
    return _INNER.sub("x", placeholder, count=1)


def _masked_counts(texts) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for t in texts:
        out += np.bincount(buckets(skeleton(CANDIDATE.sub(lambda m: masked(m.group()), t))), minlength=BUCKETS)
    return out


def _covered(size: int, over: np.ndarray) -> np.ndarray:
    """Which of so many characters are in a window that is over; there is a window for each place where one fits."""
    before = np.zeros(len(over) + 1, np.int32)
    np.cumsum(over, out=before[1:])
    upto = np.concatenate((before[1:], np.full(size - len(over), before[-1])))
    return upto > np.concatenate((np.zeros(WINDOW - 1, np.int32), before[:-1]))


class Residue:
    """The fitted ratios."""

    def __init__(self, filler: np.ndarray, notice: np.ndarray, mention: np.ndarray, place: np.ndarray):
        self.filler, self.notice, self.mention, self.place = filler, notice, mention, place

    def speaks(self, text: str, start: int, stop: int) -> bool:
        """Whether the sentence around text[start:stop] speaks of what stands there.

        Without what stands there the sentence must be likelier as such prose than as other.
        """
        a = max(text.rfind("\n", 0, start), *(text.rfind(e, 0, start) + 1 for e in (". ", "! ", "? "))) + 1
        b = min([i for i in (text.find("\n", stop), *(text.find(e, stop) for e in (". ", "! ", "? "))) if i >= 0], default=len(text))
        around = skeleton(text[a:start] + " " + text[stop:b])
        return len(around) >= 30 and float(self.mention[buckets(around)].mean()) > MENTION_RATIO

    def is_placeholder(self, text: str, start: int, stop: int) -> bool:
        """Whether a candidate is likelier as a placeholder where one is filled in than as a part of prose."""
        inside = masked(text[start:stop])
        value = _VALUE.fullmatch(inside)  # these are words of prose as well: what stands around them counts
        before, after = (text[max(0, start - PLACE_AROUND) : start], text[stop : stop + PLACE_AROUND]) if value else ("", (text[stop : stop + 1] or " "))
        ratio = self.place[buckets(skeleton(before + inside + after))[len(before) : len(before) + len(inside) + (N - 1 if value else 1)]]
        # what follows must not be a sign that it is a part of something else, such as a path
        return float(ratio.mean()) > PLACE_RATIO and (bool(value) or not re.match(r"[\w/\\]", after) or ratio[-1] > -PLACE_RATIO)

    def filler_spans(self, text: str, b: np.ndarray) -> list[tuple[int, int]]:
        """Where filler and placeholders stand that their sentence doesn't speak of; b are the text's buckets."""
        spans = [m.span() for m in CANDIDATE.finditer(text) if self.is_placeholder(text, *m.span())] if _HINT.search(text) else []
        m = _window_means(self.filler[b])
        if m.max() > FILLER_RATIO:
            over = np.flatnonzero(m > FILLER_RATIO)
            for part in np.split(over, np.flatnonzero(np.diff(over) > WINDOW) + 1):
                spans.append((int(part[0]), min(len(text), int(part[-1]) + WINDOW)))
        return [s for s in spans if not self.speaks(text, *s)]

    def covered(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which characters are in windows of a notice, and which in windows of natural prose only; the latter aren't looked for where there are none of the former."""
        m = _window_means(self.notice[b])
        if len(b) <= WINDOW:
            return np.full(len(b), m[0] > NOTICE_RATIO), np.full(len(b), m[0] < PROSE_RATIO)
        over = m > NOTICE_RATIO
        if not over.any():  # as in most texts: then what is prose doesn't matter
            return (np.zeros(len(b), bool),) * 2
        notice = _covered(len(b), over)
        return notice, _covered(len(b), m < PROSE_RATIO) & ~notice

    def notice_shares(self, text: str, b: np.ndarray) -> tuple[float, float, tuple]:
        """(share of the text in notices, in natural prose, the characters of either); nothing for a text of too few letters."""
        if next(islice(filter(str.isalpha, text), LEAST_LETTERS - 1, None), None) is None:
            return 0.0, 0.0, ()
        of = self.covered(b)
        return float(of[0].mean()), float(of[1].mean()), of

    @staticmethod
    def covers(notice: float, prose: float, coverage: float = COVERAGE) -> bool:
        """Whether notices cover a text, what stands in neither kind of window left aside."""
        return notice >= LEAST_NOTICE and notice >= coverage * (notice + prose)

    def is_notice(self, text: str, b: np.ndarray) -> bool:
        return self.covers(*self.notice_shares(text, b)[:2])

    def residue(self, title: str | None, text: str | None) -> str:
        """"filler", "notice" or ""."""
        if title and self.filler_spans(title, buckets(skeleton(title))):
            return "filler"
        if not text:
            return ""
        b = buckets(skeleton(text))
        return "filler" if self.filler_spans(text, b) else "notice" if self.is_notice(text, b) else ""

    def sorted_buckets(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of the lines that are natural, of the text if it is a notice, of the text if it may be one, of the lines that are filler)."""
        b = buckets(skeleton(text))
        none = b[:0]
        if not len(b):
            return none, none, none, none
        notice, prose, of = self.notice_shares(text, b)
        if self.covers(notice, prose, DOUBT_COVERAGE):
            return (none, b, none, none) if self.covers(notice, prose, LEARN_COVERAGE) else (none, none, b, none)
        size = np.fromiter(map(len, text.split("\n")), np.int64) + 1
        size[-1] -= 1
        if not size[-1]:
            size = size[:-1]
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        speaks = np.add.reduceat(self.mention[b], starts) / size
        natural = speaks <= NATURAL_MENTION
        if of and of[0].any():
            notice, prose = (np.add.reduceat(x.astype(np.int32), starts) / size for x in of)
            natural &= ~((notice >= LEAST_NOTICE) & (notice >= 0.5 * (notice + prose)))
        filler = none
        m = _window_means(self.filler[b])
        if m.max() > NATURAL_FILLER:
            where = lambda least: np.full(len(b), m[0] > least) if len(b) <= WINDOW else _covered(len(b), m > least)
            sure = np.add.reduceat(where(FILLER_RATIO).astype(np.int32), starts) >= LEARN_COVERAGE * size
            filler = b[np.repeat(sure & (speaks <= NATURAL_MENTION), size)]
            natural &= ~np.logical_or.reduceat(where(NATURAL_FILLER), starts)
        if _HINT.search(text):
            for found in CANDIDATE.finditer(text):
                first, last = np.searchsorted(starts, (found.start(), found.end() - 1), side="right") - 1
                natural[first : last + 1] = False
        return b[np.repeat(natural, size)], none, none, filler


_HINT = re.compile(r"[{}<%\[]|__|@@|NaN|null|undefined")


def fit(samples: list[str], natural: np.ndarray | None = None, notices: np.ndarray | None = None, fillers: np.ndarray | None = None, denied: np.ndarray | None = None) -> Residue:
    """From the seeds and the labelled clean samples, and from the n-grams of the corpus that a first fit found to be natural, notices or filler.

    denied: n-grams of texts that were taken for notices, which their statuses deny; as they are few they count in full.
    """
    filler, notice, mention = _counts(FILLER), _counts(NOTICE), _counts(MENTION)
    content = _counts(CONTENT) * 4 + _counts(samples)
    part = 1.0
    if natural is not None and natural.any():
        content, part = content + natural * min(1.0, NATURAL_WEIGHT / natural.sum()), 0.5
    if denied is not None and denied.any():
        content = content + denied * min(1.0, NATURAL_WEIGHT / denied.sum())
    if notices is not None and notices.any():
        notice = notice + notices * min(1.0, FOUND_WEIGHT * notice.sum() / notices.sum())
    if fillers is not None and fillers.any():
        filler = filler + fillers * min(1.0, FOUND_WEIGHT * filler.sum() / fillers.sum())
    place = _ratio(_masked_counts(placeholders()), content + _masked_counts(CONTENT + MENTION) * 4)
    return Residue(_ratio(filler, content + notice + mention), _ratio(notice, content + filler + mention * part), _ratio(mention, content), place)


def by_status(natural: np.ndarray, notice: np.ndarray, doubt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of notices, n-grams of texts that statuses deny to be notices), from (2, BUCKETS) counts in rows without and with an error.

    Notices answer with errors more often than other rows do, though mostly they don't. How often either does is taken from the texts that
    the first fit is sure of. Rows tell by their log-likelihood ratio whether an n-gram is a notice's: for texts in doubt those that may be
    notices, for the others all rows, as a few odd texts make no notice of what is natural in many. Where there are few rows the first fit's
    word counts, and texts in doubt count for neither.
    """
    rate = lambda c: (c[1].sum() + 1) / (c.sum() + 20)
    often, seldom = rate(notice), rate(natural)

    def told(rows: np.ndarray, odds: float) -> np.ndarray:
        ratio = STATUS_PART * (rows[1] * np.log(often / seldom) + rows[0] * np.log((1 - often) / (1 - seldom))) if often > seldom else 0.0
        return 1 / (1 + np.exp(-np.clip(ratio + odds, -30, 30)))

    sure, unsure = told(natural + notice + doubt, SURE_ODDS), 2 * told(notice + doubt, 0.0) - 1
    of, may = notice.sum(0), doubt.sum(0)
    return of * sure + may * np.maximum(0.0, unsure), may * np.maximum(0.0, -unsure)


_CLASSES = ("natural", "notice", "doubt", "filler")


def corpus_counts(rows: DataFrame, first: Residue) -> DataFrame:
    """(bucket, failed, natural, notice, doubt, filler): n-grams of all natural lines, all notices, all that may be one and all filler lines in rows (text, failed); two rows per bucket at most."""
    shared = rows.sparkSession.sparkContext.broadcast(first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(_CLASSES), BUCKETS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sorted_ = [(bool(failed), shared.value.sorted_buckets(t)) for t, failed in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t]
                for failed in (False, True):
                    for k in range(len(_CLASSES)):
                        of = [p[k] for f, p in sorted_ if f == failed and len(p[k])]
                        if of:
                            total[int(failed), k] += np.bincount(np.concatenate(of), minlength=BUCKETS)
        for failed in (False, True):
            used = np.flatnonzero(total[int(failed)].any(0))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), failed)), *(pa.array(c[used]) for c in total[int(failed)])], ["bucket", "failed", *_CLASSES])

    each = spread(rows).mapInArrow(count, "bucket int, failed boolean, " + ", ".join(f"{c} long" for c in _CLASSES))
    return each.groupBy("bucket", "failed").agg(*[F.sum(c).alias(c) for c in _CLASSES])


def fitted(spark: SparkSession, d: str) -> Residue:
    samples = [text for _, text in labelled(spark, d)]
    first = fit(samples)
    rows = table(spark, d, "page_versions", "text", "http_status").where("text IS NOT NULL")
    got = corpus_counts(rows.select("text", F.coalesce(F.col("http_status") >= ERROR_STATUS, F.lit(False)).alias("failed")), first).toPandas()
    counts = np.zeros((len(_CLASSES), 2, BUCKETS))
    for k, c in enumerate(_CLASSES):
        counts[k][got["failed"].astype(int), got["bucket"]] = got[c]
    natural, notice, doubt, filler = counts
    notices, denied = by_status(natural, notice, doubt)
    return fit(samples, natural.sum(0), notices, filler.sum(0), denied)


def classified(spark: SparkSession, d: str) -> DataFrame:
    """(version_id, kind) of every version: filler, notice or content. Null and empty fields hold nothing."""
    shared = spark.sparkContext.broadcast(fitted(spark, d))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            kinds = [r.residue(title, text) or "content" for title, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], ["version_id", "kind"])

    return spread(table(spark, d, "page_versions", "id", "title", "text")).mapInArrow(scan, "version_id long, kind string")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The versions with residue or without content."""
    return classified(spark, d).where("kind <> 'content'").select("version_id")


def p2_content(spark: SparkSession, d: str) -> DataFrame:
    """The versions that are left, by id."""
    return classified(spark, d).where("kind = 'content'").select("version_id")


QUERIES = {"p2_found": p2_found, "p2_content": p2_content}
