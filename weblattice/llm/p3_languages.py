"""Problem 3: missing and wrong language labels, and texts in several languages.

Error-correcting output codes: every language has a codeword of BITS bits; one regularised least-squares classifier per
bit, on hashed character n-grams of single words, predicts it; the codeword with the least weighted
logistic loss over all bits is the language, and the share of its likelihood the confidence. As the classifiers are
linear in the words, a word is scored once and a line is a sum over its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weblattice.llm.sampling import TRAIN_ROWS, labelled
from weblattice.llm.words import WORD
from weblattice.sources.tables import spread, table

BITS, BUCKETS, NGRAMS, RIDGE = 15, 1 << 14, (1, 2, 3, 4), 0.02
#: A line counts as running text from so many words that are no names, or so many if it ends as a sentence does.
RUNNING_WORDS, SENTENCE_WORDS = 6, 4
#: Below this confidence a line is ambiguous and decides nothing.
SURE = 0.995

#: Names and codes of languages by ISO 639-1 code.
NAMES = {
    "en": "eng english englisch anglais inglés inglese", "de": "deu ger german deutsch allemand alemán", "fr": "fra fre french français francais französisch",
    "es": "spa spanish español espanol castellano castilian", "pt": "por portuguese português portugues", "it": "ita italian italiano",
    "nl": "nld dut dutch nederlands flemish", "ru": "rus russian русский russkij", "uk": "ukr ukrainian українська", "pl": "pol polish polski",
    "ca": "cat catalan català", "da": "dan danish dansk", "sv": "swe swedish svenska", "no": "nor norwegian norsk nb nob nn nno", "fi": "fin finnish suomi",
    "la": "lat latin latina", "af": "afr afrikaans", "gl": "glg galician galego", "ro": "ron rum romanian română", "cs": "ces cze czech čeština",
    "be": "bel belarusian", "bg": "bul bulgarian български", "el": "ell gre greek", "tr": "tur turkish türkçe", "ar": "ara arabic", "zh": "zho chi chinese", "ja": "jpn japanese", "ko": "kor korean",
}
#: Labels that name no language.
NO_LABEL = frozenset(("", "und", "unknown", "xx", "none", "null", "n/a", "zxx", "mul"))
_CODES = {name: code for code, names in NAMES.items() for name in (code, *names.split())}


def normal_label(label: str | None) -> str | None:
    """The ISO 639-1 code that a label means; None where it is missing; an unknown label stays as it is, in lower case."""
    if label is None or (s := label.strip().lower()) in NO_LABEL:
        return None
    s = re.split(r"[-_ (,;.]", s)[0]
    return _CODES.get(s, s)


def codewords(classes: int, bits: int = BITS) -> np.ndarray:
    """Codewords of +-1, far from one another: the best of many random codes whose columns all part the classes."""
    rng, best, far = np.random.default_rng(15), None, -1
    for _ in range(400):
        code = rng.choice([-1, 1], size=(classes, bits))
        if classes > 1 and (np.abs(code.sum(0)) == classes).any():
            continue
        d = (code[:, None, :] != code[None, :, :]).sum(2) + np.eye(classes, dtype=int) * bits
        if d.min() > far:
            best, far = code, d.min()
    return np.ones((classes, bits), int) if best is None else best  # fewer than two classes


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, index of its word), over words with a boundary on either side."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), length)
    ends = np.repeat(np.cumsum(length), length)
    at = np.arange(len(codes))
    buckets, owners = [], []
    for n in NGRAMS:
        h = np.full(max(0, len(codes) - n + 1), n, np.uint32)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inside = at[: len(h)] + n <= ends[: len(h)]
        buckets.append((h[inside] & np.uint32(BUCKETS - 1)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


class Classifier:
    """Fitted code; score() of lines is a sum over remembered words."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, scale: np.ndarray):
        self.languages, self.code, self.weights, self.scale = languages, code, weights.astype(np.float32), scale
        self._forget()

    def _forget(self):
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, BITS + 1), np.float32)

    def __getstate__(self):
        return self.languages, self.code, self.weights, self.scale

    def __setstate__(self, state):
        self.__init__(*state)

    def numbers(self, words: list[str]) -> list[int]:
        """Row of each word; unseen ones are scored first, all at once."""
        index = self.index
        new = list({w for w in words if w not in index})
        if new:
            if len(index) + len(new) > 300_000:
                self._forget()
                index = self.index
                new = list(set(words))
            b, owner = ngram_buckets(new)
            sums = np.zeros((len(new), BITS + 1), np.float32)
            for k in range(BITS):
                sums[:, k] = np.bincount(owner, self.weights[b, k], len(new))
            sums[:, BITS] = np.bincount(owner, minlength=len(new))
            at = len(index)
            while at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at : at + len(new)] = sums
            index.update(zip(new, range(at, at + len(new))))
        return [index[w] for w in words]

    def lines(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, confidence) of each line, a non-empty list of lower-case words."""
        flat = self.numbers([w for line in lines for w in line])
        starts = np.concatenate(([0], np.cumsum([len(x) for x in lines])[:-1]))
        sums = np.add.reduceat(self.rows[flat], starts, axis=0)
        return self.decode(sums[:, :BITS] / np.maximum(sums[:, BITS:], 1.0), sums[:, BITS])

    def decode(self, margins: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss-weighted decoding: bits that separate better on the samples weigh more, longer lines give surer results."""
        z = margins * self.scale * np.minimum(1.0, np.sqrt(size / 60.0))[:, None]
        loss = np.stack([np.logaddexp(0.0, -z * self.code[k]).sum(1) for k in range(len(self.languages))], axis=1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def _pieces(text: str) -> list[list[str]]:
    """A sample as a whole and in sentences, as lists of words."""
    parts = [text, *re.split(r"(?<=[.!?…])\s+|\n", text)]
    return [w for p in parts if len(w := WORD.findall(p.lower())) >= 3]


def fit(samples: list[tuple[str, str]]) -> Classifier:
    """samples: (language, text). Languages are those that occur."""
    languages = sorted({lang for lang, text in samples if _pieces(text)})
    if not languages:  # nothing to tell apart: no line has a language
        return Classifier([], np.ones((0, BITS), int), np.zeros((BUCKETS, BITS)), np.ones(BITS))
    code = codewords(len(languages))
    rows = [(languages.index(lang), w) for lang, text in samples for w in _pieces(text)]
    y = code[[k for k, _ in rows]].astype(np.float64)
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (_, w) in enumerate(rows):
        b, _ = ngram_buckets(w)
        x[i] = np.bincount(b, minlength=BUCKETS) / len(b)
    norm = 1 / np.sqrt((x * x).mean(0) + 1e-6)  # rare n-grams tell as much as frequent ones
    x *= norm.astype(np.float32)
    gram = (x @ x.T).astype(np.float64)
    gram /= (unit := np.trace(gram) / len(rows))
    alpha = np.linalg.solve(gram + RIDGE * np.eye(len(rows)), y)
    weights = (x.T @ alpha.astype(np.float32)) * norm[:, None].astype(np.float32) / unit
    # leave-one-out margins of the ridge solution weigh the bits
    left_out = y - alpha / np.diag(np.linalg.inv(gram + RIDGE * np.eye(len(rows))))[:, None]
    right = (left_out * y).mean(0) / np.maximum(left_out.std(0), 1e-3)
    return Classifier(languages, code, weights, 4.0 * right / right.mean())


_ADDRESS = re.compile(r"\S*(?:@|://|\.onion)\S*|\b(?=\w*\d)(?=\w*[A-Za-z])\w{10,}\b")
_SENTENCE_END = re.compile(r"[.!?…][\"”»“)\]’']*\s*(?:\([^)]*\)[.!]?)?\s*$")


#: A short quotation; what it holds may be foreign.
_QUOTED = re.compile(r"[“„«\"‘][^“”„«»\"]{1,60}[”“»\"’]")


def running_words(line: str) -> list[str] | None:
    """The lower-case words of a line of running text; None for addresses, headings, signatures and names."""
    if len(line) < 15:
        return None
    if "@" in line or "://" in line or ".onion" in line:
        line = _ADDRESS.sub(" ", line)
    found = [w for w in WORD.findall(_QUOTED.sub(" ", line)) if not w[0].isdigit()]
    if len(found) < SENTENCE_WORDS:
        return None
    plain = sum(w[0].islower() for w in found)
    if plain <= 2:
        caps = sum(w.isupper() for w in found)
        plain = caps if caps >= 0.6 * len(found) else plain
    else:
        plain += 1
    if plain >= RUNNING_WORDS or plain >= SENTENCE_WORDS and _SENTENCE_END.search(line):
        return [w.lower() for w in found]
    return None


def segments(classifier: Classifier, text: str) -> list[tuple[int, int, str, float]]:
    """(first line, last line, language, confidence) of each stretch of lines in one language; lines count from 1.

    Lines that are no running text, or ambiguous, belong to the stretch around them.
    """
    return _segments(classifier, [text])[0][0]


def _segments(classifier: Classifier, texts: list[str]) -> list[tuple[list, list]]:
    """(stretches, ambiguous lines) of each text; an ambiguous line is (line, line, likeliest language, confidence)."""
    lines, where = [], []
    for k, t in enumerate(texts):
        for i, line in enumerate(t.split("\n"), 1):
            if w := running_words(line):
                lines.append(w)
                where.append((k, i))
    out: list[list] = [[] for _ in texts]
    unsure: list[list] = [[] for _ in texts]
    if not lines or not classifier.languages:
        return list(zip(out, unsure))
    best, sure = classifier.lines(lines)
    for (k, i), b, p, w in zip(where, best.tolist(), sure.tolist(), lines):
        if p < SURE:
            unsure[k].append((i, i, classifier.languages[b], p))
            continue
        lang, of = classifier.languages[b], out[k]
        if of and of[-1][2] == lang:
            a, _, _, q, n = of[-1]
            of[-1] = (a, i, lang, (q * n + p * len(w)) / (n + len(w)), n + len(w))
        else:
            of.append((i, i, lang, p, len(w)))
    return [([x[:4] for x in of], odd) for of, odd in zip(out, unsure)]


def fitted(spark: SparkSession, d: str) -> Classifier:
    """Fitted on at most TRAIN_ROWS samples, which make some 3 TRAIN_ROWS pieces: 0.2 GB of n-gram shares, a square matrix of 0.1 GB."""
    return fit(labelled(spark, d, TRAIN_ROWS))


def _scan(spark: SparkSession, d: str, schema: str, make) -> DataFrame:
    """make(label, stretches, ambiguous lines) gives the rows of a document without its id."""
    shared = spark.sparkContext.broadcast(fitted(spark, d))
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        for batch in batches:
            ids, labels, texts = (batch.column(i) for i in range(3))
            for at in range(0, len(ids), 256):
                found = _segments(classifier, [t or "" for t in texts.slice(at, 256).to_pylist()])
                rows = [(i, *row) for i, label, s in zip(ids.slice(at, 256).to_pylist(), labels.slice(at, 256).to_pylist(), found) for row in make(label, *s)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spread(table(spark, d, "documents", "doc_id", "lang", "text")).mapInArrow(scan, schema)


def _found(label, stretches, _unsure):
    langs = {s[2] for s in stretches}
    return [(x,) for x in sorted(langs)] if len(langs) > 1 or normal_label(label) not in langs else []


def _segment_rows(_label, stretches, unsure):
    return [(*x, False) for x in stretches] + [(*x, True) for x in unsure]


def _document_rows(label, stretches, unsure):
    if not stretches:
        return [(None, None, normal_label(label), False, len(unsure))]
    size: dict[str, float] = {}
    for a, b, lang, p in stretches:
        size[lang] = size.get(lang, 0.0) + (b - a + 1) * p
    best = max(sorted(size), key=size.get)
    return [(best, size[best] / sum(b - a + 1 for a, b, _, _ in stretches), normal_label(label), len(size) > 1, len(unsure))]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The languages of each document whose label is missing or wrong, or which is in several languages.

    A null or empty text, and one without running text, gives no row.
    """
    return _scan(spark, d, "doc_id long, lang string", _found)


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each stretch of lines in one language, with a confidence, and each line whose nearest codeword is not clear, flagged as ambiguous."""
    return _scan(spark, d, "doc_id long, first_line int, last_line int, lang string, confidence double, ambiguous boolean", _segment_rows)


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its main language (null without running text), its confidence, what its label means and how many lines are ambiguous."""
    return _scan(spark, d, "doc_id long, lang string, confidence double, label string, mixed boolean, ambiguous_lines int", _document_rows)


QUERIES = {"p3_found": p3_found, "p3_segments": p3_segments, "p3_documents": p3_documents}
