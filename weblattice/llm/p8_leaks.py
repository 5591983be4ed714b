"""Problem 8: evaluation passages inside documents.

One Aho-Corasick automaton passes once over the words of each text. Its patterns are the items' blocks of BLOCK words, one after the
other: of RUN words in a row some whole block is always a part, as RUN is at least twice BLOCK less one. Where a block is met, the agreement
is followed in both directions; RUN words or more are a leak. So the automaton has about one node for each word of the items,
where all runs of RUN words as patterns would need RUN of them. Offsets are mapped to the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weblattice.llm.words import WORD, plain, words
from weblattice.session import cut
from weblattice.sources.tables import spread, table

RUN = 13
BLOCK = (RUN + 1) // 2
#: Items are broadcast in groups of at most so many characters, one group at a time: an automaton of some 0.2 GB. More items mean more
#: passes over the documents, never a larger broadcast.
GROUP_CHARS = 16_000_000
_built: dict = {}


class Items:
    """The automaton of one group of items. Words are numbers in it; 0 is any word that no item has."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[list[int]] = []
        places: dict[tuple, list[tuple[int, int]]] = {}
        for item, text in dict.fromkeys(items):
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words(text)]
            if len(w) < RUN:
                continue
            for i in range(0, len(w) - BLOCK + 1, BLOCK):
                places.setdefault(tuple(w[i : i + BLOCK]), []).append((len(self.ids), i))
            self.ids.append(item)
            self.words.append(w)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, where in places.items():
            self.machine.add_word(block, tuple(where))
        self.empty = not places
        if not self.empty:
            self.machine.make_automaton()

    def runs(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, first, last): the longest runs of at least RUN words, as indexes of the text's words; an item may have several."""
        if self.empty:
            return
        get = self.number.get
        w = tuple([get(x, 0) for x in words(text)])
        done: dict[tuple[int, int], int] = {}  # the end of the last run on a diagonal: its blocks need not be followed again
        for end, where in self.machine.iter(w):
            start = end - BLOCK + 1
            for k, at in where:
                if done.get((k, start - at), -1) >= end:
                    continue
                own = self.words[k]
                a, i = start, at
                while a and i and w[a - 1] == own[i - 1]:
                    a, i = a - 1, i - 1
                z, j = end + 1, at + BLOCK
                while z < len(w) and j < len(own) and w[z] == own[j]:
                    z, j = z + 1, j + 1
                done[k, start - at] = z - 1
                if z - a >= RUN:
                    yield self.ids[k], a, z - 1

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(item, first, last) in characters of the text; runs of an item that overlap or touch are one span."""
        found: list[list[int]] = []
        for item, a, z in sorted(self.runs(text)):
            if found and found[-1][0] == item and a <= found[-1][2] + 1:
                found[-1][2] = max(found[-1][2], z)
            else:
                found.append([item, a, z])
        if not found:
            return []
        at = [m.span() for m in WORD.finditer(plain(text))]
        return [(item, at[a][0], at[z][1]) for item, a, z in found]


def _automaton(key, items) -> Items:
    if key not in _built:
        _built.clear()
        _built[key] = Items(items)
    return _built[key]


def groups(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of bounded size; items that are null or shorter than RUN words match nothing and are left out."""
    group, size = [], 0
    for r in items.select("item_id", "text").dropna().orderBy("item_id").toLocalIterator():
        if group and size + len(r.text) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append((r.item_id, r.text))
        size += len(r.text)
    if group:
        yield group


_SPANS = "doc_id long, item_id long, start int, stop int, passage string"


def _scanned(docs: DataFrame, shared, spans: bool) -> DataFrame:
    token = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(token, shared.value)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if spans:
                    rows += [(doc, item, a, z, text[a:z]) for item, a, z in found.spans(text)]
                else:
                    rows += [(doc, item) for item in {item for item, _, _ in found.runs(text)}]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())[: 5 if spans else 2]
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in _SPANS.split(", ")][: len(kinds)])

    return spread(docs.where("text IS NOT NULL").select("doc_id", "text")).mapInArrow(scan, _SPANS if spans else "doc_id long, item_id long")


def leaks(docs: DataFrame, items: DataFrame, spans: bool = False) -> DataFrame:
    """(doc_id, item_id), or with spans (doc_id, item_id, start, stop, passage) by characters, for documents that hold RUN or more consecutive words of an item.

    One group of items is one pass. Of more groups each is finished, written to the shared folder and taken off the executors before the next is sent.
    """
    context, out, last = docs.sparkSession.sparkContext, None, None
    for group in groups(items):
        if last is not None:
            part, shared = cut(last[0]), last[1]
            shared.destroy()
            out = part if out is None else out.unionByName(part)
        shared = context.broadcast(group)
        last = _scanned(docs, shared, spans), shared
    if last is None:
        return docs.sparkSession.createDataFrame([], _SPANS if spans else "doc_id long, item_id long")
    return last[0] if out is None else out.unionByName(last[0])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they leak. A document or item without text gives no row."""
    return leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The leaked passages, with offsets in the original text and the passage itself."""
    return leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"), spans=True)


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents that leak it."""
    n = p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, d, "eval_items", "item_id", "suite").join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM d),
eg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM e),
found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))
"""
SQL = {
    "p8_found": _SQL + "SELECT doc_id, item_id FROM found",
    "p8_items": _SQL + "SELECT i.item_id, i.suite, count(f.doc_id) AS n_documents FROM eval_items i LEFT JOIN found f USING (item_id) GROUP BY 1, 2",
}
QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_items": p8_items}
