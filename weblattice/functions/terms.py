"""The content filter: terms are looked for in folded text. It fails closed."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf


def fold(text: str) -> str:
    """Compatibility forms folded, marks dropped, lower case, anything but letters and decimal digits one blank."""
    out = []
    for c in unicodedata.normalize("NFKD", text):
        kind = unicodedata.category(c)
        if kind[0] == "L" or kind == "Nd":
            out.append(c.lower())
        elif kind != "Mn":
            out.append(" ")
    return " ".join("".join(out).split())


class Terms:
    """Phrases of whole words, and ``~`` terms that are looked for within words and across them."""

    def __init__(self, lines: Iterable[str]):
        wanted = [s for line in lines if (s := line.strip()) and not s.startswith("#")]
        self.phrases = [f" {t} " for s in wanted if not s.startswith("~") and (t := fold(s))]
        self.parts = [t for s in wanted if s.startswith("~") and (t := fold(s[1:]).replace(" ", ""))]
        if not len(self):
            raise ValueError("no filter terms: refusing to run without a content filter")

    @classmethod
    def load(cls, path: str) -> Terms:
        with open(path, encoding="utf-8") as f:
            return cls(f)

    def __len__(self) -> int:
        return len(self.phrases) + len(self.parts)

    def match(self, *texts: str | None) -> bool:
        for t in texts:
            if not t:
                continue
            folded = fold(t)
            squashed = folded.replace(" ", "")
            if any(p in folded or p in squashed for p in self.parts) or any(p in f" {folded} " for p in self.phrases):
                return True
        return False


def matches(spark: SparkSession, terms: Terms, *texts: Column) -> Column:
    """Whether any of the texts holds a term. The terms, a list kept by hand, are broadcast."""
    shared = spark.sparkContext.broadcast(terms)

    @pandas_udf(T.BooleanType())
    def hit(joined: pd.Series) -> pd.Series:
        t = shared.value
        return joined.map(lambda xs: t.match(*xs) if xs is not None else False)

    return hit(F.array(*texts))


@pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else fold(t))
