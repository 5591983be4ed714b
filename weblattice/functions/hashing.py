"""Content hashes, FNV-1a, SimHash and Hamming distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from weblattice.functions.words import words

_OFFSET, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def md5_pair(address: Column) -> Column:
    """The two forms in which a blocklist may name an address: of the host name, and of the address alone."""
    return F.array(F.md5(F.concat(address, F.lit(".onion"))), F.md5(address))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def url_hash(url: Column) -> Column:
    """The key of a canonical URL: the first 16 bytes of its SHA-256."""
    return F.substring(sha256(url), 1, 16)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex64(x: Column) -> Column:
    """A signed 64-bit number as 16 hexadecimal digits of its two's complement."""
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def fnv1a64_many(items: list[bytes]) -> np.ndarray:
    """FNV-1a hashes (uint64) of many byte strings, one numpy step per byte position."""
    out = np.full(len(items), _OFFSET, np.uint64)
    if not items:
        return out
    length = np.fromiter(map(len, items), np.int64, len(items))
    order = np.argsort(-length, kind="stable")
    start = np.concatenate(([0], np.cumsum(length)[:-1]))[order]
    data = np.frombuffer(b"".join(items), np.uint8).astype(np.uint64)
    h, sorted_length = out[order], length[order]
    for i in range(int(sorted_length[0])):
        n = int(np.searchsorted(-sorted_length, -i, side="left"))  # those longer than i
        h[:n] = (h[:n] ^ data[start[:n] + i]) * _PRIME
    out[order] = h
    return out


def simhash_many(texts: list[str | None], shingle: int = 3) -> list[int | None]:
    """SimHash of each text as a signed 64-bit number: a bit is set where more than half of the shingles' hashes have it.

    Fewer words than a shingle are one shingle; no words give 0; null gives null.
    """
    parts, counts = [], []
    for t in texts:
        w = words(t) if t else []
        s = [" ".join(w)] if 0 < len(w) < shingle else [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)]
        counts.append(len(s))
        parts += [x.encode("utf-8", "surrogatepass") for x in s]
    out: list[int | None] = [None if t is None else 0 for t in texts]
    if not parts:
        return out
    bits = np.unpackbits(fnv1a64_many(parts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    filled = [i for i, c in enumerate(counts) if c]
    starts = np.concatenate(([0], np.cumsum([counts[i] for i in filled])[:-1]))
    ones = np.add.reduceat(bits.astype(np.int32), starts, axis=0)
    set_ = ones * 2 > np.array([counts[i] for i in filled])[:, None]
    packed = np.packbits(set_, axis=1, bitorder="little").view(np.int64).ravel()
    for i, v in zip(filled, packed.tolist()):
        out[i] = v
    return out


@pandas_udf(T.LongType())
def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([v for at in range(0, len(s), 256) for v in simhash_many(s.iloc[at : at + 256].tolist())], dtype="Int64")


@pandas_udf(T.LongType())
def fnv1a64(s: pd.Series) -> pd.Series:
    """FNV-1a 64 of the UTF-8 bytes, as a signed number; null stays null."""
    known = s.dropna()
    h = fnv1a64_many([x.encode("utf-8", "surrogatepass") for x in known]).view(np.int64)
    return pd.Series(h, index=known.index, dtype="Int64").reindex(s.index)
