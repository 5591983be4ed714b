"""Seed lists, blocklists and files of filter terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblattice.functions.onion import extract_addresses
from weblattice.functions.terms import Terms

#: A remote blocklist of fewer hashes is taken for a broken one.
LEAST_HASHES = 1000


class BrokenList(ValueError):
    """A list too short to be whole."""


def seed_list(spark: SparkSession, path: str) -> DataFrame:
    """(address), distinct: the valid addresses in files of any form, read line by line."""
    lines = spark.read.text(path)
    return lines.select(F.explode(extract_addresses("value")).alias("address")).distinct()


def block_hashes(lines: DataFrame) -> DataFrame:
    """(md5), distinct, of lines (value); whatever is no hash is left out."""
    return lines.select(F.lower(F.trim("value")).alias("md5")).where(F.col("md5").rlike("^[0-9a-f]{32}$")).distinct()


def blocklist(spark: SparkSession, path: str, least: int = LEAST_HASHES) -> DataFrame:
    """The hashes of a file of lines; one with too few is refused."""
    found = block_hashes(spark.read.text(path))
    n = found.count()
    if n < least:
        raise BrokenList(f"{n} hashes, at least {least} are needed")
    return found


def gate(stored: DataFrame, source: str, least: int = LEAST_HASHES) -> int:
    """The number of a source's hashes on the stored blocklist (md5, source); nothing may be crawled before there are enough."""
    n = stored.where(F.col("source") == source).count()
    if n < least:
        raise BrokenList(f"{n} hashes of {source}, at least {least} are needed before a crawl")
    return n


def filter_terms(path: str) -> Terms:
    """The content filter's terms; a missing or empty file is an error."""
    return Terms.load(path)
