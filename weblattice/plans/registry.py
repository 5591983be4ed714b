"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weblattice.plans import explore, explore_queries, relational
from weblattice.plans.crawl import Crawl
from weblattice.streaming import queries as streaming

_MODULES = (explore_queries, relational, streaming)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes per hour of the last seven days, with the latency percentiles of the hours that have them."""
    c = Crawl(spark, folder)
    return explore.outcomes_7d(c).join(explore.latency_3d(c), "t", "left").orderBy("t")


def queries() -> dict:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}
