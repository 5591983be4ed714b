"""Streams run to their end over the log, beside the batch results that they must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblattice.functions.fetching import ALIVE
from weblattice.plans.crawl import Crawl
from weblattice.session import cut, ensure_checkpoint_dir
from weblattice.streaming import streams


def _run(spark: SparkSession, d: str, make, mode: str) -> DataFrame:
    """The rows that a stream over the folder's log gives when it has read all; written to the shared folder, read back as a table.

    The log is read in one batch here: nothing is late, whatever its order and however many pieces a site's rows come in.
    """
    base = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    c = Crawl(spark, d)
    # received_at orders the stream; a file source needs a folder
    c.log.write.parquet(f"{base}/in")
    log = streams.log_stream(spark, f"{base}/in", c.log.schema, files_per_batch=1_000_000)
    out = f"{base}/out"

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    streams.run(make(log), f"{base}/state", each=each, mode=mode)
    return cut(spark.read.option("recursiveFileLookup", "true").parquet(out))


def fetch_rate(spark: SparkSession, d: str) -> DataFrame:
    r = _run(spark, d, streams.fetch_rate, "update")
    return r.groupBy(F.col("t").cast("timestamp_ntz").alias("t"), "outcome").agg(F.max("n").alias("n"))


def activity(spark: SparkSession, d: str) -> DataFrame:
    r = _run(spark, d, streams.activity, "update")
    return r.groupBy(F.col("t").cast("timestamp_ntz").alias("t")).agg(*[F.max(x).alias(x) for x in ("fetches", "ok", "alive")])


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Log rows per site after exact repetitions are left out."""
    key = ["ts", "site_id", "url_hash", "outcome", "latency_ms", "proxy"]
    return _run(spark, d, lambda log: streams.deduplicated(log, key), "append").groupBy("site_id").agg(F.count("*").alias("n"))


def liveness(spark: SparkSession, d: str) -> DataFrame:
    r = _run(spark, d, streams.liveness, "update")
    return r.select("site_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "consecutive_failures", F.col("last_ok").cast("timestamp_ntz").alias("last_ok"))


_ALIVE = "(" + ", ".join(f"'{x}'" for x in ALIVE) + ")"
QUERIES = {"st_fetch_rate": fetch_rate, "st_activity": activity, "st_dedupe": deduplicated, "st_liveness": liveness}
SQL = {
    "st_fetch_rate": "SELECT t, outcome, count(*) AS n FROM (SELECT outcome, unnest(generate_series(date_trunc('minute', ts) + INTERVAL 1 MINUTE, date_trunc('minute', ts) + INTERVAL 5 MINUTE, INTERVAL 1 MINUTE)) AS t FROM fetch_log) GROUP BY 1, 2",
    "st_activity": f"SELECT date_trunc('hour', ts) AS t, count(*) AS fetches, count(*) FILTER (WHERE outcome = 'ok') AS ok, count(*) FILTER (WHERE outcome IN {_ALIVE}) AS alive FROM fetch_log GROUP BY 1",
    "st_dedupe": "SELECT site_id, count(*) AS n FROM (SELECT DISTINCT ts, site_id, url_hash, outcome, latency_ms, proxy FROM fetch_log) GROUP BY 1",
    "st_liveness": f"""WITH l AS (SELECT site_id, ts, outcome, outcome IN {_ALIVE} AS alive FROM fetch_log), o AS (SELECT site_id, max((ts, outcome)) AS ok FROM l WHERE alive GROUP BY 1)
SELECT l.site_id, max(ts) AS ts, CAST(count(*) FILTER (WHERE o.ok IS NULL OR (ts, outcome) > o.ok) AS INTEGER) AS consecutive_failures, any_value(o.ok[1]) AS last_ok FROM l LEFT JOIN o USING (site_id) GROUP BY 1""",
}
