"""Event-time streams over the crawl's log and captures.

Late rows: a row is dropped once the watermark, the latest time seen less DELAY, has passed its window. Deduplication and the
state of sites and pages keep state per key in the state store, never a list of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weblattice.functions.fetching import ALIVE, is_alive
from weblattice.operators import predicates, search, state
from weblattice.sources.snapshots import latest

DELAY = "10 minutes"


def log_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The log as a stream of Parquet files, its times as timestamps."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)


def fetch_rate(log: DataFrame) -> DataFrame:
    """Fetches per second by outcome over the last 5 minutes, every minute."""
    w = F.window("ts", "5 minutes", "1 minute")
    return log.groupBy(w, "outcome").agg(F.count("*").alias("n")).select(F.col("window.end").alias("t"), "outcome", "n", (F.col("n") / 300).alias("rate"))


def activity(log: DataFrame) -> DataFrame:
    """Fetches and answered fetches per hour."""
    return log.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("fetches"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(is_alive(F.col("outcome"))).alias("alive")).select(F.col("window.start").alias("t"), "fetches", "ok", "alive")


def sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of fetches of one site that no gap parts."""
    return log.groupBy(F.session_window("ts", gap), "site_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("t"), F.col("session_window.end").alias("until"), "site_id", "n")


def deduplicated(log: DataFrame, key: list[str]) -> DataFrame:
    """Each key's first row within the watermark."""
    return log.dropDuplicatesWithinWatermark(key)


_STATE = "ts timestamp, last_ok timestamp, failures int, status string"
LIVE = "site_id long, ts timestamp, status string, consecutive_failures int, last_ok timestamp"


def liveness(log: DataFrame) -> DataFrame:
    """The state of each site after every batch that has rows of it; rows earlier than the state's time when the batch begins are late and ignored.

    A site may have any number of rows in a batch, which come in pieces of any order: of these are kept the last row, the last
    answer, and how many failures each moment after the last answer has.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        ts, last_ok, failures, status, first = pd.NaT, pd.NaT, 0, "unknown", pd.NaT
        if held.exists:
            ts, last_ok, failures, status = held.get
            last_ok = pd.NaT if last_ok is None else last_ok
        last, ok, failed = None, None, pd.Series(dtype="int64")
        for rows in batches:
            first = min((t for t in (first, rows["ts"].min()) if not pd.isna(t)), default=pd.NaT)
            known = rows["ts"].notna() if pd.isna(ts) else rows["ts"] >= ts
            moments = rows.loc[known, ["ts", "outcome"]].fillna({"outcome": ""}).groupby(["ts", "outcome"]).size()  # in order
            if not len(moments):
                continue
            last = max(moments.index[-1], last or moments.index[-1])
            alive = moments.index.isin(ALIVE, level="outcome")
            if alive.any():
                ok = max(moments.index[alive][-1], ok or moments.index[alive][-1])
            failed = moments[~alive] if failed.empty else failed.add(moments[~alive], fill_value=0)
            if ok is not None and len(failed):
                t, outcome = failed.index.get_level_values("ts"), failed.index.get_level_values("outcome")
                failed = failed[(t > ok[0]) | (t == ok[0]) & (outcome > ok[1])]
        if last is None and not held.exists:
            return
        if last is not None:
            if ok is not None:
                last_ok, failures = ok[0], 0
            failures += int(failed.sum())
            before = {"first_seen": first, "last_ok": last_ok, "consecutive_failures": max(failures - 1, 0)}
            ts, status = last[0], state.step(before, *last)["status"]
        held.update((ts, None if pd.isna(last_ok) else last_ok, failures, status))
        yield pd.DataFrame({"site_id": [key[0]], "ts": [ts], "status": [status], "consecutive_failures": [failures], "last_ok": [last_ok]})

    return log.groupBy("site_id").applyInPandasWithState(step, LIVE, _STATE, "update", GroupStateTimeout.NoTimeout)


VERSIONS = "page_id long, id long, fetched_at timestamp"


def versions(captures: DataFrame) -> DataFrame:
    """The captures (id, page_id, fetched_at, text_hash) whose text differs from that of the capture before of the same page."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        for rows in batches:
            out = []
            for i, at, h in rows.sort_values(["fetched_at", "id"])[["id", "fetched_at", "text_hash"]].itertuples(index=False):
                if h != last:
                    out.append((key[0], i, at))
                    last = h
            yield pd.DataFrame(out, columns=["page_id", "id", "fetched_at"])
        held.update((last,))

    return captures.groupBy("page_id").applyInPandasWithState(step, VERSIONS, "text_hash string", "append", GroupStateTimeout.NoTimeout)


def unblocked(log: DataFrame, sites: DataFrame, read_blocklist: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch function that reads the blocklist anew and hands on the rows of sites that aren't on it."""

    def each(batch: DataFrame, number: int) -> None:
        bad = predicates.on_blocklist(sites, read_blocklist()).select(F.col("id").alias("site_id"))
        write(batch.join(bad, "site_id", "left_anti"), number)

    return each


def indexer(folder: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes the postings of a batch of documents and which pages it has; doing a batch again overwrites it.

    A page that is indexed again stays in its old batches as well: index() reads it from the last one. Of several rows of a page in one batch the one of the
    last version counts, or of the greatest text where there are no versions.
    """

    def each(batch: DataFrame, number: int) -> None:
        order = [c for c in ("version_id", "title", "text") if c in batch.columns]
        last = latest(batch, ["page_id"], order)
        search.inverted(last).write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        last.select("page_id").write.mode("overwrite").parquet(f"{folder}/pages/batch={number}")

    return each


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The postings that indexer() wrote, of each page those of its last batch; the last write wins, also one without any word."""
    last = spark.read.parquet(f"{folder}/pages").groupBy("page_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/postings").join(last, ["page_id", "batch"], "left_semi").drop("batch")


def periodic(job: Callable[[], None]) -> Callable[[DataFrame, int], None]:
    """A batch function that runs a whole batch job, for triggers such as ``processingTime='15 minutes'``."""
    return lambda _batch, _number: job()


def run(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, name: str | None = None, mode: str = "append"):
    """Runs a stream over what there is now and waits for its end; into a table in memory, or through a batch function."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(each) if each else w.format("memory").queryName(name)).start()
    q.awaitTermination()
    return q


