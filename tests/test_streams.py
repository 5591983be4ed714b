from __future__ import annotations

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from weblattice.operators import state
from weblattice.streaming import streams

T0 = dt.datetime(2025, 1, 1)
DDL = "ts timestamp, site_id long, outcome string"


def source(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{path}/in{i}")
    import glob
    import os
    import shutil

    os.makedirs(f"{path}/in")
    for i in range(len(batches)):
        (f,) = glob.glob(f"{path}/in{i}/*.parquet")
        shutil.move(f, f"{path}/in/{i}.parquet")
        os.utime(f"{path}/in/{i}.parquet", (1e9 + i, 1e9 + i))  # files are read in this order
    return streams.log_stream(spark, f"{path}/in", spark.createDataFrame([], DDL).schema)


def at(m):
    return T0 + dt.timedelta(minutes=m)


def test_late_rows_are_dropped(spark, tmp_path):
    # a batch drops what is late by the watermark that the batch before it began with
    log = source(spark, tmp_path, [[(at(0), 1, "ok"), (at(61), 1, "timeout")], [(at(200), 1, "ok")], [(at(210), 1, "ok")], [(at(5), 1, "ok"), (at(300), 2, "ok")]])
    streams.run(streams.activity(log), f"{tmp_path}/c", name="act", mode="append")
    rows = {r.t: (r.fetches, r.ok) for r in spark.table("act").collect()}
    assert rows[T0] == (1, 1) and rows[at(60)] == (1, 0)


def test_state_survives_batches(spark, tmp_path):
    log = source(spark, tmp_path, [[(at(0), 1, "timeout"), (at(1), 1, "desc_not_found")], [(at(2), 1, "desc_not_found"), (at(0), 2, "ok")], [(at(3), 1, "ok"), (at(4), 2, "timeout")]])
    streams.run(streams.liveness(log), f"{tmp_path}/c", name="live", mode="update")
    last = {r.site_id: r.x for r in spark.table("live").groupBy("site_id").agg(F.max_by(F.struct("status", "consecutive_failures"), "ts").alias("x")).collect()}
    assert tuple(last[1]) == ("up", 0) and tuple(last[2]) == ("flaky", 1)
    assert spark.table("live").where("site_id = 1 AND consecutive_failures = 3").count() == 1


def test_state_doesnt_depend_on_the_order_of_pieces(spark, tmp_path):
    rng, outcomes = random.Random(5), ["ok", "timeout", "desc_not_found", "rend_failed", "http_error"]
    rows = [(at(rng.randrange(40)), s, outcomes[min(rng.randrange(12), 4)] if s < 3 else "timeout") for s in (1, 2, 3) for _ in range(150)]
    rows += [(at(41 + k // 3), 1, "timeout") for k in range(40)] + [(at(60 + k), 4, "timeout") for k in range(30)] + [(at(75), 4, "ok")]
    rng.shuffle(rows)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        streams.run(streams.liveness(source(spark, tmp_path, [rows])), f"{tmp_path}/c", name="pieces", mode="update")
    finally:
        spark.conf.set(size, before)
    got = {r.site_id: (r.ts, r.consecutive_failures, r.last_ok, r.status) for r in spark.table("pieces").collect()}
    for s in (1, 2, 3, 4):
        own = sorted((t, o) for t, i, o in rows if i == s)
        x = state.fold(((pd.Timestamp(t), o) for t, o in own), pd.Timestamp(own[0][0]))
        assert got[s] == (own[-1][0], x["consecutive_failures"], None if pd.isna(x["last_ok"]) else x["last_ok"].to_pydatetime(), x["status"])


def test_deduplication_and_batch_functions(spark, tmp_path):
    log = source(spark, tmp_path, [[(at(0), 1, "ok"), (at(0), 1, "ok")], [(at(0), 1, "ok"), (at(1), 2, "ok")]])
    sites = spark.createDataFrame([(1, "a"), (2, "b")], "id long, onion string")
    seen, runs = [], []

    def write(df, n):
        seen.extend(r.site_id for r in df.collect())

    blocklist = lambda: spark.createDataFrame([("b",)], "x string").select(F.md5("x").alias("md5"))
    streams.run(streams.deduplicated(log, ["ts", "site_id"]), f"{tmp_path}/c", each=streams.unblocked(sites, sites, blocklist, write))
    assert seen == [1]
    streams.run(log, f"{tmp_path}/d", each=streams.periodic(lambda: runs.append(1)))
    assert len(runs) == 2


def test_the_last_write_of_a_page_wins(spark, tmp_path):
    each = streams.indexer(f"{tmp_path}/index")
    docs = lambda *rows: spark.createDataFrame(rows, "page_id long, version_id long, title string, text string")
    terms = lambda: sorted((r.page_id, r.term, r.field) for r in streams.index(spark, f"{tmp_path}/index").collect())
    each(docs((1, 1, "a", "b"), (2, 2, None, "c")), 0)
    assert terms() == [(1, "a", "title"), (1, "b", "text"), (2, "c", "text")]
    each(docs((1, 3, None, "d"), (3, 5, None, "new"), (3, 4, None, "old")), 1)
    each(docs((1, 3, None, "d"), (3, 5, None, "new"), (3, 4, None, "old")), 1)  # done again
    assert terms() == [(1, "d", "text"), (2, "c", "text"), (3, "new", "text")]
    each(docs((2, 6, None, "")), 2)
    assert terms() == [(1, "d", "text"), (3, "new", "text")]


def test_the_index_as_a_stream(spark, tmp_path):
    docs = "page_id long, site_id long, url string, title string, text string"
    spark.createDataFrame([(1, 1, "u", "a b", "b c"), (2, 1, "v", None, "c")], docs).coalesce(1).write.parquet(f"{tmp_path}/docs")
    s = spark.readStream.schema(spark.createDataFrame([], docs).schema).parquet(f"{tmp_path}/docs")
    streams.run(s, f"{tmp_path}/c", each=streams.indexer(f"{tmp_path}/index"))
    assert streams.index(spark, f"{tmp_path}/index").where("term = 'c'").count() == 2


def test_versions_keep_changes_only(spark, tmp_path):
    ddl = "page_id long, id long, fetched_at timestamp, text_hash string"
    spark.createDataFrame([(1, 1, at(0), "a"), (1, 2, at(1), "a"), (1, 3, at(2), "b"), (2, 4, at(0), "a")], ddl).coalesce(1).write.parquet(f"{tmp_path}/v")
    s = spark.readStream.schema(spark.createDataFrame([], ddl).schema).parquet(f"{tmp_path}/v")
    streams.run(streams.versions(s), f"{tmp_path}/c", name="ver", mode="append")
    assert sorted(r.id for r in spark.table("ver").collect()) == [1, 3, 4]
