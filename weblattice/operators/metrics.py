"""Counters, gauges and histograms as a long table (ts, metric, labels, value), and range queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Upper bounds of the latency histogram, in seconds.
BUCKETS = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0, 90.0, 120.0)
#: Fixed value: outcomes that are no fault of a proxy, as a matcher.
ANSWERED = "ok|http_error"
POINTS, LEAST_STEP, MAX_HOURS, DEFAULT_HOURS = 300, 15, 168, 6

#: Series by name: (metric, kind, seconds of the range, labels summed by, matcher, quantile).
SERIES = {
    "fetch_rate": ("crawler_fetches_total", "rate", 300, ("outcome",), None, None),
    "pages_rate": ("crawler_pages_stored_total", "rate", 300, (), None, None),
    "links_rate": ("crawler_links_queued_total", "rate", 300, (), None, None),
    "workers": ("crawler_busy_workers", "gauge", 0, (), None, None),
    "frontier": ("crawler_frontier", "gauge", 0, ("kind",), None, None),
    "sites": ("crawler_sites", "gauge", 0, ("status",), None, None),
    "latency": ("crawler_fetch_duration_seconds_bucket", "quantile", 300, ("le",), ("outcome", "=", "ok"), 0.5),
    "latency_p95": ("crawler_fetch_duration_seconds_bucket", "quantile", 300, ("le",), ("outcome", "=", "ok"), 0.95),
    "errors": ("crawler_internal_errors_total", "rate", 300, ("component",), None, None),
    "blocklist": ("crawler_blocklist_skips_total", "rate", 300, ("stage",), None, None),
    "purges": ("crawler_site_purges_total", "rate", 900, ("reason",), None, None),
}


def label(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("labels"), F.lit(name)), F.lit(""))


def matches(name: str, op: str, value: str) -> Column:
    """A label matcher; patterns must match the whole label."""
    x = label(name)
    return {"=": x == value, "!=": x != value, "=~": x.rlike(f"^(?:{value})$"), "!~": ~x.rlike(f"^(?:{value})$")}[op]


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def increases(samples: DataFrame, key: list[str]) -> DataFrame:
    """Each sample's increase over the one before in its series; a counter that fell was reset and counts from nought."""
    before = F.lag("value").over(Window.partitionBy(*key).orderBy("ts"))
    return samples.withColumn("increase", F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def rates(samples: DataFrame, key: list[str], window: int) -> DataFrame:
    """(key, ts, rate): the increase per second over the last ``window`` seconds at each sample."""
    at = samples.withColumn("sec", F.floor(seconds()).cast("long"))
    w = Window.partitionBy(*key).orderBy("sec").rangeBetween(-window, 0)
    return increases(at, key).withColumn("rate", F.sum("increase").over(w) / window)


def sum_by(rated: DataFrame, labels: tuple[str, ...], step: int) -> DataFrame:
    """(t, labels, value) at every step: the mean of each series within it, summed by labels."""
    t = (F.floor(F.col("sec") / step) * step).cast("long").alias("t")
    series = rated.groupBy(t, F.col("series"), *[label(x).alias(x) for x in labels]).agg(F.avg("rate").alias("rate"))
    return series.groupBy("t", *labels).agg(F.sum("rate").alias("value"))


def histogram_quantile(q: float, buckets: DataFrame, key: list[str]) -> DataFrame:
    """(key, value): the quantile by linear interpolation within the bucket it falls into; buckets (key, le, value) are cumulative.

    Beyond the last finite bound the value is that bound; an empty histogram has none.
    """
    b = buckets.withColumn("bound", F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.expr("try_cast(le AS double)")))
    w = Window.partitionBy(*key).orderBy("bound")
    total = F.max("value").over(Window.partitionBy(*key))
    b = b.withColumn("rank", q * total).withColumn("below", F.coalesce(F.lag("value").over(w), F.lit(0.0))).withColumn("lower", F.coalesce(F.lag("bound").over(w), F.lit(0.0)))
    first = b.where((F.col("value") >= F.col("rank")) & (F.col("rank") > 0)).groupBy(*key).agg(F.min_by(F.struct("bound", "lower", "below", "value", "rank"), "bound").alias("x"))
    inside = F.col("x.lower") + (F.col("x.bound") - F.col("x.lower")) * (F.col("x.rank") - F.col("x.below")) / F.greatest(F.col("x.value") - F.col("x.below"), F.lit(1e-12))
    return first.select(*key, F.when(F.col("x.bound") == float("inf"), F.col("x.lower")).otherwise(inside).alias("value"))


def step_of(hours: int | None) -> tuple[int, int]:
    """(hours, step): hours within bounds, and the step that gives about 300 points."""
    h = DEFAULT_HOURS if hours is None or hours <= 0 else min(hours, MAX_HOURS)
    return h, max(LEAST_STEP, h * 3600 // POINTS)


def series(samples: DataFrame, name: str, hours: int | None = None) -> DataFrame:
    """(name, t, value) of one of SERIES over the last hours of the samples."""
    metric, kind, window, by, matcher, q = SERIES[name]
    h, step = step_of(hours)
    mine = samples.where(F.col("metric") == metric)
    if matcher:
        mine = mine.where(matches(*matcher))
    end = samples.agg(F.max("ts")).scalar()
    mine = mine.where(F.col("ts") > end - F.expr(f"INTERVAL '{h}' HOUR")).withColumn("series", F.to_json(F.array_sort(F.map_entries("labels"))))
    if kind == "gauge":
        rated = mine.withColumn("sec", F.floor(seconds()).cast("long")).withColumn("rate", F.col("value"))
    else:
        rated = rates(mine, ["series"], window)
    out = sum_by(rated, by, step)
    if kind == "quantile":
        return histogram_quantile(q, out, ["t"]).select(F.lit(name).alias("name"), "t", "value")
    called = F.col(by[0]) if by else F.lit("")
    return out.select(F.when(called == "", name).otherwise(called).alias("name"), "t", "value")


def from_log(log: DataFrame) -> DataFrame:
    """The metrics that a crawl would have counted, from its log: fetches by outcome and proxy, and the latency histogram by outcome.

    A sample per minute and series; counters run from the log's first row.
    """
    minute = F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz")
    known = log.select(minute.alias("ts"), F.coalesce("outcome", F.lit("")).alias("outcome"), F.coalesce("proxy", F.lit("")).alias("proxy"), (F.col("latency_ms") / 1000.0).alias("sec"))
    counted = known.groupBy("ts", F.create_map(F.lit("outcome"), F.col("outcome"), F.lit("proxy"), F.col("proxy")).alias("m"), "outcome", "proxy").agg(F.count("*").alias("n"))
    run = Window.partitionBy("outcome", "proxy").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    fetches = counted.select("ts", F.lit("crawler_fetches_total").alias("metric"), F.col("m").alias("labels"), F.sum("n").over(run).cast("double").alias("value"))
    per = known.where("sec IS NOT NULL").groupBy("ts", "outcome").agg(*[F.count_if(F.col("sec") <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)], F.count("*").alias("all"))
    le = F.explode(F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))))
    long = per.select("ts", "outcome", le.alias("x")).select("ts", "outcome", "x.le", "x.n")
    run = Window.partitionBy("outcome", "le").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    hist = long.select("ts", F.lit("crawler_fetch_duration_seconds_bucket").alias("metric"), F.create_map(F.lit("outcome"), F.col("outcome"), F.lit("le"), F.col("le")).alias("labels"), F.sum("n").over(run).cast("double").alias("value"))
    return fetches.unionByName(hist)


def error_ratio(samples: DataFrame, step: int) -> DataFrame:
    """(t, proxy, value): fetches without an answer per all fetches, by proxy; none where there were none. An HTTP error is an answer."""
    mine = samples.where("metric = 'crawler_fetches_total'").withColumn("series", F.to_json(F.array_sort(F.map_entries("labels"))))
    r = rates(mine, ["series"], 300)
    t = (F.floor(F.col("sec") / step) * step).cast("long").alias("t")
    x = r.groupBy(t, label("proxy").alias("proxy")).agg(F.sum(F.when(matches("outcome", "!~", ANSWERED), F.col("rate")).otherwise(0.0)).alias("bad"), F.sum("rate").alias("all"))
    return x.select("t", "proxy", F.when(F.col("all") > 0, F.col("bad") / F.col("all")).alias("value"))
