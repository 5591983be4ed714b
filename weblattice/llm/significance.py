"""Log-likelihood ratios with control of the false discovery rate, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: p-values are counted in bins of this width of -log10(p), up to MAX_BIN bins; the counts give the cut.
BIN, MAX_BIN = 0.25, 400


def g_squared(a, n, b, m):
    """Twice the log-likelihood ratio of a hits in n against b hits in m; negative where the first rate is the lower."""
    a, n, b, m = (x.cast("double") for x in (a, n, b, m))

    def h(x):
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    g = 2 * (h(a) + h(n - a) + h(b) + h(m - b) + h(n + m) - h(n) - h(m) - h(a + b) - h(n + m - a - b))
    return F.when(a * m >= b * n, g).otherwise(-g)


def minus_log10_p(g):
    """-log10 of the upper tail of chi-squared with one degree of freedom, by its asymptotic series (exact enough for ranks)."""
    z = F.sqrt(F.greatest(g, F.lit(0.0)))
    tail = z * z / 2 / F.log(F.lit(10.0)) + F.log10(F.greatest(z + F.sqrt(z * z + 2.55), F.lit(1e-9)) * 0.6266)
    return F.when(g <= 0, F.lit(0.0)).otherwise(F.greatest(tail, F.lit(0.0)))


def significant_from(scored: DataFrame, hypotheses: Column, fdr: float) -> Column:
    """The least g2 that Benjamini and Hochberg's procedure lets pass among so many hypotheses, as a scalar subquery.

    Rows of ``scored`` are the hypotheses that were tested; the others count as not significant. Only the bins' counts,
    MAX_BIN + 1 rows at most, are gathered.
    """
    bin_ = F.least(F.floor(minus_log10_p(F.col("g2")) / BIN), F.lit(MAX_BIN)).cast("int")
    bins = scored.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("g2").alias("least"))
    bins = bins.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("bin"))))
    passing = bins.where(F.pow(F.lit(10.0), -F.col("bin") * BIN) <= F.col("above") / hypotheses * fdr)
    return passing.agg(F.coalesce(F.min("least"), F.lit(float("inf")))).scalar()
