"""How numbers, times and addresses are shown; halves are rounded up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def compact(n: Column) -> Column:
    """1.2k, 3.4M."""
    def short(by: float, unit: str) -> Column:
        return F.concat(F.regexp_replace(F.format_string("%.1f", n / F.lit(by)), r"\.0$", ""), F.lit(unit))

    return F.when(n >= 1e6, short(1e6, "M")).when(n >= 1e3, short(1e3, "k")).otherwise(n.cast("string"))


def milliseconds(ms: Column) -> Column:
    return F.when(ms >= 1000, F.format_string("%.1f s", ms / F.lit(1000.0))).otherwise(F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms")))


def ago(seconds: Column) -> Column:
    """How long ago, in the largest unit that fits."""
    def whole(by: int, unit: str) -> Column:
        return F.concat(F.round(seconds / by).cast("long").cast("string"), F.lit(unit))

    return F.when(seconds < 90, whole(1, "s ago")).when(seconds < 5400, whole(60, "m ago")).when(seconds < 129600, whole(3600, "h ago")).otherwise(whole(86400, "d ago"))


def short_address(a: Column) -> Column:
    return F.concat(F.left(a, F.lit(10)), F.lit("…"), F.right(a, F.lit(6)), F.lit(".onion"))


def scaled_rank(rank: Column) -> Column:
    return F.round(rank * 1e6, 1)
