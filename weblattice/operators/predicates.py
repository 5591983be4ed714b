"""Filters that queries are put together from; one that isn't asked for leaves no trace in the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def all_of(*predicates: Column | None) -> Column:
    """Their conjunction; None is left out, nothing at all is true."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def optional(column: str, value) -> Column | None:
    """column = value, or nothing for an empty string, None or a negative number. A null in the column never matches."""
    if value is None or value == "" or isinstance(value, int) and value < 0:
        return None
    return F.col(column) == value


def contains_any_case(column: str, q: str) -> Column | None:
    """The column holds q in any case; % and _ in q are wildcards."""
    return F.col(column).ilike(f"%{q}%") if q else None


def within(ts: str, as_of: Column, interval: str) -> Column:
    """Later than as_of less an interval, the bound left out."""
    return F.col(ts) > as_of - F.expr(f"INTERVAL {interval}")


def differs(a: str, b: str) -> Column:
    """IS DISTINCT FROM."""
    return ~F.col(a).eqNullSafe(F.col(b))


def any_of(df: DataFrame, column: str, values, small: int = 1000) -> DataFrame:
    """Rows whose column is among the values: a literal list, or beyond ``small`` of them a semi-join."""
    values = list(dict.fromkeys(values))
    if len(values) <= small:
        return df.where(F.col(column).isin(*values) if values else F.lit(False))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {df.schema[column].dataType.simpleString()}")
    return df.join(wanted, column, "left_semi")


def on_blocklist(sites: DataFrame, blocklist: DataFrame) -> DataFrame:
    """The sites one of whose two hashes is on the list."""
    both = sites.select("id", F.explode(F.array(F.md5(F.concat("onion", F.lit(".onion"))), F.md5("onion"))).alias("md5"))
    hit = both.join(blocklist.select("md5"), "md5", "left_semi").select("id").distinct()
    return sites.join(hit, "id", "left_semi")
