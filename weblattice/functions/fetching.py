"""Outcomes of captured fetches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from weblattice.functions.hashing import fnv1a64_many

#: Outcomes in which the service itself answered.
ALIVE = ("ok", "http_error", "content_type", "too_large", "sniff", "refused", "redirect_offsite", "redirect_limit", "redirect_blocked")
#: Outcomes worth another try.
TRANSIENT = ("timeout", "conn_error", "intro_failed", "rend_failed", "intro_timeout", "socks_error", "desc_invalid")
#: Proxy reply codes.
SOCKS_REPLIES = {0xF0: "desc_not_found", 0xF1: "desc_invalid", 0xF2: "intro_failed", 0xF3: "rend_failed", 0xF4: "auth_required", 0xF5: "auth_required", 0xF6: "bad_address", 0xF7: "intro_timeout", 0x05: "refused", 0x06: "timeout"}
HTML_TYPES = ("text/html", "application/xhtml+xml")
MAX_BYTES = 2 << 20


def is_alive(outcome: Column) -> Column:
    return outcome.isin(*ALIVE)


def outcome(status: Column, content_type: Column, n_bytes: Column, head: Column, error: Column) -> Column:
    """What a captured record comes to: error first, then status, type, size and the look of its first bytes.

    A missing type is only taken for HTML where the first bytes look like it.
    """
    media = F.trim(F.lower(F.substring_index(content_type, ";", 1)))
    typed = content_type.isNotNull() & (content_type != "")
    looks_html = F.lower(head).rlike(r"^\s*<(?:!doctype html|html|head|body|script|title|h1|div|p|a|table|br|!--|font|style|b|iframe)[\s>]")
    binary = head.rlike("[\\x00-\\x08\\x0e-\\x1a\\x1c-\\x1f]")
    return (
        F.when(error.isNotNull() & (error != ""), error)
        .when((status < 200) | (status > 299), F.lit("http_error"))
        .when(typed & ~media.isin(*HTML_TYPES), F.lit("content_type"))
        .when(n_bytes > MAX_BYTES, F.lit("too_large"))
        .when(binary | (~typed & ~looks_html), F.lit("sniff"))
        .otherwise(F.lit("ok"))
    )


def socks_outcome(code: Column) -> Column:
    known = F.create_map(*[x for k, v in SOCKS_REPLIES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.lit("socks_error"))


def pick_proxy(proxies: list[str]):
    """A column function that gives each key the proxy of the highest hash, so that few keys move when one is added."""
    names = [p.encode() for p in proxies]

    @pandas_udf(T.StringType())
    def pick(keys: pd.Series) -> pd.Series:
        known = keys.fillna("")
        grid = fnv1a64_many([k.encode() + b"\0" + p for k in known for p in names]).reshape(len(known), len(names))
        return pd.Series([proxies[i] for i in grid.argmax(1)], index=keys.index)

    return pick
