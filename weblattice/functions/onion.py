"""Addresses of hidden sites and canonical URLs."""

from __future__ import annotations

import base64
import binascii
import hashlib
import posixpath
import re
from urllib.parse import parse_qsl, quote, quote_plus, unquote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

ADDRESS = r"^[a-z2-7]{56}$"
#: Query parameters that only name a session or a campaign.
SESSION_PARAMS = frozenset(("sid", "sessionid", "session_id", "phpsessid", "jsessionid", "aspsessionid", "fbclid", "gclid", "ref"))
CAMPAIGN_PREFIX = "utm_"
#: Fixed value: what stays unescaped in a path besides letters and digits.
_PATH_SAFE = "/$&+,:;=@-_.~!*'()"
DEFAULT_PORTS = {"http": 80, "https": 443}


def address_of(key: bytes) -> str:
    """The address of a 32-byte public key."""
    check = hashlib.sha3_256(b".onion checksum" + key + b"\x03").digest()[:2]
    return base64.b32encode(key + check + b"\x03").decode().lower()


def is_address(a: str | None) -> bool:
    """Whether the checksum and version of a version 3 address are right."""
    if not a or not re.match(ADDRESS, a):
        return False
    try:
        raw = base64.b32decode(a.upper())
    except binascii.Error:
        return False
    return raw[34] == 3 and address_of(raw[:32]) == a


def addresses_in(text: str | None) -> list[str]:
    """Valid addresses named in a text, each once, in order."""
    found = (m.group(1).lower() for m in re.finditer(r"([a-z2-7]+)\.onion", text or "", re.IGNORECASE))
    return list(dict.fromkeys(a for a in found if is_address(a)))


def host_address(host: str | None) -> str | None:
    """The address a host name belongs to; subdomains count for their address."""
    h = (host or "").lower()
    if not h.endswith(".onion"):
        return None
    a = h[: -len(".onion")].rpartition(".")[2]
    return a if is_address(a) else None


def _split(raw: str, base: str | None):
    try:
        u = urlsplit(urljoin(base, raw.strip()) if base else raw.strip())
        u.port  # noqa: B018 - raises on a bad port
        return u
    except ValueError:
        return None


def canonical_url(raw: str | None, base: str | None = None) -> str | None:
    """One spelling of an http(s) URL on any host; None for what isn't one.

    Host in lower case, no user, fragment or default port, a clean path that keeps its last slash, no session or campaign
    parameters, the others sorted by name and value.
    """
    u = _split(raw, base) if raw is not None else None
    if u is None or u.scheme not in DEFAULT_PORTS or not u.hostname:
        return None
    host = u.hostname.lower()
    if ":" in host:
        host = f"[{host}]"
    if u.port is not None and u.port != DEFAULT_PORTS[u.scheme]:
        host += f":{u.port}"
    path = unquote(u.path) or "/"
    clean = posixpath.normpath(path)
    clean = "/" + clean.lstrip("/") if path.startswith("/") else clean
    if path.endswith("/") and clean != "/":
        clean += "/"
    kept = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in SESSION_PARAMS and not k.lower().startswith(CAMPAIGN_PREFIX)]
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(kept))
    return urlunsplit((u.scheme, host, quote(clean, safe=_PATH_SAFE), query, ""))


def canonical(raw: str | None, base: str | None = None) -> tuple[str, str] | None:
    """(canonical URL, address) of a URL on a hidden site; None for any other."""
    url = canonical_url(raw, base)
    a = host_address(urlsplit(url).hostname) if url else None
    return (url, a) if a else None


@pandas_udf(T.BooleanType())
def valid_address(s: pd.Series) -> pd.Series:
    return s.map(is_address)


@pandas_udf(T.ArrayType(T.StringType()))
def extract_addresses(s: pd.Series) -> pd.Series:
    return s.map(addresses_in)


@pandas_udf(T.StringType())
def url_address(s: pd.Series) -> pd.Series:
    """The address a URL's host belongs to."""
    return s.map(lambda u: host_address(x.hostname) if u and (x := _split(u, None)) else None)


@pandas_udf(T.StructType([T.StructField("url", T.StringType()), T.StructField("address", T.StringType())]))
def canonical_onion(raw: pd.Series, base: pd.Series) -> pd.DataFrame:
    rows = [canonical(r, b) or (None, None) for r, b in zip(raw, base)]
    return pd.DataFrame(rows, columns=["url", "address"])


@pandas_udf(T.StringType())
def canonical_any(raw: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([canonical_url(r, b) for r, b in zip(raw, base)], dtype=object)


def home_url(address: Column) -> Column:
    return F.concat(F.lit("http://"), address, F.lit(".onion/"))
