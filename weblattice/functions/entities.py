"""Identifiers named in a text: keys, payment addresses, mailboxes and addresses of other sites."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weblattice.functions.onion import extract_addresses

#: Outside ASCII words: Java's own word boundary takes all letters.
_BEFORE, _AFTER = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
#: The same where a form may begin with a sign: a boundary is a change between word and other.
_B = rf"(?:{_BEFORE}(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_]){_AFTER})"
#: The forms of the identifiers.
PGP = r"-----BEGIN PGP PUBLIC KEY BLOCK-----[\s\S]+?-----END PGP PUBLIC KEY BLOCK-----"
BTC_BECH32 = "bc1[ac-hj-np-z02-9]{11,71}"
BTC_LEGACY = "[13][a-km-zA-HJ-NP-Z1-9]{25,34}"
XMR = "[48][0-9AB][1-9A-HJ-NP-Za-km-z]{93}"
ETH = "0x[a-fA-F0-9]{40}"
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}"


def _all(text: Column, pattern: str, sign: str = "") -> Column:
    """All that has the form; texts without its sign, if it has one, aren't searched."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.when(text.contains(sign), found).otherwise(F.array().cast("array<string>")) if sign else found


def _word(pattern: str) -> str:
    return _BEFORE + pattern + _AFTER


def _kind(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def text_entities(text: Column) -> Column:
    """Distinct (kind, value) of keys, payment addresses and mailboxes, by kind and in order; null text gives null.

    A key block is known by the SHA-256 of its text without white space and is left out before the rest is looked for.
    """
    blocks = _all(text, PGP, "-----BEGIN PGP")
    rest = F.when(text.contains("-----BEGIN PGP"), F.regexp_replace(text, PGP, " ")).otherwise(text)
    low = F.lower(rest)
    return F.array_distinct(
        F.concat(
            _kind("pgp", F.transform(blocks, lambda b: F.sha2(F.regexp_replace(b, r"[\s\p{Z}]+", ""), 256))),
            _kind("btc", _all(low, _word(BTC_BECH32), "bc1")),
            _kind("btc", _all(rest, _word(BTC_LEGACY))),
            _kind("xmr", _all(rest, _word(XMR))),
            _kind("eth", F.transform(_all(rest, _word(ETH), "0x"), F.lower)),
            _kind("email", F.transform(_all(rest, _B + EMAIL + _B, "@"), F.lower)),
        )
    )


def entities(text: Column, own: Column) -> Column:
    """text_entities and the addresses of other sites; own is the page's own address."""
    others = F.filter(extract_addresses(F.regexp_replace(text, PGP, " ")), lambda a: ~a.eqNullSafe(own))
    return F.concat(text_entities(text), _kind("onion", others))
