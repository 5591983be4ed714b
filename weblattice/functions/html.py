"""Captured HTML to clean HTML, title, text and links.

The standard library's tokenizer feeds a small tree; whatever renders media, embeds documents or runs code is left out
while it is built, and links are read only from what is left.
"""

from __future__ import annotations

import codecs
import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Elements left out with all they hold, attributes left out, and elements that break lines.
DROPPED = frozenset("script style noscript template img svg math picture source video audio track canvas object embed applet param iframe frame frameset link image".split())
DROPPED_ATTRS = frozenset("style src srcset srcdoc background poster lowsrc dynsrc data codebase archive classid xlink:href ping formaction action icon manifest".split())
BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article header footer nav aside blockquote pre table ul ol dl dt dd hr form fieldset main td th title address figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame image".split())
RISKY = ("data:", "javascript:", "vbscript:")
#: Elements of a head; anything else ends it.
_HEAD_ONLY = frozenset("title base meta link style script noscript template".split())
#: Which open elements a new one closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_ENDS_P = frozenset("div ul ol dl table form h1 h2 h3 h4 h5 h6 pre blockquote section article header footer nav aside main hr fieldset address p".split())
ANCHOR_CHARS = 300
#: Names that can't be read as markup themselves.
_TAG_NAME, _ATTR_NAME = re.compile(r"[a-z][a-z0-9:_-]*"), re.compile(r"[^\s\"'<>/=\x00]+")


def risky(value: str | None) -> bool:
    """Whether an attribute's value carries data or code, however it is spaced or cased."""
    v = re.sub(r"[\s\x00]+", "", value or "").lower()
    return any(r in v for r in RISKY)


def squeeze(text: str) -> str:
    return " ".join(text.split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html: list[str] = []
        self.text: list[str] = []
        self.open: list[str] = []
        self.dropped = 0  # how deep within a dropped element
        self.dropping = ""
        self.in_head = True  # a head needs no tag of its own
        self.title: str | None = None
        self.base: str | None = None
        self.links: list[list[str]] = []
        self.anchors: list[int] = []

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            if tag == self.dropping and tag not in VOID:
                self.dropped += 1
            return
        if tag in DROPPED:
            if tag not in VOID:
                self.dropped, self.dropping = 1, tag
            return
        if not _TAG_NAME.fullmatch(tag):
            return
        if tag == "head":
            self.in_head = True
        elif self.in_head and tag != "html" and tag not in _HEAD_ONLY:
            self.in_head = False
        if tag in _ENDS_P and "p" in self.open:
            self._close("p")
        for other in _CLOSES.get(tag, ()):
            if self.open and self.open[-1] == other:
                self._close(other)
        kept = [(k.lower(), v) for k, v in attrs if _ATTR_NAME.fullmatch(k) and k.lower() not in DROPPED_ATTRS and not k.lower().startswith("on") and not risky(v)]
        given = dict(reversed(kept))
        self.html.append("<" + tag + "".join(f' {k}="{escape(v or "")}"' for k, v in kept) + ">")
        if tag in BLOCKS:
            self.text.append("\n")
        if tag == "base":
            self.base = self.base or given.get("href")
        elif tag in ("a", "area"):
            if given.get("href"):
                self.links.append([given["href"], ""])
            if tag == "a":
                self.anchors.append(len(self.links) - 1 if given.get("href") else -1)
        if tag not in VOID and tag != "area":
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.dropped and tag == self.dropping:
            self.handle_endtag(tag)

    def _close(self, tag):
        while self.open:
            t = self.open.pop()
            self.html.append(f"</{t}>")
            if t in BLOCKS:
                self.text.append("\n")
            if t == "a" and self.anchors:
                self.anchors.pop()
            if t == tag:
                break

    def handle_endtag(self, tag):
        if self.dropped:
            if tag == self.dropping:
                self.dropped -= 1
            return
        if tag == "head":
            self.in_head = False
        if tag == "br":
            self.text.append("\n")
        elif tag in self.open:
            self._close(tag)

    def handle_data(self, data):
        if self.dropped:
            return
        self.html.append(escape(data, quote=False))
        if "title" in self.open:
            if self.title is None or self.open[-1] == "title":
                self.title = (self.title or "") + data
            if self.in_head:
                return
        if self.in_head:
            if not data.strip():
                return
            self.in_head = False
        for i in self.anchors:
            if i >= 0:
                self.links[i][1] += data + " "
        self.text.append(re.sub(r"\s", " ", data))

    def finish(self):
        self.close()
        while self.open:
            self._close(self.open[-1])


def process(html: str | None) -> dict:
    """Clean HTML, title, text (lines with their white space collapsed, empty ones left out), declared base and links in order.

    Null and empty input give empty results.
    """
    b = _Builder()
    b.feed(html or "")
    b.finish()
    lines = (squeeze(x) for x in "".join(b.text).split("\n"))
    base = b.base if b.base and re.match(r"(?i)https?://([^/?#@]*@)?[^/?#:]*\.onion(?=[:/?#]|$)", b.base) else None
    return {"html": "".join(b.html), "title": squeeze(b.title or ""), "text": "\n".join(x for x in lines if x), "base": base, "links": [{"url": u, "anchor": squeeze(a)[:ANCHOR_CHARS]} for u, a in b.links]}


_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:-]+)", re.IGNORECASE)


def decode(body: bytes | None, content_type: str | None) -> str | None:
    """The text of a body, by the charset of its type or of its own head; an unknown one is read as UTF-8."""
    if body is None:
        return None
    named = re.search(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", content_type or "", re.IGNORECASE)
    label = named.group(1) if named else m.group(1).decode() if (m := _META.search(body[:1024])) else "utf-8"
    label = {"iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252"}.get(label.lower(), label)
    try:
        codecs.lookup(label)
    except LookupError:
        label = "utf-8"
    return body.decode(label, "replace")


_LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("anchor", T.StringType())])
PAGE = T.StructType([*(T.StructField(c, T.StringType()) for c in ("html", "title", "text", "base")), T.StructField("links", T.ArrayType(_LINK))])


@pandas_udf(PAGE)
def sanitized(html: pd.Series) -> pd.DataFrame:
    """process() of each document."""
    return pd.DataFrame([process(h) for h in html], columns=["html", "title", "text", "base", "links"])


@pandas_udf(T.StringType())
def decoded(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decode(b, t) for b, t in zip(body, content_type)], dtype=object)
