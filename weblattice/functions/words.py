"""Words: longest runs of letters or decimal digits."""

from __future__ import annotations

import re
import sys
import unicodedata

def _other(first: int, last: int) -> str:
    """What isn't a letter or decimal digit although a regular expression takes it for a word's character."""
    return "".join(chr(i) for i in range(first, last) if chr(i).isalnum() and unicodedata.category(chr(i)) in ("No", "Nl"))


WORD = re.compile(r"[^\W_]+")
# classes within one plane become bitmaps; one over all planes, or joined to \W, would be scanned member by member
_OTHER, _BEYOND = re.compile(f"[{re.escape(_other(0, 0x10000))}]"), re.compile("[\U00010000-\U0010ffff]")
_OTHER_BEYOND = re.compile(f"[{re.escape(_other(0x10000, sys.maxunicode + 1))}]")


def plain(text: str) -> str:
    """The text with each number sign that is no decimal digit as a blank; offsets stay."""
    if text.isascii():
        return text
    text = _OTHER.sub(" ", text)
    return _OTHER_BEYOND.sub(" ", text) if _BEYOND.search(text) else text


def words(text: str) -> list[str]:
    """Longest runs of letters or decimal digits, each letter lower-cased by itself."""
    text = plain(text).replace("Σ", "σ")  # else a last one would become another letter
    if "İ" in text:  # its lower case has a mark, which would part the word
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())
