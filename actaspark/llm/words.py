"""Plain words of a text, for comparisons to which case, accents, punctuation, spacing and line breaks do not matter."""

from __future__ import annotations

import re
import unicodedata

_BROKEN = re.compile("[ÃÂâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,2}")
_TAG = re.compile(r"<[a-zA-Z/!][^<>]{0,300}>")
_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{1,6});")
_WORD = re.compile(r"[^\W_]+")


def _repair(m: re.Match) -> str:
    """UTF-8 once read as Windows-1252, read again; unchanged where that fails."""
    raw = b""
    for c in m.group():
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return m.group()
            raw += bytes((ord(c),))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


class _Plain(dict):
    """The plain form of each character outside ASCII, found when first asked for."""

    def __missing__(self, c: str) -> str:
        out = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x) and unicodedata.category(x) != "Cf").lower()
        self[c] = out
        return out


_PLAIN = _Plain()
_OTHER = re.compile(r"[^\x00-\x7f]")


def plain(text: str) -> str:
    """Lower case without accents, tags and invisible characters; broken UTF-8 repaired."""
    if not text.isascii():
        if "Ã" in text or "Â" in text or "â" in text:
            text = _BROKEN.sub(_repair, text)
        text = _OTHER.sub(lambda m: _PLAIN[m.group()], text.lower())
    else:
        text = text.lower()
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    return text


_BLANKED = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})


def words(text: str | None) -> list[str]:
    if not text:
        return []
    text = plain(text)
    return text.translate(_BLANKED).split() if text.isascii() else _WORD.findall(text)
