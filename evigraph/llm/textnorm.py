"""Text folding shared by the corpus operators: what a reader wouldn't notice doesn't count."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

#: Characters without width or meaning: format controls, variation selectors, fillers.
HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}--[\u0300-\u036f\u3099\u309a]]|[\u115f\u1160\u3164\uffa0\u034f]", regex.V1)
URL = re.compile(r"(?:https?://|ftp://|www\.)[^\s<>\"'()\[\]|`　]+", re.IGNORECASE)
_ESCAPE = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|%((?:[0-9a-fA-F]{2}%)*[0-9a-fA-F]{2})|\\([nrt\"'/\\])")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code:
        value = int(code, 16)
        return chr(value) if value <= 0x10FFFF else m[0]
    if m[4]:
        try:
            return bytes.fromhex(m[4].replace("%", "")).decode("utf-8")
        except ValueError:
            return m[0]
    return {"n": "\n", "r": "\n", "t": "\t"}.get(m[5], m[5])


def fold(text: str) -> str:
    """Entities and escapes resolved, compatible forms (width, ligatures) unified, hidden characters dropped."""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text or "%" in text:
        text = _ESCAPE.sub(_unescape, text)
        if "\ud800" <= max(text, default="") <= "\udfff" or any("\ud800" <= c <= "\udfff" for c in text):
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", HIDDEN.sub("", text))
    return text
