"""Canonical JSON: one text per JSON value, whatever its spelling."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from decimal import Decimal, InvalidOperation
from functools import lru_cache

# Keys (letters and digits, lower case) whose values differ in each run.
VOLATILE_KEYS = frozenset({"capturedat", "analyzedat", "generatedat", "observedat", "sourcefingerprint"})
# Further such keys of nodes of type SPAN.
VOLATILE_SPAN_KEYS = frozenset({"traceid", "spanid", "starttimeunixnano", "timeunixnano"})

_NUMBER = "\x00#"


@lru_cache(maxsize=4096)
def bare_key(key: str) -> str:
    """Letters and digits of a key, lower case: ``observed-at`` and ``observedAt`` agree."""
    return "".join(c for c in key.lower() if c.isalnum())


def _number(text: str) -> int | str:
    try:
        d = Decimal(text)
    except InvalidOperation:
        return _NUMBER + text
    if not d.is_finite() or abs(d.adjusted()) > 400:
        return _NUMBER + str(d.normalize())
    if d == d.to_integral_value():
        return int(d)
    return _NUMBER + format(d.normalize(), "f")


def _reader(drop: frozenset[str]) -> Callable[[str], object]:
    hook = lambda pairs: {k: v for k, v in pairs if bare_key(k) not in drop}
    decoder = json.JSONDecoder(object_pairs_hook=hook, parse_float=_number, parse_constant=lambda t: _NUMBER + t)
    return decoder.decode


_READERS = {False: _reader(VOLATILE_KEYS), True: _reader(VOLATILE_KEYS | VOLATILE_SPAN_KEYS)}


@lru_cache(maxsize=65536)
def canonical(text: str, span: bool = False) -> str:
    """Canonical text of a JSON value without volatile keys; text that isn't JSON stands for itself."""
    try:
        value = _READERS[span](text)
    except (ValueError, RecursionError):
        return "\x00!" + text
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def attributes_digest(pairs: list[tuple[str, str]], span: bool) -> int:
    """64-bit digest of an attribute map given as (key, JSON text) pairs, order-free."""
    drop = VOLATILE_KEYS | VOLATILE_SPAN_KEYS if span else VOLATILE_KEYS
    cells = sorted((k, canonical(v, span)) for k, v in pairs if bare_key(k) not in drop)
    text = "\x01".join(f"{k}\x02{v}" for k, v in cells)
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
