"""Byte-pair encoding by prefix dynamic programming (problem 7).

For every prefix of a byte string the last token of its encoding is unique. It is the one
token that ends there and stays next to the last token of the prefix before it, that is,
encoding the two together gives exactly the two. Storing one last token per byte is enough
to read the encoding off backwards, to append without looking back, and to re-encode only
what lies near an edit.
"""

from __future__ import annotations

import base64
import importlib
from functools import lru_cache

import regex


def tokenizer_folder() -> str:
    """Where the public tokenizers lie unless a path is given."""
    return "/opt/tokenizers"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def published_pattern() -> str | None:
    """The pre-tokenization pattern published beside the vocabularies, if importable."""
    try:
        return importlib.import_module("public_tokenizers").PATTERN
    except ImportError:
        return None


# The pre-tokenization of byte-level BPE vocabularies of this kind.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PrefixEncoder:
    """Encoder for one vocabulary; a token's id is its merge rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self.split: dict[int, tuple[int, int]] = {}
        self._join: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._last_merge(token, rank)
                if parts:
                    self.split[rank] = parts
                    self._join[parts] = rank
        self.word = lru_cache(maxsize=500_000)(self._word)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``: merging its bytes with lower ranks ends in a pair."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def stays(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes together gives exactly these two.

        Undoing merges from the latest on, no pair across the seam may ever merge earlier
        than the merges that made its sides.
        """
        limit = 1 << 60
        while True:
            across = self._join.get((left, right))
            if across is not None and across < limit:
                return False
            ls, rs = self.split.get(left), self.split.get(right)
            if ls is None and rs is None:
                return True
            if rs is None or (ls is not None and left > right):
                limit, left = left, ls[1]
            else:
                limit, right = right + 1, rs[0]

    def last_tokens(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """Extend ``last``, which holds the last token per prefix of ``data``, to all of it."""
        last = [] if last is None else last
        for end in range(len(last) + 1, len(data) + 1):
            for size in range(min(end, self.longest), 0, -1):
                token = self.ranks.get(data[end - size : end])
                if token is None:
                    continue
                if (size == end and self._whole(token, data[:end])) or (size < end and self._fits(last, end - size, token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return last

    def _whole(self, token: int, data: bytes) -> bool:
        return len(data) == 1 or token in self.split

    def _fits(self, last: list[int], end: int, token: int) -> bool:
        return (len(self.tokens[token]) == 1 or token in self.split) and self.stays(last[end - 1], token)

    def read_off(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            token = last[end - 1]
            ids.append(token)
            end -= len(self.tokens[token])
        return ids[::-1]

    def _word(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.read_off(self.last_tokens(data)))

    def encode(self, text: str | None) -> list[int]:
        """Token ids; null and empty texts have none. Strings of special tokens are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        word = self.word
        for piece in self.pattern.findall(text):
            out.extend(word(piece) if len(piece) <= 64 else self._word(piece))
        return out


class EditableEncoding:
    """Encoding of one text that takes appends and edits and re-encodes only near them."""

    def __init__(self, encoder: PrefixEncoder, text: str = "") -> None:
        self.encoder, self.text = encoder, ""
        self.pieces: list[str] = []
        self.edit(0, 0, text)

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in self.encoder.word(p)]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace ``text[start:end]``. Pieces before and well after the change are kept."""
        text = self.text[:start] + new + self.text[end:]
        starts = [0]
        for p in self.pieces:
            starts.append(starts[-1] + len(p))
        first = 0
        while first < len(self.pieces) and starts[first + 1] < start:
            first += 1
        first = max(0, first - 1)  # white space before the change may split anew
        kept = self.pieces[:first]
        shift = len(new) - (end - start)
        old = {s + shift: k for k, s in enumerate(starts[:-1]) if s >= end}
        for m in self.encoder.pattern.finditer(text, starts[first]):
            k = old.get(m.start())
            if k is not None and m.start() > start + len(new):
                kept.extend(self.pieces[k:])
                break
            kept.append(m.group())
        self.text, self.pieces = text, kept
