"""Evaluation texts leaking into training text (problem 8).

Containment search in the manner of an LSH ensemble, turned round: the short test items are
the index, broadcast after a check of its size, and the documents stream past it.

* Items are cut into windows of 12 words, a window being a set of 8 five-word shingles.
* Documents are cut into overlapping blocks so that every 12-word window lies whole in one.
* Blocks are partitioned by size. The containment that must be found (one shingle of a window
  survives any admitted replacement) gives a Jaccard bound per size class, and that gives the
  number of one-row bands whose chance to miss it is at most ``MISS``.
* A block whose MinHash meets a window's in any band makes a candidate, which is verified
  exactly: shared five-word shingles fix the diagonals, and a leak is a run along one diagonal
  of at least 12 item words, at most one in eight of them replaced, the first and last kept.

There is no shuffle but the final distinct. Items beyond ``MOST_WINDOWS`` are searched in
further blocks of items, each over all documents.

Defined results: case, punctuation, layout, markup, hidden characters, character width and
escapes don't count; an opening sentence that several items share isn't part of them; null
and empty texts, null ids and items under 12 words give no rows; repeated rows count once; an
empty table on either side gives an empty result; whole texts are searched.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.textnorm import URL, fold
from evigraph.session import spread, union_all

WINDOW, SHINGLE = 12, 5
IN_WINDOW = WINDOW - SHINGLE + 1
#: One word in so many may be replaced.
REPLACED_OF = 8
MISS = 1e-4
#: Shingles of a block and step between blocks: every window lies whole in some block.
BLOCK, STEP = 24, 16
#: Upper bounds of the size classes, in shingles.
SIZES = (8, 16, 24)
#: Windows in one broadcast index, about 60 bytes each per band; more items make more blocks.
MOST_WINDOWS = 50_000
#: Items that must share an opening sentence for it to be an instruction.
SHARED_BY = 3
_BITS = 20

_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|code|mark|sub|sup|small|font)\b[^<>]*>|[*`~­]", re.IGNORECASE)
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[一-鿿぀-ヿ々]|[^\W_]+(?:[-‐‑–'’][^\W_]+)*")
_SENTENCE_END = re.compile(r"(?<=[.!?:。！？])\s")


def words(text: str) -> list[str]:
    """The words that count; the parts of a hyphenated word are one."""
    folded = fold(text)
    if "&" in folded:
        folded = html.unescape(folded)
    folded = URL.sub(" ", folded)
    folded = _TAG.sub(" ", _INLINE.sub("", folded)).casefold()
    return [re.sub(r"[^\w]", "", w) if not w.isalnum() else w for w in _WORD.findall(folded)]


@lru_cache(maxsize=400_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def word_hashes(text: str) -> np.ndarray:
    return np.fromiter((_word_hash(w) for w in words(text)), dtype=np.uint64)


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """64-bit hash of every run of five words."""
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for k in range(1, SHINGLE):
            s = s * np.uint64(0x9E3779B97F4A7C15) + (h[k : n + k] ^ (s >> np.uint64(31)))
        s ^= s >> np.uint64(33)
        return s * np.uint64(0xC2B2AE3D27D4EB4F)


def bands(size: int) -> int:
    """Bands of one row that miss a block of ``size`` shingles sharing one with a window by at most MISS."""
    jaccard = 1 / (IN_WINDOW + size - 1)
    return math.ceil(math.log(MISS) / math.log(1 - jaccard))


BANDS = [bands(s) for s in SIZES]


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**32, max(BANDS), dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, max(BANDS), dtype=np.uint32)


_A, _B = _multipliers()


class ItemIndex:
    """MinHash bands of the items' windows and the items' words for verification.

    Inside, an item is its place in the list, since an id may come with several texts.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        owners, rows = [], []
        self.by_shingle: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, h in enumerate(self.words):
            s = shingle_hashes(h)
            for at, v in enumerate(s.tolist()):
                self.by_shingle[v].append((item, at))
            if len(s) >= IN_WINDOW:
                rows.append(np.lib.stride_tricks.sliding_window_view(s.astype(np.uint32), IN_WINDOW))
                owners.append(np.full(len(s) - IN_WINDOW + 1, item, dtype=np.int64))
        self.owner = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        windows = np.concatenate(rows) if rows else np.zeros((0, IN_WINDOW), dtype=np.uint32)
        self.mins, self.order = [], []
        self.bitmap = np.zeros((len(_A), 1 << (_BITS - 3)), dtype=np.uint8)
        for p in range(len(_A)):
            m = (windows * _A[p] + _B[p]).min(axis=1) if len(windows) else np.zeros(0, dtype=np.uint32)
            order = np.argsort(m, kind="stable").astype(np.int32)
            self.mins.append(m[order])
            self.order.append(order)
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[m & np.uint32((1 << _BITS) - 1)] = True
            self.bitmap[p] = np.packbits(bits, bitorder="little")

    def candidates(self, shingles: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document's place, item's place) pairs whose block and window meet in a band."""
        starts, sizes, owner, flat, base = [], [], [], [], 0
        for place, s in enumerate(shingles):
            n = len(s)
            if n:
                at = np.arange(0, max(n - (BLOCK - STEP), 1), STEP)
                starts.append(base + at)
                sizes.append(np.minimum(n - at, BLOCK))
                owner.append(np.full(len(at), place))
                flat.append(s.astype(np.uint32))
                base += n
        found: set[tuple[int, int]] = set()
        if not flat or not len(self.owner):
            return found
        x, start, size, own = np.concatenate(flat), np.concatenate(starts), np.concatenate(sizes), np.concatenate(owner)
        low = 0
        for upper, n_bands in zip(SIZES, BANDS, strict=True):
            at = np.flatnonzero((size > low) & (size <= upper))
            low = upper
            if not len(at):
                continue
            # one row per place in a block, so that minima run along memory; short blocks repeat their last shingle
            x_at = x[np.minimum(start[at] + np.arange(upper)[:, None], start[at] + size[at] - 1)]
            hashed = np.empty_like(x_at)
            for p in range(n_bands):
                np.multiply(x_at, _A[p], out=hashed)
                hashed += _B[p]
                m = hashed.min(axis=0)
                slot = m & np.uint32((1 << _BITS) - 1)
                hit = np.flatnonzero((self.bitmap[p][slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8)) & 1)
                if len(hit):
                    lo = np.searchsorted(self.mins[p], m[hit], "left")
                    hi = np.searchsorted(self.mins[p], m[hit], "right")
                    for b, i, j in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                        found.update((int(own[at[b]]), int(w)) for w in set(self.owner[self.order[p][i:j]].tolist()))
        return found

    def verify(self, item: int, h: np.ndarray, shingles: np.ndarray) -> bool:
        """Whether the document holds a run of the item; exact."""
        its = self.words[item]
        diagonals = {i - at for i, v in enumerate(shingles.tolist()) for own, at in self.by_shingle.get(v, ()) if own == item}
        return any(holds_run(its, h, d) for d in diagonals)


def holds_run(item: np.ndarray, doc: np.ndarray, diagonal: int) -> bool:
    """A run of 12 or more item words at ``doc[i + diagonal]``, at most one in eight replaced.

    A run begins and ends with words that are kept; a strange word at its edge isn't part of it.
    """
    first, last = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if last - first < WINDOW:
        return False
    kept = np.flatnonzero(item[first:last] == doc[first + diagonal : last + diagonal])
    length = kept[None, :] - kept[:, None] + 1
    count = np.arange(len(kept))[None, :] - np.arange(len(kept))[:, None] + 1
    return bool(((length >= WINDOW) & ((length - count) * REPLACED_OF <= length)).any())


def _opening(text: str) -> str:
    return " ".join(words(_SENTENCE_END.split(text.strip(), maxsplit=1)[0]))


def without_instruction(items: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """The items' words without an opening sentence that ``SHARED_BY`` of them have."""
    distinct = {t for _, t in items}
    shared = {o for o, n in Counter(_opening(t) for t in distinct).items() if n >= SHARED_BY and o}
    out = []
    for item, text in items:
        w, o = words(text), _opening(text)
        out.append((item, w[len(o.split(" ")) :] if o in shared and len(o.split(" ")) < len(w) else w))
    return out


def _search(documents: DataFrame, index: ItemIndex) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: ItemIndex = held.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                ids, hashes = part["doc_id"].tolist(), [word_hashes(t) for t in part["text"]]
                shingles = [shingle_hashes(h) for h in hashes]
                hits = [(ids[d], ix.ids[i]) for d, i in ix.candidates(shingles) if ix.verify(i, hashes[d], shingles[d])]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id"])

    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return spread(texts).mapInPandas(scan, "doc_id bigint, item_id bigint")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents that hold a passage of a test item."""
    held = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    rows = [(r["item_id"], r["text"]) for r in held.toLocalIterator()]
    blocks: list[list[tuple[int, np.ndarray]]] = [[]]
    size = 0
    for item, w in without_instruction(rows):
        if len(w) < WINDOW:
            continue
        if size + len(w) > MOST_WINDOWS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((item, np.array([_word_hash(x) for x in w], dtype=np.uint64)))
        size += len(w)
    return union_all([_search(documents, ItemIndex(b)) for b in blocks]).distinct()
