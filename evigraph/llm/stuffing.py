"""Keyword-stuffed and link-list pages by mean pointwise mutual information (problem 9).

A page is cut into segments (sentences inside lines). Corpus counts of neighbouring words give
every pair its pointwise mutual information, and a page is scored by the mean over its pairs:
writing is full of pairs that occur together more often than chance, word salad, keyword and
tag lists aren't. In the mean

* a pair counts between 0 and ``MOST_BITS``, so that rare words, whose information grows with
  the corpus, don't outweigh all others;
* a pair counts 0 at first if neither word predicts the other with ``LEAST_STRENGTH``: words that stand
  on spam pages only have much information about each other, though they are put together at random;
* a collocation repeated excessively on the page or in one segment counts 0, and so do the pairs of
  a segment that repeats one form of words and numbers (codes and sizes of products);
* each link of a line of bare links counts as ``LINK_PAIRS`` pairs of 0.

A page is flagged if its mean lies below a share of the corpus' own mean; short pages are drawn
towards that mean by ``PRIOR_PAIRS``. Numbers count as one word, and runs of Chinese characters
as words of two. Code, and tables without links, are not judged.

Counts are of distinct texts: copies of a page don't speak for it, and neither does the page
itself, whose own count is left out. Pages are judged twice: what lies below ``SUSPECT_SHARE`` of
the mean at first is suspect, and suspect pages are judged again by the counts of all others.

Plan: texts are made distinct by a partial aggregate, parsed once, and written as chunks of some
``CHUNK_WORDS`` hashed words; everything later reads the chunks. Pair counts are summed inside a
chunk before their shuffle. To score, the distinct pairs of a chunk meet the pair table in one
join and come back to their chunk in a cogrouped pass, which holds one chunk at a time. Suspect
pages are written as chunks of their own and take the same steps. A hot word or pair is one row a
chunk on the probe side; the flagged texts meet the documents by a size-checked lookup.

Defined results: null, empty and blank texts, and texts without neighbouring words or bare links,
are never flagged; a null ``doc_id`` gives no row; a repeated ``doc_id`` is flagged if one of its
texts is; an empty table gives an empty result; very long texts are a chunk of their own.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.textnorm import URL, fold
from evigraph.session import cut, lookup_join

#: Bits that a pair counts at most.
MOST_BITS = 4.0
#: Probability with which one word of a pair must predict the other while spam is among the counts.
LEAST_STRENGTH = 0.08
#: Share of the corpus' mean below which a page is suspect, and is flagged.
SUSPECT_SHARE, FLAGGED_SHARE = 0.75, 0.68
#: Pairs of the corpus' mean that are added to every page.
PRIOR_PAIRS = 16.0
#: Pairs that one bare link counts for, and words a link up to which a line with links is a list entry.
LINK_PAIRS, LINK_WORDS = 6, 7
#: A collocation is excessive from this many occurrences, if it makes up this share of the page's pairs.
EXCESS_COUNT, EXCESS_SHARE = 4, 0.10
#: Occurrences in one segment from which a collocation is repeated.
SEGMENT_REPEATS = 3
#: Items of a segment from which one form is repeated, and the share of them that has it.
FORM_ITEMS, FORM_SHARE = 8, 0.8
#: Words from which a chunk is closed; bounds memory, not what is read.
CHUNK_WORDS = 50_000
_LINK = "\ue000"

_BLOCK = re.compile(r"</?(?:br|p|li|ul|ol|div|tr|td|th|h[1-6]|table)\b[^<>]*>", re.IGNORECASE)
_ANCHOR = re.compile(r"<a\b[^<>]*>", re.IGNORECASE)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_WORD = re.compile(r"[一-鿿々]{1,2}|[ぁ-ゖ]+|[ァ-ヺー]+|[^\W_]+(?:['’][^\W_]+)?")
_ITEM = re.compile(r"[;,|｜*•、]")
_CODE = re.compile(r"/\*|\*/|[{};]\s*$|^\s*(?:at [\w.$]+\(|@\w+|\$ |>>> )|[=!]=|[\w)]\(\)|^\s*\"[^\"]*\"\s*[:,]")


@lru_cache(maxsize=400_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest("0" if word.isdigit() else word)


def _repeats_form(text: str) -> bool:
    """Whether most items of a list have one form of at least three words, some of them numbers, but not all."""
    items = _ITEM.split(text) if any(c.isdigit() for c in text) else ()
    if len(items) < FORM_ITEMS:
        return False
    forms = Counter(tuple(w.isdigit() for w in _WORD.findall(i)) for i in items)
    return max((n for f, n in forms.items() if len(f) > 2 and any(f) and not all(f)), default=0) >= FORM_SHARE * len(items)


def segments(text: str) -> list[tuple[int, bool, list[str]]]:
    """(bare links, whether pairs count 0, words) of the segments that can be judged."""
    text = fold(text)
    text = _ANCHOR.sub(f" {_LINK} ", _BLOCK.sub("\n", text))
    text = URL.sub(f" {_LINK} ", text)
    out, fenced = [], False
    for line in text.splitlines():
        s = line.strip()
        if s.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        links = s.count(_LINK)
        if not s or fenced or (s.startswith("|") and not links) or _CODE.search(s):
            continue
        pieces = _SENTENCE.split(_TAG.sub(" ", s))
        parts = [[w.lower() for w in _WORD.findall(p)] for p in pieces]
        if links and sum(map(len, parts)) <= LINK_WORDS * links:
            # references beside a sentence stand with it; a line of links alone is a list entry
            out.append((links, True, [w for p in parts for w in p]))
        else:
            out.extend((0, _repeats_form(t), p) for t, p in zip(pieces, parts, strict=True) if len(p) > 1)
    return out


_CHUNKS = "chunk string, high array<bigint>, low array<bigint>, parts array<int>, links array<int>, idle array<boolean>, lengths array<int>, words array<bigint>"
_COUNTS = "a bigint, b bigint, s bigint, support bigint"
_SCORES = "chunk string, high bigint, low bigint, bits double, pairs double"


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


class Chunk:
    """Some pages as flat arrays, with one entry per page and pair."""

    def __init__(self, row: pd.Series) -> None:
        self.name, self.high, self.low = row["chunk"], np.asarray(row["high"], np.int64), np.asarray(row["low"], np.int64)
        self.parts, self.links = np.asarray(row["parts"], np.int64), np.asarray(row["links"], np.int64)
        self.lengths, self.words = np.asarray(row["lengths"], np.int64), np.asarray(row["words"], np.int64)
        self.page = np.repeat(np.arange(len(self.parts)), self.parts)
        seg = np.repeat(np.arange(len(self.lengths)), self.lengths)
        inside = np.flatnonzero(seg[:-1] == seg[1:])
        a, b, seg = self.words[inside], self.words[inside + 1], seg[inside]
        self.idle = np.asarray(row["idle"], bool)
        linked = np.bincount(self.page, weights=self.links, minlength=len(self.parts))
        page = self.page[seg]
        self.pairs = np.bincount(page, minlength=len(self.parts)) + LINK_PAIRS * linked
        # occurrences per segment, then per page
        order = np.lexsort((b, a, seg))
        a, b, seg, page = a[order], b[order], seg[order], page[order]
        at = _starts(seg, a, b)
        n = np.diff(np.concatenate([at, [len(seg)]]))
        a, b, page, idle = a[at], b[at], page[at], (n >= SEGMENT_REPEATS) | self.idle[seg[at]]
        order = np.lexsort((b, a, page))
        a, b, page, n, idle = a[order], b[order], page[order], n[order], idle[order]
        at = _starts(page, a, b)
        if len(at):
            whole, counting = np.add.reduceat(n, at), np.add.reduceat(np.where(idle, 0, n), at)
        else:
            whole = counting = np.zeros(0, np.int64)
        self.spread = np.diff(np.concatenate([at, [len(n)]]))
        self.a, self.b, self.of = a[at], b[at], page[at]
        excess = (whole >= EXCESS_COUNT) & (whole > EXCESS_SHARE * np.bincount(page, weights=n, minlength=len(self.parts))[self.of])
        #: occurrences that count in the page's mean
        self.counting = np.where(excess, 0, counting)

    def counts(self) -> pd.DataFrame:
        """Segments (``s``) and pages (``support``) per pair."""
        order = np.lexsort((self.b, self.a))
        a, b = self.a[order], self.b[order]
        at = _starts(a, b)
        s = np.add.reduceat(self.spread[order], at) if len(at) else np.zeros(0, np.int64)
        return pd.DataFrame({"a": a[at], "b": b[at], "s": s, "support": np.diff(np.concatenate([at, [len(a)]]))})

    def scores(self, known: pd.DataFrame) -> pd.DataFrame:
        """Summed bits and pairs of every page; ``known`` has the bits of some pairs."""
        bits = pd.DataFrame({"a": self.a, "b": self.b}).merge(known[["a", "b", "bits"]], how="left", on=["a", "b"])["bits"].fillna(0.0).to_numpy()
        total = np.bincount(self.of, weights=bits * self.counting, minlength=len(self.parts))
        return pd.DataFrame({"chunk": self.name, "high": self.high, "low": self.low, "bits": total, "pairs": self.pairs.astype(float)})

    def only(self, pages: set[tuple[int, int]]) -> dict[str, object]:
        kept = np.array([p in pages for p in zip(self.high.tolist(), self.low.tolist(), strict=True)], bool)
        of = kept[self.page]
        return {
            "chunk": self.name, "high": self.high[kept], "low": self.low[kept], "parts": self.parts[kept].astype(np.int32), "links": self.links[of].astype(np.int32), "idle": self.idle[of],
            "lengths": self.lengths[of].astype(np.int32), "words": self.words[np.repeat(of, self.lengths)],
        }


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("high"), F.xxhash64(F.lit("low"), text).alias("low")]


def chunks_of(documents: DataFrame) -> DataFrame:
    """Distinct texts parsed into chunks; a text is named by 128 bits of its digest."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {k: [] for k in ("high", "low", "parts", "links", "idle", "lengths", "words")}

        def close() -> pd.DataFrame:
            kinds = {"high": np.int64, "low": np.int64, "idle": bool, "words": np.uint64}
            row = {"chunk": uuid.uuid4().hex, **{k: np.array(v, kinds.get(k, np.int32)) for k, v in held.items()}}
            row["words"] = row["words"].view(np.int64)
            for v in held.values():
                v.clear()
            return pd.DataFrame([row])

        for batch in batches:
            for high, low, text in zip(batch["high"].tolist(), batch["low"].tolist(), batch["text"], strict=True):
                found = segments(text)
                held["high"].append(high)
                held["low"].append(low)
                held["parts"].append(len(found))
                for links, idle, words in found:
                    held["links"].append(links)
                    held["idle"].append(idle)
                    held["lengths"].append(len(words))
                    held["words"].extend(map(_word_hash, words))
                if len(held["words"]) >= CHUNK_WORDS:
                    yield close()
        if held["high"]:
            yield close()

    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    distinct = texts.select(*_keys(F.col("text")), "text").groupBy("high", "low").agg(F.first("text").alias("text"))
    return distinct.mapInPandas(parse, _CHUNKS)


def _each(frames: Iterator[pd.DataFrame]) -> Iterator[Chunk]:
    return (Chunk(row) for frame in frames for _, row in frame.iterrows())


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(a, b, s, support): the segments and distinct texts in which word b follows word a."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _each(batches):
            yield chunk.counts()

    return chunks.mapInPandas(count, _COUNTS).groupBy("a", "b").agg(F.sum("s").alias("s"), F.sum("support").alias("support"))


def pair_counts(documents: DataFrame) -> DataFrame:
    return chunk_counts(chunks_of(documents))


def supports(chunks: DataFrame) -> DataFrame:
    """(a, b, n) with the distinct texts as the count."""
    return chunk_counts(chunks).select("a", "b", F.col("support").alias("n"))


def pair_bits(pairs: DataFrame, own: int, least: float) -> DataFrame:
    """(a, b, bits) of the pairs that tell something, ``own`` texts left out of every count; ``pairs`` is written."""
    total = pairs.agg(F.sum("n")).first()[0] or 0
    left = pairs.groupBy("a").agg(F.sum("n").alias("__a"))
    right = pairs.groupBy("b").agg(F.sum("n").alias("__b"))
    joined = lookup_join(lookup_join(pairs.where(F.col("n") > own), left, ["a"], "inner"), right, ["b"], "inner")
    others = F.col("n") - own
    information = F.log2(others * F.lit(float(total)) / (F.col("__a").cast("double") * F.col("__b")))
    strong = others >= least * F.least("__a", "__b")
    return joined.where(strong & (information > 0)).select("a", "b", F.least(information, F.lit(MOST_BITS)).alias("bits"))


def page_scores(chunks: DataFrame, bits: DataFrame) -> DataFrame:
    """(chunk, high, low, bits, pairs): summed information and number of pairs of every text."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _each(batches):
            yield chunk.counts().assign(chunk=chunk.name)[["chunk", "a", "b"]]

    def score(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([Chunk(row).scores(known) for _, row in rows.iterrows()]) if len(rows) else pd.DataFrame(columns=["chunk", "high", "low", "bits", "pairs"])

    known = chunks.mapInPandas(ask, "chunk string, a bigint, b bigint").join(bits, ["a", "b"]).groupBy("chunk")
    return chunks.groupBy("chunk").cogroup(known).applyInPandas(score, _SCORES)


def below(scores: DataFrame, base: float, share: float) -> DataFrame:
    """Texts whose mean, drawn towards ``base``, is less than ``share`` of it."""
    mean = (F.col("bits") + PRIOR_PAIRS * base) / (F.col("pairs") + PRIOR_PAIRS)
    return scores.where((F.col("pairs") > 0) & (mean < share * base))


def corpus_mean(scores: DataFrame) -> float:
    bits, pairs = scores.agg(F.sum("bits"), F.sum("pairs")).first()
    return bits / pairs if pairs else 0.0


def only(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks of the given texts alone."""

    def pick(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        names = set(zip(wanted["high"].tolist(), wanted["low"].tolist(), strict=True))
        found = [Chunk(row).only(names) for _, row in rows.iterrows()] if names else []
        return pd.DataFrame(found, columns=["chunk", "high", "low", "parts", "links", "idle", "lengths", "words"])

    return chunks.groupBy("chunk").cogroup(pages.select("chunk", "high", "low").groupBy("chunk")).applyInPandas(pick, _CHUNKS)


def without(pairs: DataFrame, less: DataFrame) -> DataFrame:
    """The pair table less the counts of another."""
    rest = F.col("n") - F.coalesce("__n", F.lit(0))
    return pairs.join(less.withColumnRenamed("n", "__n"), ["a", "b"], "left").select("a", "b", rest.alias("n")).where("n > 0")


def stuffed_texts(documents: DataFrame) -> DataFrame:
    """(high, low) of the distinct texts that are stuffed."""
    chunks = cut(chunks_of(documents))
    pairs = cut(supports(chunks))
    first = cut(page_scores(chunks, pair_bits(pairs, 1, LEAST_STRENGTH)))
    base = corpus_mean(first)
    suspect = below(first, base, SUSPECT_SHARE)
    again = cut(only(chunks, suspect))
    rest = cut(without(pairs, supports(again)))
    clean = corpus_mean(first.where((F.col("bits") + PRIOR_PAIRS * base) >= SUSPECT_SHARE * base * (F.col("pairs") + PRIOR_PAIRS)))
    return below(page_scores(again, pair_bits(rest, 0, 0.0)), clean, FLAGGED_SHARE).select("high", "low").distinct()


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """(doc_id) of the stuffed pages."""
    named = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", *_keys(F.col("text")))
    return lookup_join(named, cut(stuffed_texts(documents)), ["high", "low"], "left_semi").select("doc_id").distinct()
