"""Personal information inside free text (problem 4).

Every text is cut into overlapping windows; the character tagger (bidirectional LSTM with
CRF transitions, ``tagger``) decodes each, and the windows' labels are reconciled globally:
in an overlap each character takes the label of the window in which it lies farther from the
cut. Runs of one label are snapped to whole words and checked against the exact form of their
kind, which trims labels and titles, completes an item that the tagger cut short and drops
what can't be an item. The text outside items stays as it is; items become ``[KIND]``.

Plan: texts of three tables become (row, field, text) rows in the JVM, one Arrow pass tags
them in length-sorted batches, and the found rows are made distinct. Nothing but found items
is shuffled, and no row depends on another, so that a hot source costs nothing.

Defined results: null, empty and blank texts have no items; JSON details are searched in
their decoded strings, other details as they are; a repeated item of one row counts once;
texts of any length are searched whole; rows with a null key are left out.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import tagger
from evigraph.llm.tagger import LABELS
from evigraph.session import spread, union_all

WINDOW, OVERLAP = 240, 72

# Titles and forms of address before a name, which aren't part of it.
TITLES = frozenset("mr mrs ms mx miss dr prof mme mlle m madame monsieur herr herrn frau sir sra sr señor señora".split())
# Small words inside a name.
PARTICLES = frozenset("de del der den da di du la le van von zu zum y e bin al ibn af".split())
_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?,?$")
_LAST_WORD = re.compile(r"([^\W\d_]+)\.?[ \u00a0]+$")
_PLAIN = re.compile(r"[A-Za-z0-9À-ÿ][A-Za-z0-9_À-ÿ.%+\-']*[@＠][A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_AT = r"(?:\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+)"
_DOT = r"(?:\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+|\.)"
_HIDDEN_AT = re.compile(rf"[A-Za-z0-9][\w.+\-]*{_AT}[A-Za-z0-9][A-Za-z0-9\-]*(?:{_DOT}[A-Za-z0-9\-]+)+", re.IGNORECASE)
_EN_ADDRESS = re.compile(
    r"(?<![\w#-])\d{1,5}[A-Za-z]?[ \u00a0](?:[A-ZÀ-ÖØ-ÞČŠŽĆŁŚŹŻĐŐŰŇŘŤĎ][\w'’.]*[ \u00a0]){1,4}?(?:Street|St|Avenue|Ave|Lane|Ln|Road|Rd|Court|Ct|Boulevard|Blvd|Drive|Dr|Way|Place|Pl|Square|Terrace)\b\.?"
    r"(?:,?[ \u00a0](?:Apt|Unit|Suite|Flat|Apartment)\.?[ \u00a0]?\w{1,5}|,?[ \u00a0]#[ \u00a0]?\w{1,5})?(?:,[ \u00a0][A-ZÀ-ÖØ-ÞČŠŽĆŁŚŹŻĐŐŰŇŘŤĎ][\w'’\-]+(?:[ \u00a0][A-ZÀ-ÖØ-ÞČŠŽĆŁŚŹŻĐŐŰŇŘŤĎ][\w'’\-]+){0,2}(?![ \u00a0]?[\d@]))?(?:,?[ \u00a0][A-Z]{2}[ \u00a0]\d{4,6})?"
)
_DE_ADDRESS = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-ÞČŠŽĆŁŚŹŻĐŐŰŇŘŤĎ][\w\-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer)[ \u00a0]\d{1,4}[ \u00a0]?[a-z]?\b(?:,[ \u00a0]\d{5}[ \u00a0][A-ZÀ-ÖØ-ÞČŠŽĆŁŚŹŻĐŐŰŇŘŤĎ][\w\-]+(?:[ \u00a0][A-ZÀ-ÖØ-ÞČŠŽĆŁŚŹŻĐŐŰŇŘŤĎ][\w\-]+)?)?")
_FR_ADDRESS = re.compile(r"(?<!\w)\d{1,4}(?:[ \u00a0]?(?:bis|ter))?,?[ \u00a0](?:rue|chemin|avenue|allée|boulevard|place|impasse|quai|route)[ \u00a0](?:(?:de la|de l['’]|du|des|de|d['’])[ \u00a0]?)?[^\W\d_][\w'’\-]*(?:[ \u00a0][^\W\d_][\w'’\-]*){0,3}(?:,[ \u00a0]\d{5}[ \u00a0][^\W\d_][\w'’\-]+(?:[ \u00a0][A-ZÀ-ÖØ-ÞČŠŽĆŁŚŹŻĐŐŰŇŘŤĎ][\w'’\-]+)?)?")
_JA_ADDRESS = re.compile(r"[一-鿿]{2,3}[都道府県][一-鿿ぁ-ヿ]{1,8}?[市区郡][一-鿿ぁ-ヿ]{1,10}?[0-9０-９]{1,4}(?:[\-－ー丁目番地の号]{1,2}[0-9０-９]{1,4}){0,3}(?:号)?")
_PHONE = re.compile(r"(?<![A-Za-z0-9.０-９])(?:[+＋][0-9０-９]|[(（][0-9０-９]|[0-9０-９])(?:[\s().\-/（）－]{0,2}[0-9０-９]){6,14}(?![A-Za-z0-9０-９])")
_ID = re.compile(
    r"(?<![A-Za-z0-9\-])(?:[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]|\d{3}[\- ]\d{2}[\- ]\d{4}|\d{4}[\- ]\d{4}[\- ]\d{4}|\d\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}|\d{2}\s\d{3}\s\d{3}\s\d{3}"
    r"|[A-Z]{2}\d{3}-\d{4}-\d{4}|[A-Z]\d{4}-\d{5}-\d{5}|\d{2}[A-Z]{2}\d{5}|[A-Z]{1,2}\d{7,9}|\d{8}[A-Z]|\d{11,12})(?![A-Za-z0-9\-])"
)
_FORMS = {"EMAIL": (_PLAIN, _HIDDEN_AT), "PHONE": (_PHONE,), "ID_NUMBER": (_ID,), "ADDRESS": (_EN_ADDRESS, _DE_ADDRESS, _FR_ADDRESS, _JA_ADDRESS)}
_KANJI = re.compile(r"[一-鿿々]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿々]")


def windows_of(text: str) -> list[tuple[int, int]]:
    if len(text) <= WINDOW:
        return [(0, len(text))]
    return [(lo, min(lo + WINDOW, len(text))) for lo in range(0, len(text) - OVERLAP, WINDOW - OVERLAP)]


def reconcile(length: int, windows: list[tuple[int, int]], labels: list[np.ndarray]) -> np.ndarray:
    """One label per character; overlaps are cut in their middle."""
    if len(windows) == 1:
        return labels[0]
    out = np.zeros(length, dtype=np.int8)
    for k, ((lo, hi), lab) in enumerate(zip(windows, labels, strict=True)):
        a = lo if k == 0 else (lo + windows[k - 1][1]) // 2
        b = hi if k + 1 == len(windows) else (hi + windows[k + 1][0]) // 2
        out[a:b] = lab[a - lo : b - lo]
    return out


def runs(labels: np.ndarray) -> list[tuple[int, int, str]]:
    at = np.flatnonzero(np.diff(np.concatenate([[0], labels, [0]])))
    return [(int(a), int(b), LABELS[labels[a]]) for a, b in zip(at, at[1:], strict=False) if labels[a]]


def _snap(text: str, labels: np.ndarray, a: int, b: int, code: int) -> tuple[int, int]:
    """The run grown or cut to words of which at least half is labelled; East Asian text as it is."""
    if _CJK.search(text[a:b]):
        # a word of Chinese characters isn't cut before its last one on either side
        if LABELS[code] == "NAME":
            kanji = lambda i: 0 <= i < len(text) and bool(_KANJI.match(text[i]))
            a -= kanji(a) and kanji(a - 1) and not kanji(a - 2)
            b += kanji(b - 1) and kanji(b) and not kanji(b + 1)
        return a, b
    lo, hi = a, b
    while lo > 0 and not text[lo - 1].isspace() and not _CJK.match(text[lo - 1]):
        lo -= 1
    while hi < len(text) and not text[hi].isspace() and not _CJK.match(text[hi]):
        hi += 1
    spans = [(lo + m.start(), lo + m.end()) for m in re.finditer(r"[^\s/=<>（）()|;:\"]+|\S", text[lo:hi])]
    kept = [(x, y) for x, y in spans if (labels[x:y] == code).sum() * 2 >= y - x]
    return (kept[0][0], kept[-1][1]) if kept else (a, b)


def _capitals(text: str, a: int, b: int) -> tuple[int, int]:
    """Of a run with words in capitals and others, the longest stretch of the former; particles may stand inside."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text[a:b])]
    if len({w[0].isupper() for _, _, w in words}) < 2:
        return a, b
    best, from_ = (0, 0), 0
    for k in range(len(words) + 1):
        if k == len(words) or not (words[k][2][0].isupper() or (k > from_ and words[k][2].lower() in PARTICLES)):
            to = k
            while to > from_ and not words[to - 1][2][0].isupper():
                to -= 1
            best = max(best, (to - from_, -from_))
            from_ = k + 1
    n, lo = best[0], -best[1]
    return (a + words[lo][0], a + words[lo + n - 1][1]) if n else (a, b)


def _name(text: str, a: int, b: int) -> tuple[int, int] | None:
    while a < b and (text[a].isspace() or text[a] in "\"'“”.,;:<>()[]-–—=：、「」"):
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in "\"'“”,;:<>()[]-–—=：、「」。"):
        b -= 1
    if a >= b:
        return None
    if _CJK.search(text[a:b]):
        for tail in ("さん", "様", "氏", "殿", "先生"):
            if text[a:b].endswith(tail) and b - a > len(tail):
                b -= len(tail)
        return (a, b) if b - a >= 2 and not re.search(r"[0-9０-９ぁ-ん]", text[a:b]) else None
    # "M." may be an initial as well, so that it isn't cut off
    while (m := re.match(r"([^\W\d_]+)\.?\s+", text[a:b])) and m[1].lower() in TITLES and m[1] != "M":
        a += m.end()
    if text[a:b].endswith(("'s", "’s")):
        b -= 2
    a, b = _capitals(text, a, b)
    words = text[a:b].split()
    if text[b - 1] == "." and not (len(words) > 1 and len(words[-1]) == 2):
        b -= 1
        words = text[a:b].split()
    if not words or not all(_NAME_WORD.match(w) for w in words) or len(text[a:b]) < 3:
        return None
    # a family name alone is told from any other word by its title
    if len(words) == 1 and not ((before := _LAST_WORD.search(text[:a])) and before[1].lower() in TITLES):
        return None
    return a, b


class Forms:
    """All places in a text that have the exact form of a kind, searched once per kind and line."""

    def __init__(self, text: str) -> None:
        self.text, self.known = text, {}

    def near(self, a: int, b: int, kind: str) -> list[tuple[int, int]]:
        """Those that overlap the run, in lines it touches; the first form to claim a place keeps it."""
        lo, hi = self.text.rfind("\n", 0, a) + 1, self.text.find("\n", b)
        hi = len(self.text) if hi < 0 else hi
        if (lo, hi, kind) not in self.known:
            self.known[lo, hi, kind] = [[m.span() for m in form.finditer(self.text, lo, hi)] for form in _FORMS[kind]]
        found: list[tuple[int, int]] = []
        for spans in self.known[lo, hi, kind]:
            at = bisect.bisect_right(spans, (a, len(self.text))) - 1
            for x, y in spans[max(0, at) :]:
                if x >= b:
                    break
                if y > a and not any(x < q and y > p for p, q in found):
                    found.append((x, y))
        return found


def check(forms: Forms, labels: np.ndarray, a: int, b: int, kind: str) -> list[tuple[int, int]]:
    """The exact items behind a labelled run."""
    text = forms.text
    if kind == "NAME":
        one = _name(text, *_snap(text, labels, a, b, LABELS.index(kind)))
        return [one] if one else []
    found = [_trim(text, x, y, kind) for x, y in forms.near(a, b, kind)]
    return [(x, y) for x, y in found if 2 * (min(y, b) - max(x, a)) >= min(y - x, b - a) or kind in ("EMAIL", "ADDRESS")]


def _trim(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    while b > a and text[b - 1] in " .,;:-":
        b -= 1
    if kind == "PHONE" and text[a] in "(（" and not re.search(r"[)）]", text[a:b]):
        a += 1
    return a, b


def find_items(texts: list[str], contexts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the items of every text; a context such as a field name is read but not searched."""
    model = tagger.load()
    heads = [f"{c}: " if c else "" for c in contexts]
    unique: dict[str, int] = {}
    for h, t in zip(heads, texts, strict=True):
        unique.setdefault(h + t, len(unique))
    full = list(unique)
    cuts = [windows_of(t) for t in full]
    encoded = tagger.codes_of(full)
    labels = iter(model.tag([c[lo:hi] for c, w in zip(encoded, cuts, strict=True) for lo, hi in w]))
    merged = [reconcile(len(t), w, [next(labels) for _ in w]) for t, w in zip(full, cuts, strict=True)]
    out = []
    for h, t in zip(heads, texts, strict=True):
        lab = merged[unique[h + t]][len(h) :]
        items: list[tuple[int, int, str]] = []
        if not lab.any():
            out.append(items)
            continue
        forms = Forms(t)
        for a, b, kind in runs(lab):
            items.extend((x, y, kind) for x, y in check(forms, lab, a, b, kind) if not any(x < q and y > p for p, q, _ in items))
        out.append(sorted(items))
    return out


def _slots(text: str) -> tuple[list, list[tuple[dict | list, object, str]], bool]:
    """([value], (container, key, field) of every string in it, whether it is JSON) of a text."""
    root: list = [text]
    if text[:1] in "{[\"" or text.lstrip()[:1] in ("{", "[", '"'):
        try:
            root = [json.loads(text)]
        except (ValueError, RecursionError):
            return root, [(root, 0, "")], False
        out: list[tuple[dict | list, object, str]] = []
        todo: list[tuple[dict | list, object, str]] = [(root, 0, "")]
        while todo:
            box, key, field = todo.pop()
            v = box[key]
            if isinstance(v, dict):
                todo.extend((v, k, k) for k in v)
            elif isinstance(v, list):
                todo.extend((v, i, field) for i in range(len(v)))
            elif isinstance(v, str):
                out.append((box, key, field))
        return root, out, True
    return root, [(root, 0, "")], False


def leaves(text: str) -> list[tuple[str, str]]:
    """(field, string) of JSON text, or the text itself."""
    return [(field, box[key]) for box, key, field in _slots(text)[1]]


def redact(text: str, items: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in items:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def text_rows(tasks: DataFrame, audit_logs: DataFrame, traces: DataFrame) -> DataFrame:
    """(src_table, row_key, field, text) of all texts; field is the attribute's name."""
    spans = traces.select("trace_id", F.explode("spans").alias("s")).where(F.col("trace_id").isNotNull() & F.col("s.span_id").isNotNull())
    events = spans.select("trace_id", F.col("s.span_id").alias("span_id"), F.posexplode("s.events").alias("at", "event"))
    attributes = events.select("trace_id", "span_id", "at", F.explode("event.attributes").alias("field", "text"))
    frames = [
        tasks.select(F.lit("tasks").alias("src_table"), F.col("id").cast("string").alias("row_key"), F.lit("").alias("field"), F.col("description").alias("text")),
        audit_logs.select(F.lit("audit_logs").alias("src_table"), F.col("id").cast("string").alias("row_key"), F.lit("").alias("field"), F.col("details").alias("text")),
        attributes.select(F.lit("traces").alias("src_table"), F.concat_ws(":", "trace_id", "span_id", (F.col("at") + 1).cast("string")).alias("row_key"), "field", "text"),
    ]
    return union_all(frames).where(F.col("row_key").isNotNull() & F.col("text").rlike(r"\S"))


def _tagged(rows: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [(src, key, field if src == "traces" and not f else f, t) for src, key, field, text in batch.itertuples(index=False) for f, t in leaves(text)]
            items = find_items([p[3] for p in parts], [p[2] for p in parts])
            found = [(src, key, kind, t[a:b]) for (src, key, _, t), own in zip(parts, items, strict=True) for a, b, kind in own]
            yield pd.DataFrame(found, columns=["src_table", "row_key", "pii_kind", "pii_text"])

    return spread(rows.select("src_table", "row_key", "field", "text")).mapInPandas(scan, "src_table string, row_key string, pii_kind string, pii_text string")


def found_items(tasks: DataFrame, audit_logs: DataFrame, traces: DataFrame) -> DataFrame:
    return _tagged(text_rows(tasks, audit_logs, traces)).distinct()


def redacted(rows: DataFrame) -> DataFrame:
    """(src_table, row_key, field, redacted) with typed placeholders; JSON keeps its structure."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaf = [(i, n, f or batch["field"].iat[i], t) for i, text in enumerate(batch["text"]) for n, (f, t) in enumerate(leaves(text))]
            items = find_items([x[3] for x in leaf], [x[2] for x in leaf])
            new: list[dict[int, str]] = [{} for _ in range(len(batch))]
            for (i, n, _, t), own in zip(leaf, items, strict=True):
                if own:
                    new[i][n] = redact(t, own)
            batch["redacted"] = [_rewrite(text, swap) for text, swap in zip(batch["text"], new, strict=True)]
            yield batch[["src_table", "row_key", "field", "redacted"]]

    return spread(rows.select("src_table", "row_key", "field", "text")).mapInPandas(scan, "src_table string, row_key string, field string, redacted string")


def _rewrite(text: str, swap: dict[int, str]) -> str:
    """The text with new strings in some places; JSON without any stays as it is spelled."""
    if not swap:
        return text
    root, slots, parsed = _slots(text)
    for n, new in swap.items():
        box, key, _ = slots[n]
        box[key] = new
    return json.dumps(root[0], ensure_ascii=False) if parsed else root[0]
