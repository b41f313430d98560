"""Problem 8 against brute force over all alignments."""

from __future__ import annotations

import random

import numpy as np
import pytest

from evigraph.llm import leakage as lk

ITEM = "If thirty eight locators released generic spans which toggle trigger dropped the glacier beyond twenty six baselines and why so late"
WORDS = ITEM.lower().split()


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    return {tuple(r) for r in lk.leaks(d, e).collect()}


def with_run(n, replaced=(), start=2):
    run = WORDS[start : start + n]
    for k in replaced:
        run[k] = "zebra"
    return "Some opening words here. " + " ".join(run) + ". And then more text follows on."


def test_length_and_replacements(spark):
    docs = {1: with_run(12), 2: with_run(11), 3: with_run(12, (5,)), 4: with_run(12, (4, 8)), 5: with_run(16, (5, 10), 0), 6: with_run(15, (5, 10), 0), 8: with_run(12, (11,))}
    assert found(spark, docs.items(), [(7, ITEM)]) == {(1, 7), (3, 7), (5, 7)}


def test_what_does_not_count(spark):
    w = WORDS[:14]
    docs = {
        1: " ".join(w).upper(), 2: "\n * ".join([" ".join(w[:5]), " ".join(w[5:9]), " ".join(w[9:])]), 3: " ".join(f"<b>{x}</b>" if i % 3 else f"`{x}`" for i, x in enumerate(w)),
        4: "​ ".join(x[:2] + "­" + x[2:] for x in w), 5: " ".join(w).translate({ord(c): chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz"}), 6: "&nbsp;".join(w),
        7: "\\u0020".join(w), 8: "%20".join(w), 9: " / ".join(w), 10: "; ".join(w[:7]) + " -- " + ", ".join(w[7:]),
    }
    assert found(spark, docs.items(), [(7, ITEM)]) == {(i, 7) for i in docs}


def test_shared_instruction_is_no_part_of_an_item(spark):
    lead = "Answer the question using only the graph and nothing else at all. "
    items = [(i, lead + " ".join(random.Random(i).sample(WORDS, 14))) for i in range(4)]
    assert found(spark, [(1, lead * 2), (2, items[0][1])], items) == {(2, 0)}


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " "), (None, ITEM), (4, ITEM), (4, ITEM), (5, "filler words " * 40000 + ITEM)]
    assert found(spark, docs, [(7, ITEM), (7, ITEM), (8, "too short"), (9, None), (None, ITEM)]) == {(4, 7), (5, 7)}
    assert found(spark, [], [(7, ITEM)]) == set() and found(spark, docs, []) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_search_misses_nothing(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(12)]
    docs = []
    for i in range(150):
        text = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        source = r.choice(items)[1].split()
        a, n = r.randint(0, 14), r.randint(8, 16)
        run = source[a : a + n]
        for _ in range(r.randint(0, 2)):
            run[r.randrange(len(run))] = "other"
        at = r.randint(0, len(text))
        docs.append((i, " ".join(text[:at] + run + text[at:])))
    want = set()
    for d, text in docs:
        h = lk.word_hashes(text)
        for i, it in items:
            ih = np.array([lk._word_hash(x) for x in lk.words(it)], dtype=np.uint64)
            if any(lk.holds_run(ih, h, k) for k in range(-len(ih), len(h))):
                want.add((d, i))
    assert found(spark, docs, items) == want
    assert want


def test_more_items_make_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(lk, "MOST_WINDOWS", 30)
    items = [(i, f"{ITEM} {i}") for i in range(3)]
    assert found(spark, [(1, ITEM)], items) == {(1, 0), (1, 1), (1, 2)}


def test_an_item_with_two_texts(spark):
    other = " ".join(reversed(WORDS))
    assert found(spark, [(1, ITEM), (2, other)], [(7, ITEM), (7, other)]) == {(1, 7), (2, 7)}
