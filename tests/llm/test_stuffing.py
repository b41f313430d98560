"""Problem 9: writing, salad, repetition and link lists in a small corpus."""

from __future__ import annotations

import random

from evigraph.llm import stuffing as st

NOUNS = "graph mapper viewport ledger queue span trigger baseline column session".split()


def writing(r):
    n = lambda: r.choice(NOUNS)
    return " ".join(r.choice([f"The {n()} must not hide the {n()} of the {n()}.", f"When the {n()} is late, we report it to the {n()} at once.", f"We have read the {n()} in step {r.randint(1, 9)} and it was the old {n()}."]) for _ in range(8))


def corpus(r):
    good = {i: writing(r) for i in range(60)}
    good[100] = "## 1.2.3\n" + "\n".join(f"- Fixed: We have read the {r.choice(NOUNS)} in step 2 and it was the old {r.choice(NOUNS)}. (see https://a.example/{i})" for i in range(8))
    good[101] = writing(r) + "\n```sql\ncreate table a (b int);\nselect b, c, d from e;\n```\n| a | b |\n| --- | --- |\n| x | y |"
    bad = {
        200: " ".join(r.choice(NOUNS) for _ in range(120)), 201: ", ".join(["best span analyzer"] * 40), 202: "\n".join(f"- https://x.example/{i}" for i in range(30)),
        203: "\n".join(f"[{r.choice(NOUNS)} {r.choice(NOUNS)}](https://x.example/{i})" for i in range(30)), 204: " ".join(f"#{r.choice(NOUNS).title()}{r.choice(NOUNS).title()}" for _ in range(60)),
        205: writing(r)[:120] + ".\n\n" + "buy cheap ledger now " * 60, 206: "<ul>" + "".join(f"<li><a href=\"https://x.example/{i}\">{r.choice(NOUNS)} tool</a></li>" for i in range(30)) + "</ul>",
        207: "\n".join(f"| <https://x.example/{i}> | [{r.choice(NOUNS)}](http://y.example/{i}) |" for i in range(20)),
    }
    return good, bad


def flagged(spark, docs):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, pair long")
    return {r["doc_id"] for r in st.stuffed_pages(df).collect()}


def test_kinds_of_stuffing(spark):
    good, bad = corpus(random.Random(4))
    assert flagged(spark, {**good, **bad}.items()) == set(bad)


def test_odd_rows(spark):
    good, _ = corpus(random.Random(5))
    odd = [(300, None), (301, ""), (302, " \n"), (303, "x"), (None, "buy now " * 200), (304, "best span analyzer " * 30000)]
    assert flagged(spark, [*good.items(), *odd]) == {304}
    assert flagged(spark, []) == set()


def test_counts_against_brute_force(spark):
    docs = [(1, "a b a b c. a b"), (2, "a b"), (3, "c a b")]
    got = {(r["a"], r["b"]): (r["s"], r["support"]) for r in st.pair_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sign = lambda w: st._word_hash(w) - (1 << 64) if st._word_hash(w) >= 1 << 63 else st._word_hash(w)
    assert got[sign("a"), sign("b")] == (4, 3) and got[sign("b"), sign("a")] == (1, 1) and got[sign("c"), sign("a")] == (1, 1)


def tag_list(r):
    return "Tags: " + "; ".join(f"{r.choice(['REF', 'SKU', 'ART'])}-{r.randint(100, 9999)} {r.choice(['XL', 'XS', 'lite', 'pro', 'blue', 'red'])} thing{r.randint(1, 60)}" for _ in range(25))


def salad(r, spam):
    return " ".join(r.choice(spam) for _ in range(90))


def test_recall_holds_as_the_corpus_grows(spark):
    spam = [f"spam{i}" for i in range(40)]
    for times in (1, 10):
        r = random.Random(times)
        good = {i: writing(r) for i in range(100 * times)}
        bad = {10_000 + i: salad(r, spam) if i % 2 else tag_list(r) for i in range(12 * times)}
        assert flagged(spark, {**good, **bad}.items()) == set(bad)
