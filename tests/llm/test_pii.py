"""Problem 4: held-out accuracy of the tagger, exact forms, redaction and reconciliation."""

from __future__ import annotations

import json

import numpy as np
import pytest

from evigraph.llm import pii, tagger, tagger_train
from evigraph.llm.tagger_data import Maker


def items(text, context=""):
    return {(text[a:b], k) for a, b, k in pii.find_items([text], [context])[0]}


CASES = [
    ("Please call Rosa O'Bramley on 01632 960936 before noon.", {("Rosa O'Bramley", "NAME"), ("01632 960936", "PHONE")}),
    ("Spoke with Ms Umberlake about the conflict; she will confirm.", {("Umberlake", "NAME")}),
    ("Requested by daichi yarrowin.", {("daichi yarrowin", "NAME")}),
    ("cc Noor Jurkevast <viktor.harrowbee@inbox.tarn.example>", {("Noor Jurkevast", "NAME"), ("viktor.harrowbee@inbox.tarn.example", "EMAIL")}),
    ("Mail bounced for ingridwexelby (at) kontor (dot) example; retry.", {("ingridwexelby (at) kontor (dot) example", "EMAIL")}),
    ("Rückfragen an olga at corp-mail dot invalid.", {("olga at corp-mail dot invalid", "EMAIL")}),
    ("Caller gave NI number: QQ 13 56 58 C while the directive was locked.", {("QQ 13 56 58 C", "ID_NUMBER")}),
    ("Herr Rostelli hat Steuer-ID 33 450 311 497 genannt.", {("Rostelli", "NAME"), ("33 450 311 497", "ID_NUMBER")}),
    ("Ship the replacement badge to 191 W. Quarry Avenue #29, Ostrava Falls, QX 00715 by Friday.", {("191 W. Quarry Avenue #29, Ostrava Falls, QX 00715", "ADDRESS")}),
    ("Lieferung an Quarrygasse 86a, 23500 Ivelstone prüfen.", {("Quarrygasse 86a, 23500 Ivelstone", "ADDRESS")}),
    ("Livraison : 70 chemin du Vieux Moulin, 39500 Ostrava Falls.", {("70 chemin du Vieux Moulin, 39500 Ostrava Falls", "ADDRESS")}),
    ("担当：風見原　結月、電話＋８１ ９０－００００－５０９８", {("風見原　結月", "NAME"), ("＋８１ ９０－００００－５０９８", "PHONE")}),
    ("送付先：架空県星見市月影町2-9-16 項目の設定を取得する前に", {("架空県星見市月影町2-9-16", "ADDRESS")}),
    ("連絡先はpedro.olquist@post.quill.testです。", {("pedro.olquist@post.quill.test", "EMAIL")}),
    ("Image atlas@sha256:239de5bcbf1711c1 was promoted. Batch 442752757-18-8791 replayed. Row count was 295049200, expected 410433146.", set()),
    ("Main Street Theme is the default palette of the claim catalog.", set()),
    ("", set()), (" ", set()),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_items(text, want):
    assert items(text) == want


def test_held_out_accuracy():
    model, wrong, right, missed = tagger.load(), 0, 0, 0
    maker = Maker(987_654)
    for _ in range(400):
        spans = maker.text()
        text, at = "", []
        for s, k in spans:
            if k != "O":
                at.append((s.strip(), k))
            text += s
        got = pii.find_items([text], [""])[0]
        found = {(text[a:b], k) for a, b, k in got}
        right += len(found & set(at))
        wrong += len(found - set(at))
        missed += len(set(at) - found)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97
    assert model.hidden == tagger_train.HIDDEN


def test_windows_reconcile_to_one_labelling():
    filler = "The mapper quickly groups the ledger before the queue. "
    for pad in range(0, 230, 23):
        text = filler * 3 + "x" * pad + " Please call Rosa Vasquorin on 01632 960936 before noon. " + filler * 6
        assert {("Rosa Vasquorin", "NAME"), ("01632 960936", "PHONE")} <= items(text)
    labels = [np.full(240, 1, np.int8), np.full(240, 2, np.int8)]
    merged = pii.reconcile(408, [(0, 240), (168, 408)], labels)
    assert (merged[:204] == 1).all() and (merged[204:] == 2).all()


def test_best_path_search_is_exact():
    model = tagger.load()
    r = np.random.default_rng(0)
    scores = r.normal(0, 2, (40, 6, 30)).astype(np.float32)
    scores[:, 0] += 3
    got = model.best(scores)
    for w in range(30):
        d, back = scores[0, :, w].copy(), []
        for t in range(1, 40):
            c = d[:, None] + model.trans
            back.append(c.argmax(0))
            d = c.max(0) + scores[t, :, w]
        path = [int(d.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = path[::-1]
        score = lambda p, w=w: scores[0, p[0], w] + sum(model.trans[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(scores[t, p[t], w] for t in range(1, 40))
        assert score(got[w]) == pytest.approx(score(path), abs=1e-3)


def test_training_learns():
    w = tagger_train.initial()
    batch = tagger_train.sample(24, 3)
    first, _ = tagger_train.step(w, batch)
    for _ in range(12):
        _, grad = tagger_train.step(w, batch)
        norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
        w = {k: x - 0.3 / norm * grad[k] for k, x in w.items()}
    assert tagger_train.step(w, batch)[0] < first


def test_rows_and_redaction(spark):
    d = json.dumps({"note": "Requested by Rosa Vasquorin.", "n": 3, "deep": [{"to": "x@y.example"}], "u": "結"})
    logs = spark.createDataFrame([(1, d), (2, None), (3, ""), (4, "{}"), (5, '{"cut": "'), (None, d), (1, d)], "id long, details string")
    tasks = spark.createDataFrame([(1, "cc Noor Jurkevast <a.b@c.example>. cc Noor Jurkevast <a.b@c.example>"), (2, None)], "id long, description string")
    spans = "trace_id string, spans array<struct<span_id:string,events:array<struct<name:string,attributes:map<string,string>>>>>"
    traces = spark.createDataFrame([("t", [("s", [("e", None), ("f", {"approved.by": "Rosa Vasquorin", "seq": "1"})]), ("u", None)]), ("v", None)], spans)
    got = sorted(tuple(r) for r in pii.found_items(tasks, logs, traces).collect())
    assert got == [
        ("audit_logs", "1", "EMAIL", "x@y.example"), ("audit_logs", "1", "NAME", "Rosa Vasquorin"), ("tasks", "1", "EMAIL", "a.b@c.example"), ("tasks", "1", "NAME", "Noor Jurkevast"), ("traces", "t:s:2", "NAME", "Rosa Vasquorin"),
    ]
    clean = {(r["src_table"], r["row_key"], r["field"]): r["redacted"] for r in pii.redacted(pii.text_rows(tasks, logs, traces)).collect()}
    assert clean["tasks", "1", ""] == "cc [NAME] <[EMAIL]>. cc [NAME] <[EMAIL]>"
    assert json.loads(clean["audit_logs", "1", ""]) == {"note": "Requested by [NAME].", "n": 3, "deep": [{"to": "[EMAIL]"}], "u": "結"}
    assert pii.found_items(tasks.limit(0), logs.limit(0), traces.limit(0)).collect() == []


def test_unseen_names_in_unseen_sentences():
    """Neither the names, streets and hosts nor the sentences of these texts were trained on."""
    maker, right, want = Maker(31, "held"), 0, 0
    for _ in range(300):
        spans = maker.text()
        text = "".join(s for s, _ in spans)
        at = {(s.strip(), k) for s, k in spans if k != "O"}
        found = {(text[a:b], k) for a, b, k in pii.find_items([text], [""])[0]}
        right, want = right + len(found & at), want + len(at)
    assert right / want > 0.83


def test_forms_are_searched_in_the_whole_line():
    street = "Very " * 3 + "Long Lane"
    text = f"Deliver it to 12 {street}, Apt 4, Springdale, QX 00715 by Friday."
    forms = pii.Forms("x " * 400 + text)
    at = 800 + text.index("Lane")
    assert [forms.text[x:y] for x, y in forms.near(at, at + 4, "ADDRESS")] == [f"12 {street}, Apt 4, Springdale, QX 00715"]


def test_only_the_capitals_of_a_run_and_lone_words_behind_titles():
    assert pii._name("ask Rosa de Vries about", 0, 23) == (4, 17)
    assert pii._name("The Team", 4, 8) is None and pii._name("Dr. Okoro came", 4, 9) == (4, 9)


def test_equal_strings_in_two_fields_are_redacted_apart():
    assert pii._rewrite('{"a": "x y", "b": "x y"}', {1: "[NAME]"}) in ('{"a": "[NAME]", "b": "x y"}', '{"a": "x y", "b": "[NAME]"}')
    assert pii._rewrite("plain", {0: "new"}) == "new" and pii._rewrite("plain", {}) == "plain"
