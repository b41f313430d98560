"""Problem 7: the prefix encoder against the library's own encoder."""

from __future__ import annotations

import os
import random

import pytest

from evigraph.llm import encoding, prefixbpe

FOLDER = prefixbpe.tokenizer_folder()
RANKS = os.path.join(FOLDER, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")
TEXTS = ["", " ", "Hello  world\n\n", "<|endoftext|> x", "naïve café 日本語 🙂", "a" * 300, "it's we'll I'd", " \t x", "=-" * 90, "0xDEADBEEF 1e-9"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def enc():
    return prefixbpe.PrefixEncoder(prefixbpe.load_ranks(RANKS))


def test_equals_the_library(enc, library):
    r = random.Random(1)
    odd = ["".join(r.choice("abcé ABC\n\t01'日-_") for _ in range(200)) for _ in range(60)] + ["".join(r.choice("ab") for _ in range(120)) for _ in range(20)]
    for text in TEXTS + odd:
        assert enc.encode(text) == library(text)
    assert enc.encode(None) == []


def test_round_trip(enc):
    for text in TEXTS:
        assert b"".join(enc.tokens[i] for i in enc.encode(text)).decode() == text


def test_prefixes_extend_exactly(enc, library):
    data = b"internationalisation"
    last: list[int] = []
    for end in range(1, len(data) + 1):
        enc.last_tokens(data[:end], last)
        assert enc.read_off(last) == library(data[:end].decode())


def test_appends_and_edits_re_encode_only_nearby(enc):
    r = random.Random(2)
    doc, text = prefixbpe.EditableEncoding(enc, "The quick brown fox"), "The quick brown fox"
    for _ in range(150):
        a = r.randint(0, len(text))
        b = min(len(text), a + r.randint(0, 4))
        new = "".join(r.choice("ab  '\nZ9é") for _ in range(r.randint(0, 5)))
        text = text[:a] + new + text[b:]
        doc.edit(a, b, new)
        assert doc.ids() == enc.encode(text)
    doc.append(" tail")
    assert doc.ids() == enc.encode(text + " tail")


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "Hi there", "c"), (3, "Hi there", "c"), (4, "word " * 20000, "c")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encoding.encoded(df).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 2 and len(got[4]) == 20001
    assert encoding.encoded(df.limit(0)).collect() == []
