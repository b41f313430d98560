"""Encoding of a whole corpus with a public tokenizer (problem 7).

One Arrow pass without shuffle; each Python worker loads the vocabulary once. Equal words are
encoded once per worker (bounded memory of the last words).

Defined results: null and empty texts have an empty list of ids; blank, very long and odd
texts are encoded whole; strings of special tokens are ordinary text; repeated rows stay.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import prefixbpe
from evigraph.session import spread

_LOADED: dict[str, prefixbpe.PrefixEncoder] = {}


def encoder(path: str) -> prefixbpe.PrefixEncoder:
    if path not in _LOADED:
        _LOADED[path] = prefixbpe.PrefixEncoder(prefixbpe.load_ranks(path))
    return _LOADED[path]


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row by the byte-level vocabulary in the rank file ``path``."""
    path = path or os.path.join(prefixbpe.tokenizer_folder(), "byte_bpe_50k.tiktoken")

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for b in batches:
            yield pd.Series([enc.encode(t) for t in b], dtype=object)

    return spread(documents.select(key, text)).select(key, ids(F.col(text)).alias("ids"))
