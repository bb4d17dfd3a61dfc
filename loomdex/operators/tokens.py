"""Tokens by a vocabulary file where one is named, else by the estimate of four characters a token."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.text import token_count


def backend(vocabulary: str | None = None) -> str:
    return "tokenizers" if vocabulary else "heuristic"


def encode(text: Column, vocabulary: str) -> Column:
    """array<int>: ids by a tokenizer file, without special tokens; null for null."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        made = t.encode_batch(s.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([None if n else e.ids for n, e in zip(s.isna(), made, strict=True)])

    return run(text)


def count(text: Column, vocabulary: str | None = None) -> Column:
    return F.size(encode(text, vocabulary)) if vocabulary else token_count(text)
