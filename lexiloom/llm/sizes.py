"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.session import cut

#: Where the vocabulary file lies (a parameter everywhere), and the public pre-tokenizer pattern of that family.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """One a Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; NULL and "" have none. Special-token strings in a text are ordinary text."""

    @F.pandas_udf("bigint")
    def count(x: pd.Series) -> pd.Series:
        encode = encoder(vocabulary).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in x], dtype="int64")

    return count(text)


def sized(docs: DataFrame, *keep: str, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(*keep, size), written to the shared folder: later passes read two numbers a document, not its text."""
    return cut(docs.select(*keep, n_tokens(text, vocabulary).alias("size")))
