"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the ranks of the byte-level vocabulary are; never copied into the repository.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenization pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoding(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str = RANKS) -> Column:
    """Tokens of a text; 0 for an empty one, null for null."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        e = encoding(path)
        return pd.Series([len(e.encode_ordinary(t)) if isinstance(t, str) else None for t in texts], dtype="Int64")

    return count(text)
