"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE, as a path that every executor can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of such ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text as INT; 0 for an empty or missing text."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary).encode_ordinary
        for texts in parts:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return F.pandas_udf(run, "int")(text)
