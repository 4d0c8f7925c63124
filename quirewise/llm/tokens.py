"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary lies on every machine; a parameter of all functions here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that the tokenizer never joins: every split of PATTERN lies within one of them.
_PIECE = re.compile(r" ?(?:\S|[\x1c-\x1f])+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")


class _Counts(dict):
    """Tokens of each piece, counted once."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


@lru_cache(maxsize=4)
def _counts(path: str) -> _Counts:
    return _Counts(path)


def token_count(text: str, path: str = VOCABULARY) -> int:
    return sum(map(_counts(path).__getitem__, _PIECE.findall(text)))


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; null stays null, an empty text has none."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else token_count(t, path)).astype("Int64")

    return count(text)
