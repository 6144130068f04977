"""Lengths of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from geoskein.plans.session import ship

#: The folder of the vocabularies, the same on every executor.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the split before the merges that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space from this length on are merged as pieces of their own; the tokenizer's split would recurse on them.
LONG_SPACE = re.compile(r"\s{2000,}")


@lru_cache(maxsize=2)
def encoder(folder: str):
    import tiktoken

    with open(os.path.join(folder, RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, folder: str = TOKENIZERS) -> list[int]:
    """The tokens of the whole text, special tokens taken as plain text."""
    enc, out, done = encoder(folder), [], 0
    for run in LONG_SPACE.finditer(text):
        # the split gives all of the run but its last sign to one piece, unless the text ends there
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[done : run.start()])
        out += enc._encode_single_piece(text[run.start() : end].encode("utf-8"))
        done = end
    return out + enc.encode_ordinary(text[done:])


def token_count(text: Column, folder: str = TOKENIZERS) -> Column:
    """Tokens of each text; NULL and empty texts have none.  Call ``ship`` on the session before."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode(t, folder)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return F.pandas_udf(run, LongType())(text)


def token_counts(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, tokens) of every document; rows without an id are left out."""
    ship(documents.sparkSession)
    return documents.where("doc_id is not null").select("doc_id", token_count(F.col("text"), folder).alias("tokens"))
