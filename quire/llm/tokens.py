"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Folder of the public vocabulary files and the file used; both are parameters.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The tokenizer, once for each process. Special tokens' strings are ordinary text."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_public_tokenizers", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("quire", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> int:
    """Tokens of the whole text; none for null and the empty text."""
    return len(encoder(folder, vocabulary).encode_ordinary(text)) if text else 0


def token_count(column: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Token counts as a column, 0 for null."""

    def run(texts: pd.Series) -> pd.Series:
        encode = encoder(folder, vocabulary).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], index=texts.index, dtype="int64")

    return F.coalesce(pandas_udf(run, LongType())(column), F.lit(0).cast("bigint"))
