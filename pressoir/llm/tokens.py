"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Folder of the tokenizers' vocabulary files, and the vocabulary used by default.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The published splitting pattern of the byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def encoding(folder: str, vocabulary: str):
    import tiktoken

    path = Path(folder, vocabulary)
    if not path.exists():
        path = Path(SparkFiles.get(vocabulary))  # as the driver sent it
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.open("rb"))}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(col: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts. Strings of special tokens are ordinary text.

    The driver sends the vocabulary file to the workers, for those that do not have the folder.
    """
    spark, path = SparkSession.getActiveSession(), Path(folder, vocabulary)
    if spark is not None and path.exists():
        spark.sparkContext.addFile(str(path))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(folder, vocabulary)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(col)
