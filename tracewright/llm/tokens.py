"""Token counts of whole texts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("TRACEWRIGHT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoder(path: str):
    """The encoding of a rank file, loaded once a worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a whole text, encoded in one go whatever its length; null and empty texts have none."""
    return len(encoder(path).encode_ordinary(text)) if text else 0


def token_sizes(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """``(id, keep..., tokens)`` for every row, texts read whole."""
    kept = df.select(id_col, *keep, text_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != text_col]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=[text_col]).assign(tokens=[count_tokens(t, path) for t in pdf[text_col]])

    return kept.mapInPandas(count, ", ".join([*fields, "tokens long"]))


def with_occurrence(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a number ``occurrence`` among the rows that are equal in ``keys``: counted, then written out again.

    Equal rows are interchangeable, so nothing depends on the order or the files that they came in.
    """
    return sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("occurrence", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
