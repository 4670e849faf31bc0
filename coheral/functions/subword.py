"""Subword tokens from a vocabulary file of a public tokenizer.

``Subwords(path)`` reads ``.json`` (tokenizers), ``.tiktoken`` (ranks) or ``.model``
(sentencepiece) files; nothing is trained and no vocabulary is part of this package.
The file is sent to the executors once (``SparkContext.addFile``), loaded once per Python worker, and
applied to Arrow batches.  A ``Subwords`` can stand wherever an operator takes ``token_len``.
Texts are ordinary text: strings of special tokens in them are not special.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# ---- fixed value: how rank files of this kind split a text before the merges ----
RANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ----------------------------------------------------------------------------------
SLICE = 1 << 18  # characters given to a tokenizer at a time: its results take many times the text's memory


@lru_cache(maxsize=4)
def _load(name: str, pattern: str):
    """(texts -> lists of ids, ids -> text) of a vocabulary file."""
    path = name if os.path.isabs(name) and os.path.exists(name) else SparkFiles.get(os.path.basename(name))
    if path.endswith(".json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return (lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]), (lambda ids: t.decode(ids, skip_special_tokens=False))
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}
        t = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: [t.encode_ordinary(x) for x in texts]), t.decode
    if path.endswith(".model"):
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: t.encode(texts, num_threads=1)), (lambda ids: t.decode(ids))
    raise ValueError(f"{path}: not a .json, .tiktoken or .model vocabulary")


class Subwords:
    """Token counts and ids of one vocabulary; calling it gives a column's count (null for null)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = RANK_PATTERN):
        spark.sparkContext.addFile(path)
        self.name, self.pattern = os.path.basename(path), pattern

    def __call__(self, text) -> Column:
        name, pattern = self.name, self.pattern

        @F.pandas_udf("int")
        def count(texts: pd.Series) -> pd.Series:
            encode, _ = _load(name, pattern)
            return _over(texts, lambda some: [len(ids) for ids in encode(some)])
        return count(text)

    def each(self, texts) -> Column:
        """array<int>: the count of every text of an array column."""
        name, pattern = self.name, self.pattern

        @F.pandas_udf("array<int>")
        def count(rows: pd.Series) -> pd.Series:
            encode, _ = _load(name, pattern)
            flat = pd.Series([x for row in rows if row is not None for x in row], dtype=object)
            counts = iter(_over(flat, lambda some: [len(ids) for ids in encode(some)]))
            return pd.Series([None if row is None else [next(counts) for _ in row] for row in rows], dtype=object)
        return count(texts)

    def encode(self, text) -> Column:
        """array<int>: token ids."""
        name, pattern = self.name, self.pattern

        @F.pandas_udf("array<int>")
        def run(texts: pd.Series) -> pd.Series:
            return _over(texts, _load(name, pattern)[0])
        return run(text)

    def decode(self, ids) -> Column:
        """The text of token ids."""
        name, pattern = self.name, self.pattern

        @F.pandas_udf("string")
        def run(rows: pd.Series) -> pd.Series:
            _, decode = _load(name, pattern)
            return rows.map(lambda row: decode([int(i) for i in row]), na_action="ignore")
        return run(ids)


def _over(texts: pd.Series, fn) -> pd.Series:
    """``fn`` of the non-null texts, put back in place; a call gets ``SLICE`` characters or one text."""
    out: list = [None] * len(texts)
    places: list[int] = []
    some: list[str] = []
    size = 0

    def flush() -> None:
        for place, value in zip(places, fn(some)):
            out[place] = value

    for place in texts.notna().to_numpy().nonzero()[0]:
        text = texts.iat[place]
        if some and size + len(text) > SLICE:
            flush()
            places, some, size = [], [], 0
        places.append(place)
        some.append(text)
        size += len(text)
    if some:
        flush()
    return pd.Series(out, dtype=object)


def lengths(texts: Column, token_len) -> Column:
    """Token counts of an array of texts, by a column function or by ``Subwords``."""
    return token_len.each(texts) if hasattr(token_len, "each") else F.transform(texts, token_len)
