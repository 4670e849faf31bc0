"""Operator 12, target-distribution importance resampling with hashed n-gram features.

A text's features are its runs of one and two words.  Per block of words, features are
interned in an open-addressed NumPy table: the XXH64 of a feature's bytes gives the
first place, linear probing the next ones, and an occurrence only joins a slot whose
bytes equal its own.  A slot holds its feature's bucket (crc32 modulo ``buckets``) and how
often it occurs.  The first pass adds the slots' counts up by bucket, over all rows of the
corpus and of the target; the bucket table (``buckets`` rows, whatever the input) gives
each bucket's gain.  The second pass looks up one gain per slot and gathers it through the
occurrences' slot ids into each document's mean.

Gumbel noise from a hash of the id is added to the mean and the documents with the
highest sums are drawn, which samples without replacement in proportion to exp(weight).
Their order is a distributed rank over narrow rows.

Edge cases: a null or wordless text has no features and weight 0; a null id hashes like
an empty one, sorts after the other ids and is drawn like any row; repeated rows are rows of their
own, equal ones ranked by their place; a text of any length is worked off in blocks of
words; without documents there are no rows, without a target all buckets have t = 0.
Only the named key and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.llm.common import cut, modest_batches, text_slices
from coheral.operators.ordering import global_rank

BUCKETS = 10_000
CHUNK = 1 << 20
BLOCK_WORDS = 1 << 15

# A-Z to a-z; digits, a-z and bytes beyond ASCII stay, all else separates words
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# fixed values: the five primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161,
                                                  9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


class Spans:
    """Byte ranges of one buffer, hashed and compared without a loop over them."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate((data, np.zeros(40, np.uint8)))
        # the eight bytes from every place on, as one little-endian number
        self.lanes = np.ndarray((len(self.data) - 7,), "<u8", self.data, 0, (1,)).astype(np.uint64)

    def xxh64(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """XXH64 (seed 0) of every range."""
        with np.errstate(over="ignore"):
            size = length.astype(np.uint64)
            h = size + _P5
            at = start.copy()
            long = np.flatnonzero(length >= 32)
            if len(long):
                h[long] = self._stripes(start[long], length[long]) + size[long]
                at[long] += length[long] // 32 * 32
            left = length - (at - start)
            todo = np.flatnonzero(left >= 8)
            while len(todo):
                h[todo] = _rot(h[todo] ^ _round(np.uint64(0), self.lanes[at[todo]]), 27) * _P1 + _P4
                at[todo] += 8
                left[todo] -= 8
                todo = todo[left[todo] >= 8]
            todo = np.flatnonzero(left >= 4)
            h[todo] = _rot(h[todo] ^ ((self.lanes[at[todo]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            at[todo] += 4
            left[todo] -= 4
            todo = np.flatnonzero(left > 0)
            while len(todo):
                h[todo] = _rot(h[todo] ^ (self.data[at[todo]].astype(np.uint64) * _P5), 11) * _P1
                at[todo] += 1
                left[todo] -= 1
                todo = todo[left[todo] > 0]
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            return h ^ (h >> np.uint64(32))

    def _stripes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        acc = [np.full(len(start), x, np.uint64) for x in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
        todo, k = np.arange(len(start)), 0
        while len(todo):
            for j in range(4):
                acc[j][todo] = _round(acc[j][todo], self.lanes[start[todo] + 32 * k + 8 * j])
            k += 1
            todo = todo[length[todo] >= 32 * (k + 1)]
        h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.uint64(0), a)) * _P1 + _P4
        return h

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes from a on equal those from b on, for ``length`` bytes each."""
        same, k = np.ones(len(a), bool), 0
        todo = np.arange(len(a))
        while len(todo):
            left = length[todo] - 8 * k
            spare = (np.maximum(8 - left, 0) * 8).astype(np.uint64)  # bits of the lane beyond the range
            differ = ((self.lanes[a[todo] + 8 * k] ^ self.lanes[b[todo] + 8 * k]) << spare) != 0
            same[todo[differ]] = False
            k += 1
            todo = todo[~differ & (left > 8)]
        return same


class Table:
    """Open-addressed table of the distinct features of one block.

    ``slot`` gives every occurrence's slot; the table's own columns are the ``owner``
    (the slot's first occurrence, or -1), ``bucket`` and ``count``.
    """

    def __init__(self, spans: Spans, start: np.ndarray, length: np.ndarray, buckets: int, keys: np.ndarray | None = None):
        n = len(start)
        keys = spans.xxh64(start, length) if keys is None else keys
        size = 1 << max(2 * n - 1, 1).bit_length()
        self.owner = np.full(size, -1, np.int64)
        self.slot = np.empty(n, np.int64)
        at = (keys & np.uint64(size - 1)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            place = at[todo]
            free = self.owner[place] < 0
            self.owner[place[free][::-1]] = todo[free][::-1]  # the first one gets the slot
            owner = self.owner[place]
            mine = owner == todo
            maybe = np.flatnonzero(~mine & (keys[owner] == keys[todo]) & (length[owner] == length[todo]))
            o, t = owner[maybe], todo[maybe]
            mine[maybe[spans.equal(start[o], start[t], length[t])]] = True
            self.slot[todo[mine]] = place[mine]
            todo = todo[~mine]
            at[todo] = (at[todo] + 1) & (size - 1)
        self.used = np.flatnonzero(self.owner >= 0)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        whole, first = spans.data.tobytes(), self.owner[self.used]
        self.bucket[self.used] = [crc32(whole[a:b]) % buckets for a, b in
                                  zip(start[first].tolist(), (start[first] + length[first]).tolist())]


def _fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts one blank apart: the bytes, word starts and ends in them, and each word's text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((b" ".join(parts) + b" ").translate(_FOLD), np.uint8)
    word = data != 32
    after = np.concatenate(([False], word[:-1]))
    text_of = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), np.flatnonzero(word & ~after), "right")
    line = data[word | after]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], line == 32))))
    return line, edge[0::2], edge[1::2], text_of


def blocks(texts: list[str], buckets: int, block_words: int = BLOCK_WORDS) -> Iterator[tuple[Table, np.ndarray, np.ndarray]]:
    """(table, the text of each occurrence, the text of each word) for every block of words; a pair belongs to its first word's block."""
    line, starts, ends, text_of = _fold(texts)
    for a in range(0, len(starts), block_words):
        b = min(a + block_words, len(starts))
        last = min(b, len(starts) - 1)
        base, part = starts[a], slice(a, b)
        pair = np.arange(a, last)
        pair = pair[text_of[pair] == text_of[pair + 1]]
        start = np.concatenate((starts[part], starts[pair])) - base
        length = np.concatenate((ends[part] - starts[part], ends[pair + 1] - starts[pair]))
        spans = Spans(line[base: ends[last]])
        yield Table(spans, start, length, buckets), np.concatenate((text_of[part], text_of[pair])), text_of[part]


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count): occurrences of all features of all texts, added up in the tasks before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for lo, hi in text_slices(texts, CHUNK):
                for table, _, _ in blocks(texts[lo:hi], buckets):
                    total += np.bincount(table.bucket[table.used], table.count[table.used], buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found, "count": total[found]})

    return (df.select(F.col(text).alias("text")).mapInPandas(run, "bucket bigint, count bigint")
            .groupBy("bucket").agg(F.sum("count").alias("count")))


def _by_bucket(df: DataFrame, text: str, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in bucket_counts(df, text, buckets).collect():  # ``buckets`` rows at most
        out[r["bucket"]] = r["count"]
    return out


def fit(df: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths: log of the smoothed ratio of its shares in target and corpus."""
    modest_batches(df.sparkSession)
    s, t = _by_bucket(df, text, buckets), _by_bucket(target, text, buckets)
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s, t)], np.int64)


def weights(df: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; the weight is the floored mean gain of its features."""
    buckets = len(gains)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for lo, hi in text_slices(texts, CHUNK):
                words, features, gain = (np.zeros(hi - lo, np.int64) for _ in range(3))
                for table, text_of, word_of in blocks(texts[lo:hi], buckets):
                    per_slot = gains[table.bucket]
                    words += np.bincount(word_of, minlength=hi - lo)
                    features += np.bincount(text_of, minlength=hi - lo)
                    gain += np.bincount(text_of, per_slot[table.slot], hi - lo).astype(np.int64)
                mean = np.where(features > 0, gain // np.maximum(features, 1), 0)
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi], "n_words": words, "n_features": features, "weight": mean})

    return (df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
            .mapInPandas(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of an id in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 25,
             min_words: int = 20, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of ``df``."""
    gains = fit(df, target, text, buckets)
    scored = cut(weights(df, gains, key, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    scored = scored.withColumn("place", F.monotonically_increasing_id())  # of written rows: the same each time
    long_enough = F.col("n_words") >= min_words
    drawn = scored.filter(long_enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place")]
    ranked = global_rank(scored.filter(long_enough), order, "position")
    rank = F.when(F.col("position") < drawn, F.col("position") + 1).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(
        scored.filter(~long_enough).select(*columns, F.lit(None).cast("long").alias("rank")))
