"""Operator 10, language ID: language-bitmask n-gram filters.

Training counts character trigrams per language over all learning rows.  Each
language keeps the trigrams that make up at least ``min_share`` of its own (so at
most ``1 / min_share`` of them, whatever the corpus size).  They go into one
bit-sliced Bloom filter: a slot holds a bitmask with one bit per language, the AND
over the slots of an n-gram is the set of languages that contain it.  A prediction
counts, per language, the n-grams of the text whose mask has its bit, takes away
the false positives expected from the filter's fill, and picks the largest.

Edge cases: null or letterless text -> ``und`` with score 0; ties go to the
smaller language value; rows with null lang or text teach nothing; with nothing
learned every text is ``und``.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.llm.common import mix64, modest_batches, text_slices

UNKNOWN = "und"
CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code point or space for characters outside words, is a letter)."""
    word = np.full(0x110000, 32, np.uint32)
    letter = np.zeros(0x110000, bool)
    for c in range(0x110000):
        cat = unicodedata.category(chr(c))[0]
        if cat in "LM":
            low = chr(c).lower()
            word[c] = ord(low) if len(low) == 1 else c
            letter[c] = cat == "L"
    return word, letter


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed trigrams of all texts, the text each belongs to, and which texts have a letter."""
    word, letter = _char_tables()
    joined = "".join(f" {t} " for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    has = np.zeros(len(texts), bool)
    has[owner[letter[raw]]] = True
    cp = word[raw]
    keep = np.ones(len(cp), bool)  # runs of spaces inside a text become one
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32) | (owner[1:] != owner[:-1])
    cp, owner = cp[keep].astype(np.int64), owner[keep]
    if len(cp) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    same = (owner[2:] == owner[:-2]) & (cp[1:-1] != 32)
    grams = ((cp[:-2] << 42) | (cp[1:-1] << 21) | cp[2:])[same]
    return grams, owner[2:][same], has


def count_ngrams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows; each task sums up before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[str, list] = {}

        def fold(lists: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in lists]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, np.concatenate([n for _, n in lists]))
            return keys, sums

        for b in batches:
            for name, group in b.groupby("lang"):
                texts = list(group["text"])
                for lo, hi in text_slices(texts, CHUNK):
                    grams, _, _ = _trigrams(texts[lo:hi])
                    own = parts.setdefault(name, [])
                    own.append(np.unique(grams, return_counts=True))
                    if len(own) >= 16:
                        parts[name] = [fold(own)]
        for name, lists in parts.items():
            keys, sums = fold(lists)
            if len(keys):
                yield pd.DataFrame({"lang": name, "gram": keys, "n": sums})

    rows = (df.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
            .filter("text IS NOT NULL AND lang IS NOT NULL"))
    return (rows.mapInPandas(count, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class LanguageFilter:
    """Bit-sliced Bloom filter over the kept n-grams of every language."""

    def __init__(self, profile: dict[str, np.ndarray], hashes: int = 3, bits_per_gram: int = 64):
        self.langs = sorted(profile)
        self.hashes = hashes
        most = max((len(g) for g in profile.values()), default=1)
        self.size = 1 << max(10, int(most * bits_per_gram - 1).bit_length())
        words = -(-max(1, len(self.langs)) // 64)
        self.masks = np.zeros((words, self.size), np.uint64)
        self.wrong = np.zeros(len(self.langs))  # false-positive rate per language
        for k, name in enumerate(self.langs):
            bit = np.uint64(1) << np.uint64(k % 64)
            for h in range(hashes):
                self.masks[k // 64, self._slot(profile[name], h)] |= bit
            self.wrong[k] = np.count_nonzero(self.masks[k // 64] & bit) / self.size
        self.wrong **= hashes

    def _slot(self, grams: np.ndarray, h: int) -> np.ndarray:
        return (mix64(grams.astype(np.uint64), h + 1) & np.uint64(self.size - 1)).astype(np.int64)

    def languages(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask (words x n) of the languages containing each n-gram."""
        out = self.masks[:, self._slot(grams, 0)]
        for h in range(1, self.hashes):
            out &= self.masks[:, self._slot(grams, h)]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return pred, score
        for lo, hi in text_slices(texts, CHUNK):
            grams, owner, has = _trigrams(texts[lo:hi])
            n = np.bincount(owner, minlength=hi - lo).astype(float)
            masks = self.languages(grams)
            hits = np.zeros((len(self.langs), hi - lo))
            for k in range(len(self.langs)):
                got = (masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits[k] = np.bincount(owner, weights=got, minlength=hi - lo)
            true = np.maximum(0, hits - n * self.wrong[:, None]) / (1 - self.wrong[:, None])
            best = true.argmax(0)
            for i in np.flatnonzero(has):
                pred[lo + i] = self.langs[best[i]]
                score[lo + i] = float(min(1.0, true[best[i], i] / max(n[i], 1)))
        return pred, score


def fit(df: DataFrame, text: str = "text", lang: str = "lang", min_share: float = 1e-4) -> LanguageFilter:
    """Learn from every row of ``df``.  At most ``1 / min_share`` n-grams per language reach the driver."""
    modest_batches(df.sparkSession)
    counts = count_ngrams(df, text, lang)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "lang").filter(F.col("n") >= F.col("total") * F.lit(min_share)).select("lang", "gram")
    profile: dict[str, np.ndarray] = {}
    for name, group in kept.toPandas().groupby("lang"):
        profile[str(name)] = np.sort(group["gram"].to_numpy(np.int64))
    return LanguageFilter(profile)


def predict(df: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score; same-named columns are replaced."""
    modest_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        values = [t if isinstance(t, str) else "" for t in texts]
        pred, score = shared.value.predict(values)
        return pd.DataFrame({"lang_pred": pred, "score": score})

    out = df.select(*[F.col(f"`{c}`") for c in kept], label(F.col(text)).alias("__label"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "__label.lang_pred", "__label.score")


def identify(df: DataFrame, held_out: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows where ``held_out`` is false, predict all rows."""
    model = fit(df.filter(~held_out), text, lang)
    return predict(df, model, text)
