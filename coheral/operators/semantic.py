"""Latent semantic text vectors: TF-IDF and a randomised range finder over the corpus.

The vocabulary is the ``max_terms`` terms in most documents (exact counts).  Sparse TF-IDF rows
are written once; the right singular space is found by subspace iteration: each pass
multiplies every row with the current basis and back, adds up (term, vector) sums in the task,
then by term, and orthonormalises the basis.  What leaves the cluster has terms x (rank + oversample) numbers at
most, whatever the number of documents; rows never do.

Null and empty texts, and texts without a known term, get the zero vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.session import cut_lineage

SLICE = 1 << 15  # matrix entries worked on at a time


@dataclass
class SemanticModel:
    terms: dict[str, int]
    idf: np.ndarray
    projection: np.ndarray     # terms x rank
    singular: np.ndarray


def words(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def vocabulary(df: DataFrame, text: str, max_terms: int, min_df: int) -> tuple[dict[str, int], np.ndarray]:
    """(term -> number, inverse document frequencies) of the terms in most documents, ties by term."""
    n = df.count()
    counts = (df.select(F.explode(F.array_distinct(words(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
              .filter(F.col("df") >= min_df).orderBy(F.desc("df"), "term").limit(max_terms).collect())
    return {r["term"]: i for i, r in enumerate(counts)}, np.log((1 + n) / (1 + np.array([r["df"] for r in counts], float))) + 1


def _sparse(terms: list[str], idf: np.ndarray, rows: pa.ListArray) -> tuple[list[bytes], list[bytes]]:
    """Term numbers and L2-normalised TF-IDF weights of token lists; tokens stay in Arrow's memory, none becomes a string."""
    known = pc.index_in(rows.flatten(), value_set=pa.array(terms, rows.type.value_type))
    known = known.fill_null(-1).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    at, weights = [], []
    for lo, hi in zip(ends, ends[1:]):
        ids = known[lo:hi]
        ids, n = np.unique(ids[ids >= 0], return_counts=True)
        w = n * idf[ids]
        at.append(ids.astype(np.int32).tobytes())
        weights.append((w / max(np.sqrt((w * w).sum()), 1e-300)).astype(np.float64).tobytes())
    return at, weights


def _slices(at: pd.Series, weights: pd.Series) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, term numbers, weights, row of each entry) for a bounded number of entries."""
    sizes = np.array([len(a) // 4 for a in at])
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), SLICE)) + lo)
        yield (lo, hi, np.frombuffer(b"".join(at.iloc[lo:hi]), np.int32), np.frombuffer(b"".join(weights.iloc[lo:hi]), np.float64),
               np.repeat(np.arange(hi - lo), sizes[lo:hi]))
        lo = hi


def _by_group(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups, sums of their rows)."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[first], np.add.reduceat(values[order], first, axis=0)


def _product(ids: np.ndarray, w: np.ndarray, row: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((n, basis.shape[1]))
    if len(ids):
        rows, sums = _by_group(row, basis[ids] * w[:, None])
        out[rows] = sums
    return out


def _summed(matrix: DataFrame, size: int, width: int, per_batch) -> np.ndarray:
    """Sum over all batches of ``per_batch``'s (row numbers, row values): in the task, then by row number."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((size, width)), np.zeros(size, bool)
        for b in batches:
            for part in _slices(b["at"], b["w"]):
                rows, values = per_batch(*part)
                total[rows] += values
                seen[rows] = True
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"row": found, "v": [total[i].tobytes() for i in found]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b["row"], b["v"]):
                v = np.frombuffer(v, np.float64)
                total[i] = total[i] + v if i in total else v
        yield pd.DataFrame({"row": list(total), "v": [v.tobytes() for v in total.values()]})

    out = np.zeros((size, width))
    schema = "row bigint, v binary"
    for r in matrix.mapInPandas(partial, schema).repartition("row").mapInPandas(add, schema).collect():
        out[r["row"]] = np.frombuffer(r["v"], np.float64)
    return out


def fit_semantic(df: DataFrame, text: str = "text", rank: int = 64, oversample: int = 16, max_terms: int = 20_000,
                 min_df: int = 2, iterations: int = 4, seed: int = 0) -> SemanticModel:
    """Model of the corpus' ``rank`` strongest directions (fewer, if it has fewer)."""
    terms, idf = vocabulary(df, text, max_terms, min_df)
    names = list(terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, w = _sparse(names, idf, b.column("words"))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(w, pa.binary())], ["at", "w"])

    width = min(rank + oversample, len(terms))
    if not width:
        return SemanticModel(terms, idf, np.zeros((0, 0)), np.zeros(0))
    matrix = cut_lineage(df.select(words(text).alias("words")).mapInArrow(rows, "at binary, w binary"))
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(terms), width)))

    def back_and_forth(lo, hi, ids, w, row):
        image = _product(ids, w, row, hi - lo, basis)
        return _by_group(ids, image[row] * w[:, None]) if len(ids) else (np.zeros(0, int), np.zeros((0, width)))

    for _ in range(iterations):
        basis, _ = np.linalg.qr(_summed(matrix, len(terms), width, back_and_forth))

    def gram(lo, hi, ids, w, row):
        image = _product(ids, w, row, hi - lo, basis)
        return np.arange(width), image.T @ image

    values, vectors = np.linalg.eigh(_summed(matrix, width, width, gram))
    strongest = np.argsort(-values)[:rank]
    return SemanticModel(terms, idf, basis @ vectors[:, strongest], np.sqrt(np.maximum(values[strongest], 0)))


def semantic_embedding(df: DataFrame, model: SemanticModel, text: str = "text", out: str = "embedding") -> DataFrame:
    """``df`` with its texts' vectors, of length 1 (or 0)."""
    names, idf, projection = list(model.terms), model.idf, model.projection

    @F.arrow_udf("array<double>")
    def embed(rows: pa.Array) -> pa.Array:
        at, w = (pd.Series(x, dtype=object) for x in _sparse(names, idf, rows))
        vectors = [np.zeros((0, projection.shape[1]))]
        for lo, hi, ids, weights, row in _slices(at, w):
            v = _product(ids, weights, row, hi - lo, projection)
            vectors.append(v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300))
        made = np.concatenate(vectors)
        ends = np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made.ravel(), pa.float64()))

    return df.withColumn(out, embed(words(text)))
