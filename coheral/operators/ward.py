"""Ward clustering of any number of rows by mergeable clustering features.

A clustering feature is a cluster's size and sum of vectors; features add up, and Ward's
distance of two clusters follows from theirs.  Every task merges its rows, a block at a time,
down to ``leaves`` features by exact Ward merges; the tasks' features are merged the same way in a
tree of tasks.  The last ``leaves`` features are clustered by nearest-neighbour chains, and every row gets the
cluster of its nearest leaf.  With no more distinct vectors than leaves this is exact Ward clustering.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coheral.session import cut_lineage

FEATURE = "n double, total binary"


def ward_merges(n: np.ndarray, total: np.ndarray) -> list[tuple[int, int, float]]:
    """All merges (a, b, cost) of the features, cheapest first; b is the number that stays.

    Nearest-neighbour chains: two clusters that are each other's nearest are merged at once, which
    for Ward's distance gives the same tree as always merging the nearest pair.
    """
    k = len(n)
    n, centre = n.astype(float).copy(), total / n[:, None]
    square = (centre * centre).sum(1)
    d = np.maximum(square[:, None] + square[None, :] - 2 * centre @ centre.T, 0) * (n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(k, bool), [], []
    while len(merges) < k - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        cost = d[a, b]
        merges.append((a, b, float(cost)))
        # Lance-Williams: distances of the merged cluster from the two old ones
        new = ((n[a] + n) * d[a] + (n[b] + n) * d[b] - n * cost) / (n[a] + n[b] + n)
        n[b] += n[a]
        alive[a] = False
        new[~alive] = np.inf
        new[b] = np.inf
        d[b], d[:, b] = new, new
        d[a], d[:, a] = np.inf, np.inf
    return sorted(merges, key=lambda m: m[2])


def cut_tree(k: int, merges: list[tuple[int, int, float]], clusters: int) -> np.ndarray:
    """Cluster number of each of k features after the cheapest merges down to ``clusters``."""
    parent = np.arange(k)

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b, _ in merges[:max(k - clusters, 0)]:
        parent[root(a)] = root(b)
    return np.unique([root(v) for v in range(k)], return_inverse=True)[1]


def condense(n: np.ndarray, total: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """The features merged down to ``leaves``; equal centres always become one."""
    centre, same = np.unique(total / n[:, None], axis=0, return_inverse=True)
    same = same.ravel()
    n, total = np.bincount(same, n, len(centre)), np.stack([np.bincount(same, total[:, j], len(centre)) for j in range(total.shape[1])], 1)
    if len(n) > leaves:
        group = cut_tree(len(n), ward_merges(n, total), leaves)
        total = np.stack([np.bincount(group, total[:, j]) for j in range(total.shape[1])], 1)
        n = np.bincount(group, n)
    return n, total


def _merge(leaves: int, read):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(0), None
        for b in batches:
            more_n, more = read(b)
            for lo in range(0, len(more_n), leaves):
                some_n, some = more_n[lo:lo + leaves], more[lo:lo + leaves]
                n, total = condense(np.concatenate((n, some_n)), some if total is None else np.concatenate((total, some)), leaves)
        yield pd.DataFrame({"n": n, "total": [t.tobytes() for t in total] if total is not None else []})
    return run


def ward_leaves(vectors: DataFrame, vec: str, leaves: int, fan_in: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, sums) of at most ``leaves`` features that cover all rows with a vector."""
    def of_rows(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(b)), np.stack([np.asarray(v, float) for v in b["v"]]) if len(b) else np.zeros((0, 1))

    def of_features(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return b["n"].to_numpy(float), np.stack([np.frombuffer(t, float) for t in b["total"]]) if len(b) else np.zeros((0, 1))

    rows = vectors.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"))
    level = cut_lineage(rows.mapInPandas(_merge(leaves, of_rows), FEATURE))
    parts = level.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        level = cut_lineage(level.coalesce(parts).mapInPandas(_merge(leaves, of_features), FEATURE))
    got = level.collect()  # ``leaves`` rows
    return np.array([r["n"] for r in got]), np.array([np.frombuffer(r["total"], float) for r in got])


def hierarchical_topics(df: DataFrame, k: int = 20, vec: str = "embedding", leaves: int = 512) -> tuple[DataFrame, DataFrame]:
    """M6: (``df`` with ``cluster``, 0 the largest, null without a vector; centres: cluster, size, centre)."""
    spark = df.sparkSession
    n, total = ward_leaves(df, vec, leaves)
    schema = "cluster int, size bigint, centre array<double>"
    if not len(n):
        return df.withColumn("cluster", F.lit(None).cast("int")), spark.createDataFrame([], schema)
    group = cut_tree(len(n), ward_merges(n, total), k)
    sizes = np.bincount(group, n)
    number = np.empty(len(sizes), int)
    number[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))  # by size
    label, centre = number[group], total / n[:, None]
    square = (centre * centre).sum(1)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        there = np.flatnonzero(vectors.notna())
        for lo in range(0, len(there), 4096):
            at = there[lo:lo + 4096]
            x = np.stack([np.asarray(vectors.iat[i], float) for i in at])
            out.iloc[at] = label[(square[None, :] - 2 * x @ centre.T).argmin(1)].astype(object)
        return out

    rows = [(c, int(sizes[number == c][0]), (total[label == c].sum(0) / n[label == c].sum()).tolist()) for c in range(len(sizes))]
    return df.withColumn("cluster", nearest(F.col(vec).cast("array<double>"))), spark.createDataFrame(rows, schema)
