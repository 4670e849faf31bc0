"""Operator 2, approximate nearest neighbours: forest of random-projection trees.

Nearness is the largest inner product.  Vectors get one more coordinate that makes all
lengths equal (queries get 0 there), so the nearest by inner product is the nearest by
angle and trees can split by projections.  Each tree node splits at the median of the
projections on the difference of two of its points.  The trees are fitted on a
bounded sample (``sample_rows``, default 16,384 rows by hash of the id); every row is
then indexed in every tree.  A query walks all trees through one shared priority
queue (priority: the least margin on the way) until it has popped ``probes`` leaves;
candidates of these leaves are reranked by the exact inner product in double
precision.  ``probes`` is taken from the sample: the number of pops that reaches
``recall`` of the sample's exact neighbours.

Leaves are cut into blocks of at most ``block`` vectors, so a vector with very many
copies spreads over tasks; queries stream past a block and are never gathered.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do those whose length differs from the most frequent one (the
smaller, on a tie); null ids take no part; rows repeating an id count as one
candidate; ties go to the smaller id; fewer rows than asked for give them all, as
small tables are one leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from coheral.llm.common import cut, modest_batches


@dataclass
class Forest:
    """Complete binary trees as arrays: node k has children 2k+1 and 2k+2."""

    dirs: np.ndarray    # trees x nodes x (dim + 1)
    cuts: np.ndarray    # trees x nodes
    depth: int
    longest: float      # greatest squared length of a vector
    probes: int = 1

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.longest - (vectors * vectors).sum(1))
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf number of every vector in every tree (n x trees)."""
        x = self.lift(vectors)
        out = np.zeros((len(x), len(self.dirs)), np.int32)
        for t in range(len(self.dirs)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.dirs[t][node]) > self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - (self.leaves - 1)
        return out

    def search(self, queries: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
        """The first ``probes`` (tree, leaf) each query pops from the queue shared by all trees."""
        inner = self.leaves - 1
        q = np.hstack([queries, np.zeros((len(queries), 1))])
        q = q / np.sqrt((q * q).sum(1))[:, None] * np.sqrt(max(self.longest, 1e-300))
        trees, out = len(self.dirs), []
        margin = (q @ self.dirs.reshape(trees * inner, -1).T - self.cuts.reshape(-1)) if inner else np.zeros((len(q), 0))
        for row in margin:
            queue = [(-np.inf, t, 0) for t in range(trees)]
            found: list[tuple[int, int]] = []
            values = row.tolist()
            while queue and len(found) < probes:
                p, t, node = heapq.heappop(queue)
                if node >= inner:
                    found.append((t, node - inner))
                    continue
                m = values[t * inner + node]
                heapq.heappush(queue, (max(p, m), t, 2 * node + 1))
                heapq.heappush(queue, (max(p, -m), t, 2 * node + 2))
            out.append(found)
        return out


def truncated(f: Forest, depth: int) -> Forest:
    """The forest with every tree cut at ``depth``."""
    inner = (1 << depth) - 1
    return Forest(f.dirs[:, :inner], f.cuts[:, :inner], depth, f.longest)


def grow(sample: np.ndarray, longest: float, trees: int, depth: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    f = Forest(np.zeros((trees, inner, sample.shape[1] + 1)), np.zeros((trees, inner)), depth, longest)
    x = f.lift(sample)
    for t in range(trees):
        members = {0: np.arange(len(x))}
        for node in range(inner):
            own = members.pop(node)
            d = np.zeros(x.shape[1])
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                d = x[a] - x[b]
            if not d.any():
                d = rng.standard_normal(x.shape[1])
            d /= np.sqrt(d @ d)
            p = x[own] @ d
            at = float(np.median(p)) if len(own) else 0.0
            f.dirs[t, node], f.cuts[t, node] = d, at
            members[2 * node + 1], members[2 * node + 2] = own[p <= at], own[p > at]
    return f


def _probes_for(f: Forest, sample: np.ndarray, k: int, recall: float, tests: int = 128) -> int:
    """Pops after which ``recall`` of the exact neighbours (within the sample) of test rows are in a popped leaf."""
    all_leaves = len(f.dirs) * f.leaves
    rows = np.arange(0, len(sample), max(1, len(sample) // tests))
    own = f.leaf_of(sample)
    score = sample[rows] @ sample.T
    score[np.arange(len(rows)), rows] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
    needed = []
    for i, popped in enumerate(f.search(sample[rows], all_leaves)):
        order = np.empty((len(f.dirs), f.leaves), np.int64)
        t, leaf = np.array(popped).T
        order[t, leaf] = np.arange(1, all_leaves + 1)
        needed.append(order[np.arange(len(f.dirs)), own[near[i]]].min(1))
    return int(np.ceil(np.quantile(np.concatenate(needed), recall))) if needed else 1


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.filter(F.size("v") == (dim["dim"] if dim else 0))


def fit(rows: DataFrame, k: int, trees: int, leaf_size: int, sample_rows: int, recall: float, most_probes: int, seed: int) -> Forest | None:
    """Grow on the sample; the depth is the greatest one that reaches ``recall`` with at most ``most_probes`` leaves.

    Clustered vectors get deep trees and few candidates; where there is no structure to use, leaves
    are few and large, and a query still sends back ``k`` rows from ``most_probes`` leaves at most.
    """
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    if not stats["n"]:
        return None
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample_rows).collect()
    sample = np.array([r["v"] for r in picked], float)
    depth = 0
    while stats["n"] >> depth > leaf_size and len(sample) >> depth > 32:
        depth += 1
    whole = grow(sample, stats["longest"], trees if depth else 1, depth, seed)
    for d in range(depth, 0, -1):
        f = truncated(whole, d)
        f.probes = _probes_for(f, sample, k, recall)
        if f.probes <= most_probes:
            return f
    f = truncated(whole, 0)
    f.dirs, f.cuts = f.dirs[:1], f.cuts[:1]  # one leaf: one tree has all rows
    return f


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def nearest(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = 10,
            leaf_size: int = 400, sample_rows: int = 16384, recall: float = 0.96,
            most_probes: int = 40, block: int = 4096, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that ``is_query`` (a Column over vec_id)."""
    spark = df.sparkSession
    modest_batches(spark)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = usable(df, key, vector)
    forest = fit(rows, k, trees, leaf_size, sample_rows, recall, most_probes, seed)
    if forest is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    shared = spark.sparkContext.broadcast(forest)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.iloc[lo:lo + 1024]
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "leaves": list(f.leaf_of(_matrix(part["v"])))})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo:lo + 256]
                found = f.search(_matrix(part["v"]), f.probes)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "leaves": [
                    np.array([t * f.leaves + x for t, x in own], np.int32) for own in found]})

    def leaf_rows(fn, source: DataFrame) -> DataFrame:
        """(vec_id, place): place numbers the leaf over all trees."""
        return source.mapInPandas(fn, "vec_id bigint, leaves array<int>")

    one_each = rows.dropDuplicates(["vec_id"])
    indexed = cut(leaf_rows(index, one_each).select("vec_id", F.posexplode("leaves").alias("tree", "leaf"))
                  .select("vec_id", (F.col("tree") * forest.leaves + F.col("leaf")).alias("place")))
    sizes = cut(indexed.groupBy("place").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))  # a row per leaf
    mine = (indexed.join(sizes, "place").select("vec_id", "place", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("part"))
            .withColumn("kind", F.lit(0)))
    asked = (leaf_rows(probe, one_each.filter(is_query)).select("vec_id", F.explode("leaves").alias("place"))
             .join(sizes, "place").select("vec_id", "place", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
             .withColumn("kind", F.lit(1)))
    meeting = (mine.unionByName(asked).join(one_each, "vec_id")
               .repartition(parts, "place", "part").sortWithinPartitions("place", "part", "kind", "vec_id"))
    best = meeting.mapInPandas(_rerank(k), "query_id bigint, vec_id bigint, score double")
    # a query gets k rows at most from each block of the leaves it popped
    top = (best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))
           .select("query_id", F.posexplode("top").alias("pos", "t")))
    return top.select("query_id", (F.col("pos") + 1).alias("rank"), "t.vec_id", (-F.col("t.s")).alias("score"))


def _rerank(k: int):
    """Rows sorted by (place, part, kind): vectors of a block first, then the queries that stream past it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, held, ready = None, [], [], None
        for b in batches:
            place, kind = b[["place", "part"]].to_numpy(), b["kind"].to_numpy()
            vec, own = _matrix(b["v"]), b["vec_id"].to_numpy()
            key = np.column_stack([place, kind])
            cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(b)]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                where = tuple(place[lo])
                if where != at:
                    at, ids, held, ready = where, [], [], None
                if kind[lo] == 0:
                    ids.append(own[lo:hi])
                    held.append(vec[lo:hi])
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = np.concatenate(ids), np.concatenate(held)
                for a in range(lo, hi, 256):
                    out = _top(own[a:min(a + 256, hi)], vec[a:min(a + 256, hi)], *ready, k)
                    if len(out):
                        yield out
    return run


def _top(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a block for each query, by the exact product (ties: smaller id)."""
    rough = q @ x.T
    rough[qid[:, None] == ids[None, :]] = -np.inf
    keep = min(k, len(ids)) - 1
    level = -np.partition(-rough, keep, axis=1)[:, keep]
    slack = 1e-9 * (1 + np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max()))
    i, j = np.nonzero(rough >= np.where(np.isfinite(level), level - slack, -np.finfo(float).max)[:, None])
    score = (q[i] * x[j]).sum(1)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, np.arange(len(q)))
    good = np.arange(len(i)) - first[i] < k
    return pd.DataFrame({"query_id": qid[i[good]], "vec_id": ids[j[good]], "score": score[good]})
