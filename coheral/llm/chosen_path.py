"""Operator 8, n-gram Jaccard join: chosen-path recursion.

Documents are sets of word 5-grams.  Equal sets are one class from the start.  Each
class is embedded into ``POSITIONS`` min-hash tokens, whose agreement is its Jaccard
similarity.  A run picks one token at the root; sets that share it form a bucket.
Buckets of more than ``split_above`` sets are split again on ``BRANCH`` tokens chosen by
the bucket's path (so all its sets choose the same), down to ``depth`` levels.  What is
left is compared by brute force, in block pairs of bounded size where a bucket is
still large (near copies share all tokens and can't be split).  Runs are repeated
until a pair at the threshold is met with the target recall: a run without splits
misses it with probability 1 - threshold.

A pair that meets in several buckets is counted in the first one both sets are in, so
no pairs are shuffled to be deduplicated.  Comparing first looks at the tokens (a pair
with under half of them in common can't be at 0.8 but with odds of one in ten
million), then at the exact sets, which are only built for classes with a candidate.

Result: one row per document with its class (least doc_id of its component of links)
and its number of links, copies included; weights stand for copies.

Edge cases: null or wordless texts and rows with a null id have no links and are
classes of their own (class_id = doc_id); texts of one to four words are one shorter
gram; repeated rows link like other copies; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.llm.common import cut, mix64, modest_batches, text_slices
from coheral.llm.components import components
from coheral.llm.words import shingle_sets

POSITIONS = 48
BRANCH = 3
CHUNK = 1 << 19
_FACTORS = mix64(np.arange(POSITIONS, dtype=np.uint64), 99) | np.uint64(1)


def embed(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash tokens (sets x POSITIONS, uint64) of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), POSITIONS), np.uint64)
    for k in range(POSITIONS):
        out[:, k] = np.minimum.reduceat(flat * _FACTORS[k], at)
    return out


def _digest(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return (np.array([mix64(s, 1).sum(), mix64(s, 2).sum()], np.uint64)).tobytes()


def sketches(df: DataFrame, key: str, text: str, width: int, kind: str = "bigint") -> DataFrame:
    """(doc_id, digest of the set, its size, tokens as bytes); wordless texts have a null digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for lo, hi in text_slices(texts, CHUNK):
                sets = shingle_sets(texts[lo:hi], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                digest, tokens = [None] * (hi - lo), [None] * (hi - lo)
                if full:
                    rows = embed([sets[i] for i in full])
                    for i, row in zip(full, rows):
                        digest[i], tokens[i] = _digest(sets[i]), row.tobytes()
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi].to_numpy(), "digest": digest,
                                    "size": [len(s) for s in sets], "tokens": tokens})

    return (df.select(F.col(key).cast(kind).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
            .mapInPandas(run, f"doc_id {kind}, digest binary, size bigint, tokens binary"))


def buckets(classes: DataFrame, runs: int, depth: int, split_above: int) -> DataFrame:
    """(digest, slot, bucket): leaves of the recursion with two sets or more; a slot numbers (run, branches taken).

    Only sets in buckets that are split again are joined with their tokens.
    """
    per_run = BRANCH ** depth
    token = lambda at: F.substr("tokens", at * 8 + 1, F.lit(8))
    root = F.array(*[F.struct(F.lit(r * per_run).alias("slot"), F.xxhash64(F.lit(r), token(F.lit(r * 7 % POSITIONS))).alias("bucket"))
                     for r in range(runs)])
    rows = classes.select("digest", F.explode(root).alias("b")).select("digest", "b.*")
    done = None
    for level in range(depth + 1):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        rows = cut(rows.join(sizes, "bucket"))  # sets alone in a bucket are done with it
        large = rows.filter(F.col("n") > split_above)
        if level == depth or large.isEmpty():
            rows = rows.drop("n")
            return rows if done is None else done.unionByName(rows)
        small = rows.filter(F.col("n") <= split_above).drop("n")
        done = small if done is None else done.unionByName(small)
        step = per_run // BRANCH ** (level + 1)
        position = lambda c: F.pmod(F.xxhash64("bucket", F.lit(c)), F.lit(POSITIONS)).cast("int")
        children = F.array(*[F.struct((F.col("slot") + step * c).cast("int").alias("slot"), F.xxhash64(
            "bucket", F.lit(c), token(position(c))).alias("bucket")) for c in range(BRANCH)])
        rows = (large.join(classes.select("digest", "tokens"), "digest").select("digest", F.explode(children).alias("b"))
                .select("digest", "b.*"))
    return rows


def block_pairs(leaves: DataFrame, block: int) -> DataFrame:
    """(digest, slot, bucket, lo, hi, side): every set once per pair of blocks its block is in."""
    sizes = leaves.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    rows = leaves.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("digest", F.lit(5)), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("own", o).alias("lo"), F.greatest("own", o).alias("hi")))
    return rows.select("digest", "slot", "bucket", "own", F.explode(pairs).alias("p")).select("digest", "slot", "bucket", "own", "p.*")


GROUP = ["bucket", "lo", "hi"]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with one (bucket, lo, hi), across batch borders."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        keys = b[GROUP].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for lo, hi in zip(np.concatenate(([0], cuts[:-1])) if len(cuts) else [], cuts):
            yield b.iloc[lo:hi]
        rest = b.iloc[cuts[-1]:] if len(cuts) else b
    if rest is not None and len(rest):
        yield rest


class _Group:
    """Sets of one block pair; tells which pairs are candidates that no earlier bucket holds."""

    def __init__(self, g: pd.DataFrame, threshold: float):
        self.tokens = np.frombuffer(b"".join(g["tokens"]), np.uint64).reshape(len(g), POSITIONS)
        self.short = (mix64(self.tokens, 3) & np.uint64(255)).astype(np.uint8)
        self.size = g["size"].to_numpy(float)
        self.leaves = np.frombuffer(b"".join(g["leaves"]), np.int64).reshape(len(g), -1)
        self.slot = int(g["slot"].iloc[0])
        self.own = g["own"].to_numpy()
        self.cross = bool(g["lo"].iloc[0] != g["hi"].iloc[0])
        self.threshold = threshold

    def tiles(self, tile: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(self.size)
        if self.cross:
            left, right = np.flatnonzero(self.own == self.own.min()), np.flatnonzero(self.own == self.own.max())
            if self.own.min() == self.own.max():
                return
            for a in range(0, len(left), tile):
                for b in range(0, len(right), tile):
                    yield left[a:a + tile], right[b:b + tile]
        else:
            for a in range(0, n, tile):
                for b in range(a, n, tile):
                    yield np.arange(a, min(a + tile, n)), np.arange(b, min(b + tile, n))

    def candidates(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Boolean tile: worth comparing, met here first, each pair once."""
        a, b = self.size[i][:, None], self.size[j][None, :]
        ok = np.minimum(a, b) >= self.threshold * np.maximum(a, b)
        if i[0] == j[0]:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        if not ok.any():
            return ok
        if len(i) * len(j) <= 64:
            x, y = np.nonzero(ok)
            same = (self.short[i[x]] == self.short[j[y]]).sum(1) * 2 >= POSITIONS
            same &= ~((self.leaves[i[x], : self.slot] == self.leaves[j[y], : self.slot]) & (self.leaves[i[x], : self.slot] != 0)).any(1)
            out = np.zeros(ok.shape, bool)
            out[x[same], y[same]] = True
            return out
        equal = np.zeros(ok.shape, np.uint8)
        for k in range(POSITIONS):
            equal += self.short[i, k][:, None] == self.short[j, k][None, :]
        ok &= equal * np.uint8(2) >= POSITIONS
        for s in range(self.slot):
            if not ok.any():
                break
            mine = self.leaves[i, s]
            if mine.any():
                ok &= (mine[:, None] != self.leaves[j, s][None, :]) | (mine == 0)[:, None]
        return ok


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the candidate pairs of a tile."""
    x, y = np.nonzero(ok)
    out = np.zeros(ok.shape)
    if len(x) < 512:
        for p, q in zip(x, y):
            s, t = sets[i[p]], sets[j[q]]
            if len(s) > len(t):
                s, t = t, s
            at = np.searchsorted(t, s)
            out[p, q] = np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s)
        return out
    # grams of both sides by number; those of one side only don't matter
    left, right = np.concatenate([sets[p] for p in i]), np.concatenate([sets[q] for q in j])
    grams = np.intersect1d(left, right)
    rows_l, rows_r = np.repeat(np.arange(len(i)), [len(sets[p]) for p in i]), np.repeat(np.arange(len(j)), [len(sets[q]) for q in j])
    for lo in range(0, len(grams), 4096):
        part = grams[lo:lo + 4096]
        a, b = np.zeros((len(i), len(part)), np.float32), np.zeros((len(j), len(part)), np.float32)
        for m, rows, values in ((a, rows_l, left), (b, rows_r, right)):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            m[rows[hit], at[hit]] = 1
        out += a @ b.T
    return out


def _worth_comparing(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = []
        for g in _groups(batches):
            group, use = _Group(g, threshold), np.zeros(len(g), bool)
            for i, j in group.tiles():
                ok = group.candidates(i, j)
                use[i[ok.any(1)]] = True
                use[j[ok.any(0)]] = True
            if use.any():
                kept.append(g.loc[use, ["digest", "slot", *GROUP, "own"]])
            if len(kept) >= 256:
                yield pd.concat(kept)
                kept = []
        if kept:
            yield pd.concat(kept)
    return run


def _compare(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            group = _Group(g, threshold)
            sets = [np.frombuffer(s, np.uint64) for s in g["grams"]]
            weight = g["copies"].to_numpy(float)
            links = np.zeros(len(g))
            parent = np.arange(len(g))

            def root(v: int) -> int:
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            for i, j in group.tiles():
                ok = group.candidates(i, j)
                if not ok.any():
                    continue
                both = _common(sets, i, j, ok)
                union = group.size[i][:, None] + group.size[j][None, :] - both
                ok &= both >= threshold * union
                links[i] += ok @ weight[j]
                links[j] += ok.T @ weight[i]
                # one spanning link per row and column is enough for the classes
                for p in np.flatnonzero(ok.any(1)):
                    for q in np.flatnonzero(ok[p]):
                        r, s = root(i[p]), root(j[q])
                        if r != s:
                            parent[max(r, s)] = min(r, s)
            hit = np.flatnonzero(links > 0)
            if len(hit):
                digests = list(g["digest"])
                yield pd.DataFrame({"digest": [digests[v] for v in hit], "links": links[hit].astype(np.int64),
                                    "other": [digests[root(v)] for v in hit]})
    return run


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5,
                 recall: float = 0.9999, depth: int = 2, split_above: int = 1024, block: int = 2048,
                 kind: str = "bigint") -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies (documents with the same set, itself included).

    ``kind`` is the type of the ids.
    """
    spark = df.sparkSession
    modest_batches(spark)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))
    docs = cut(sketches(df, key, text, width, kind))
    classes = cut(docs.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("tokens").alias("tokens")))
    leaves = cut(buckets(classes, runs, depth, split_above))
    slots = runs * BRANCH ** depth
    # a set's leaves by slot (0: none there) go along with it, so that a pair knows its first common bucket
    by_slot = leaves.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bucket"))).alias("m"))
    pack = _pack_leaves(slots)
    known = cut(classes.join(by_slot, "digest").select("digest", "copies", "first_id", "size", "tokens", pack("m").alias("leaves")))
    placed = cut(block_pairs(leaves, block))

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "digest")

    first = placed.join(known.select("digest", "size", "tokens", "leaves"), "digest")
    wanted = cut(grouped(first).mapInPandas(_worth_comparing(threshold),
                                            "digest binary, slot int, bucket bigint, lo int, hi int, own int"))
    need = known.join(wanted.select("digest").distinct(), "digest", "left_semi")
    grams = exact_sets(df, need.select("first_id", F.col("digest").alias("want")), key, text, width, kind)
    second = wanted.join(known.join(grams, "digest"), "digest")
    found = cut(grouped(second).mapInPandas(_compare(threshold), "digest binary, links bigint, other binary"))
    linked = found.groupBy("digest").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("digest").alias("a"), F.col("other").alias("b")))
    roots = (classes.select("digest", "copies", "first_id").join(linked, "digest", "left").join(
        comp.select(F.col("node").alias("digest"), "root"), "digest", "left")
        .withColumn("root", F.coalesce("root", "digest")))
    least = roots.groupBy("root").agg(F.min("first_id").alias("class_id"))
    per_class = roots.join(least, "root").select(
        "digest", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = docs.join(per_class, "digest", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))
    nulls = df.filter(F.col(key).isNull()).select(
        F.col(key).cast(kind).alias("doc_id"), F.lit(None).cast(kind).alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("n_copies"))
    return alone.unionByName(nulls)


def _pack_leaves(slots: int):
    @F.pandas_udf("binary")
    def pack(maps: pd.Series) -> pd.Series:
        out = []
        for m in maps:
            row = np.zeros(slots, np.int64)
            for s, b in (m.items() if isinstance(m, dict) else m):
                row[s] = b
            out.append(row.tobytes())
        return pd.Series(out)
    return pack


def exact_sets(df: DataFrame, wanted: DataFrame, key: str, text: str, width: int, kind: str = "bigint") -> DataFrame:
    """(digest, grams as bytes) of the wanted classes, each from its document with the least id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, want = list(b["text"]), list(b["want"])
            for lo, hi in text_slices(texts, CHUNK):
                sets = shingle_sets(texts[lo:hi], width)
                own = [(w, s.tobytes()) for w, s in zip(want[lo:hi], sets) if _digest(s) == w]
                if own:
                    yield pd.DataFrame(own, columns=["digest", "grams"])

    rows = df.select(F.col(key).cast(kind).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    return (rows.join(wanted, F.col("doc_id") == F.col("first_id")).select("want", "text")
            .mapInPandas(run, "digest binary, grams binary").dropDuplicates(["digest"]))
