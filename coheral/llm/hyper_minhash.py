"""Operator 13, MinHash near-duplicates with HyperMinHash registers.

A document is its set of distinct word 4-grams (fewer words: the whole sequence as one).
A set's 64-bit gram hashes are dealt out over ``REGISTERS`` buckets; a bucket keeps its least hash
in 16 bits, its leading-zero count and the ``MANTISSA`` bits after them.  Empty registers are
filled from the first occupied one in a fixed order of their own (densification), so
that two sets agree in a register with the probability of their similarity, however small they
are.  Three registers make a band; sets with equal bands are candidates.

Equal sets are one class from the start.  Then two passes over the bands' buckets:

* stars: every set is held against its bucket's least set only, so that a bucket of
  any size costs as many pairs as it has sets; links found here make first components;
* the rest: only buckets that still hold several components.  All their pairs
  across components are estimated, in block pairs of bounded size, each pair in the first
  band it shares.  Within a component nothing is compared any more.  (Sets that are
  alike but under the threshold stay quadratic here, in the sets of one band's bucket.)

A candidate must pass the collision-corrected estimate C - E[collisions] over the registers
occupied in either set, with a margin of six standard deviations under the threshold, and is then
confirmed on both full sets of 64-bit gram hashes, which are only built for candidates (a bitmap of
``FILTER_BITS`` bits over their text keys spares most other texts the shuffle; a full one spares
none, with the same result).  A pair at the threshold misses all bands with odds of 3e-7.

Edge cases: null, empty and wordless texts have no shingles and are linked with nothing;
rows with a null id take part (a component's id is its least non-null id, null if it has
none; a row is kept if its id is that id, null counting as equal to null); repeated
rows are copies of each other; texts of any length are worked off whole; an empty table
gives no rows.  Only the key and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coheral.llm.common import cut, mix64, modest_batches, text_slices
from coheral.llm.components import components
from coheral.llm.words import shingle_sets
from coheral.session import checkpoint_dir

REGISTERS = 64
MANTISSA = 10
BAND = 3
BANDS = REGISTERS // BAND
LEVELS = 58  # leading-zero counts that 64 bits less the 6 of the bucket can have
CHUNK = 1 << 19
FILTER_BITS = 24
_ORDERS = np.argsort(mix64(np.arange(REGISTERS * REGISTERS, dtype=np.uint64), 31).reshape(REGISTERS, REGISTERS), axis=1)


def registers(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(registers as uint16, filled up; which were occupied) of non-empty sets, one row each."""
    least = np.full((len(sets), REGISTERS), 2**64 - 1, np.uint64)
    for i, s in enumerate(sets):
        h = mix64(s, 17)
        h.sort()
        bucket = (h >> np.uint64(58)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        least[i, bucket[first]] = h[first] << np.uint64(6)
    occupied = least != 2**64 - 1
    out = _compress(least)
    hit = occupied[:, _ORDERS]  # (set, register, place in the register's order)
    source = np.take_along_axis(_ORDERS[None].repeat(len(sets), 0), hit.argmax(2)[:, :, None], 2)[:, :, 0]
    filled = np.take_along_axis(out, source, 1)
    return np.where(occupied, out, filled), occupied


def _compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros plus one (upper bits) and the bits after the first one (lower ``MANTISSA`` bits)."""
    level = np.zeros(least.shape, np.uint64)
    x = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        zero = (x >> np.uint64(64 - step)) == 0
        level[zero] += np.uint64(step)
        x[zero] <<= np.uint64(step)
    level = np.minimum(level, np.uint64(LEVELS - 1))
    rest = (x << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (((level + np.uint64(1)) << np.uint64(MANTISSA)) | rest).astype(np.uint16)


def level_odds(size: np.ndarray) -> np.ndarray:
    """Odds that a set's least hash in a bucket has 0, 1, 2, ... leading zeros (sets x LEVELS)."""
    border = np.power(2.0, -np.arange(LEVELS + 1)) / REGISTERS
    free = np.exp(np.outer(size, np.log1p(-border)))  # nothing in the bucket below the border
    return free[:, 1:] - free[:, :-1]


class Sketches:
    """Registers of many sets, ready to be compared."""

    def __init__(self, dense: list[bytes], occupied: list[bytes], size: np.ndarray):
        self.dense = np.frombuffer(b"".join(dense), np.uint16).reshape(-1, REGISTERS)
        self.occupied = np.unpackbits(np.frombuffer(b"".join(occupied), np.uint8)).reshape(-1, REGISTERS).astype(bool)
        self.size = np.asarray(size, float)
        self.odds = level_odds(self.size)
        wide = self.dense[:, : BANDS * BAND].astype(np.uint64).reshape(-1, BANDS, BAND)
        self.bands = wide[:, :, 0] | (wide[:, :, 1] << np.uint64(16)) | (wide[:, :, 2] << np.uint64(32))

    def similarity(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Collision-corrected estimates of the Jaccard similarity of i[k] and j[k]."""
        both = self.occupied[i] & self.occupied[j]
        equal = ((self.dense[i] == self.dense[j]) & both).sum(1)
        either = (self.occupied[i] | self.occupied[j]).sum(1)
        chance = (self.odds[i] * self.odds[j]).sum(1) * REGISTERS / (1 << MANTISSA)
        return np.maximum(equal - chance, 0) / np.maximum(either, 1)

    def similarities(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same for all pairs of i and j."""
        equal = np.zeros((len(i), len(j)), np.uint8)
        left = np.where(self.occupied[i], self.dense[i], 0)
        right = np.where(self.occupied[j], self.dense[j], 1)  # real registers are 2**MANTISSA at least
        for k in range(REGISTERS):
            equal += left[:, k][:, None] == right[:, k][None, :]
        a, b = self.occupied[i].astype(float), self.occupied[j].astype(float)
        either = a.sum(1)[:, None] + b.sum(1)[None, :] - a @ b.T
        chance = self.odds[i] @ self.odds[j].T * REGISTERS / (1 << MANTISSA)
        return np.maximum(equal - chance, 0) / np.maximum(either, 1)

    def met_before(self, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
        """Whether i[k] and j[k] share a band before ``band``."""
        return (self.bands[i, :band] == self.bands[j, :band]).any(1)


def least_estimate(threshold: float) -> float:
    return threshold - 6 * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def _digest(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([mix64(s, 1).sum(), mix64(s, 2).sum()], np.uint64).tobytes()


def sketches(df: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, digest of the set, its size, registers, occupied); wordless texts have a null digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for lo, hi in text_slices(texts, CHUNK):
                sets = shingle_sets(texts[lo:hi], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                digest, dense, occupied = ([None] * (hi - lo) for _ in range(3))
                if full:
                    for i, row, mask in zip(full, *registers([sets[i] for i in full])):
                        digest[i], dense[i], occupied[i] = _digest(sets[i]), row.tobytes(), np.packbits(mask).tobytes()
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi], "text_key": b["text_key"].iloc[lo:hi], "digest": digest,
                                    "size": [len(s) for s in sets], "dense": dense, "occupied": occupied})

    return df.select("doc_id", "text", F.md5("text").alias("text_key")).mapInPandas(
        run, "doc_id bigint, text_key string, digest binary, size bigint, dense binary, occupied binary")


def band_buckets(classes: DataFrame) -> DataFrame:
    """(no, band, key, pivot): the buckets of two sets or more that a set is in, by hash of the band's registers; the pivot is the least set."""
    keys = [F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("dense", b * BAND * 2 + 1, BAND * 2)).alias("key"))
            for b in range(BANDS)]
    rows = classes.select("no", F.explode(F.array(*keys)).alias("b")).select("no", "b.*")
    shared = rows.groupBy("key").agg(F.min("no").alias("pivot"), F.max("no").alias("last")).filter("pivot <> last")
    return cut(rows.join(shared.select("key", "pivot"), "key"))


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: unlike a checkpoint its size is known to the planner."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/hyper-minhash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _likely(wanted: DataFrame):
    """Column that is true for every wanted text key and for few others: a bitmap of ``FILTER_BITS`` bits, whatever the input."""
    slot = lambda key: F.conv(F.substring(key, 1, FILTER_BITS // 4), 16, 10).cast("int")
    words = wanted.select(slot("first_key").alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, s & 31)")).alias("bits")).collect()
    bitmap = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for r in words:
        bitmap[r["w"]] = r["bits"]

    @F.pandas_udf("boolean")
    def test(slots: pd.Series) -> pd.Series:
        s = slots.fillna(0).to_numpy(np.int64)
        return pd.Series(((bitmap[s >> 5] >> (s & 31).astype(np.uint32)) & 1).astype(bool))

    return test(slot("text_key"))


def exact_sets(df: DataFrame, classes: DataFrame, numbers: DataFrame, width: int) -> DataFrame:
    """(no, grams as bytes) of the given classes, written; each from one text that has the set."""
    wanted = _written(classes.join(numbers.distinct(), "no", "left_semi").select(
        "no", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, no = list(b["text"]), b["no"].to_numpy()
            for lo, hi in text_slices(texts, CHUNK):
                yield pd.DataFrame({"no": no[lo:hi], "grams": [s.tobytes() for s in shingle_sets(texts[lo:hi], width)]})

    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    texts = df.select("doc_id", "text", F.md5("text").alias("text_key")).filter(_likely(wanted)).join(wanted, same).select("no", "text")
    return cut(texts.mapInPandas(run, "no bigint, grams binary").dropDuplicates(["no"]))


def _similar(s: np.ndarray, t: np.ndarray, threshold: float) -> bool:
    """Whether two sorted arrays of distinct hashes have a Jaccard similarity of ``threshold`` or more."""
    if len(s) > len(t):
        s, t = t, s
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    both = int(np.count_nonzero(t[at] == s))
    # whole percent thresholds are compared in integers
    return both * 100 >= round(threshold * 100) * (len(s) + len(t) - both)


def _size_fits(a: str, b: str, threshold: float):
    return F.least(a, b) * 100 >= F.greatest(a, b) * round(threshold * 100)


def star_links(df: DataFrame, classes: DataFrame, rows: DataFrame, threshold: float, width: int, group: int, parts: int) -> DataFrame:
    """(a, b) links between sets and the least set of a bucket they are in."""
    sketch = classes.select("no", "size", "dense", "occupied")
    pairs = (rows.filter("no <> pivot").select("no", "pivot").distinct().join(sketch, "no")
             .join(sketch.select(F.col("no").alias("pivot"), F.col("size").alias("size2"), F.col("dense").alias("dense2"),
                                 F.col("occupied").alias("occupied2")), "pivot").filter(_size_fits("size", "size2", threshold)))

    def estimated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = len(b)
            if n:
                both = Sketches([*b["dense"], *b["dense2"]], [*b["occupied"], *b["occupied2"]], np.concatenate((b["size"], b["size2"])))
                good = both.similarity(np.arange(n), np.arange(n, 2 * n)) >= least_estimate(threshold)
                yield b.loc[good, ["no", "pivot"]]

    pairs = cut(pairs.mapInPandas(estimated, "no bigint, pivot bigint"))
    sets = exact_sets(df, classes, pairs.select("no").unionByName(pairs.select(F.col("pivot").alias("no"))), width)
    # a pivot's candidates in groups, each with a copy of the pivot in front
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / group).alias("groups"))
    dealt = pairs.join(sizes, "pivot").select("no", "pivot", F.pmod(F.xxhash64("no"), F.col("groups")).alias("salt"))
    members = dealt.join(sets, "no").select("pivot", "salt", F.lit(1).alias("side"), "no", "grams")
    heads = dealt.select("pivot", "salt").distinct().join(sets.withColumnRenamed("no", "pivot"), "pivot").select(
        "pivot", "salt", F.lit(0).alias("side"), F.col("pivot").alias("no"), "grams")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = None
        for b in batches:
            out = []
            for pivot, side, no, grams in zip(b["pivot"], b["side"], b["no"], b["grams"]):
                s = np.frombuffer(grams, np.uint64)
                if side == 0:
                    head = s
                elif _similar(head, s, threshold):
                    out.append((no, pivot))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    both = members.unionByName(heads).repartition(parts, "pivot", "salt").sortWithinPartitions("pivot", "salt", "side")
    return cut(both.mapInPandas(confirm, "a bigint, b bigint"))


GROUP = ["key", "lo", "hi"]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of one block pair, across batch borders."""
    held: list[pd.DataFrame] = []
    for b in batches:
        keys = b[GROUP].to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(b)])) if len(b) else [0]
        for lo, hi in zip(starts[:-1], starts[1:]):
            part = b.iloc[lo:hi]
            if held and (held[-1][GROUP].iloc[-1].to_numpy() != part[GROUP].iloc[0].to_numpy()).any():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _tiles(own: np.ndarray, cross: bool, tile: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index ranges whose pairs cover a block pair; the block with itself gives each pair twice."""
    sides = [np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())] if cross else [np.arange(len(own))] * 2
    if cross and own.min() == own.max():
        return
    for a in range(0, len(sides[0]), tile):
        for b in range(0 if cross else a, len(sides[1]), tile):
            yield sides[0][a:a + tile], sides[1][b:b + tile]


def _candidates(g: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a block pair that are of several components, alike by estimate, and not met in an earlier band."""
    sketch = Sketches(list(g["dense"]), list(g["occupied"]), g["size"].to_numpy())
    root, band = g["root"].to_numpy(), int(g["band"].iloc[0])
    for i, j in _tiles(g["own"].to_numpy(), bool(g["lo"].iloc[0] != g["hi"].iloc[0])):
        a, b = sketch.size[i][:, None], sketch.size[j][None, :]
        ok = (root[i][:, None] != root[j][None, :]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * round(threshold * 100))
        if i[0] == j[0]:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        if ok.any():
            ok &= sketch.similarities(i, j) >= least_estimate(threshold)
            x, y = np.nonzero(ok)
            new = ~sketch.met_before(i[x], j[y], band)
            if new.any():
                yield i[x[new]], j[y[new]]


def _screen(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            use = np.zeros(len(g), bool)
            for i, j in _candidates(g, threshold):
                use[i] = use[j] = True
            if use.any():
                yield g.loc[use, ["no", "band", "root", "own", *GROUP]]
    return run


def _confirm(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            sets = [np.frombuffer(x, np.uint64) for x in g["grams"]]
            no, root = g["no"].tolist(), g["root"].tolist()
            parent = {r: r for r in root}

            def find(v: int) -> int:
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            out = []
            for i, j in _candidates(g, threshold):
                for x, y in zip(i.tolist(), j.tolist()):
                    r, s = find(root[x]), find(root[y])
                    if r != s and _similar(sets[x], sets[y], threshold):  # one link joins two components
                        parent[r] = s
                        out.append((no[x], no[y]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
    return run


def rest_links(df: DataFrame, classes: DataFrame, rows: DataFrame, roots: DataFrame, threshold: float, width: int,
               block: int, parts: int) -> DataFrame:
    """(a, b) links that join the given components, from the buckets that hold several of them."""
    labelled = rows.drop("pivot").join(roots, "no", "left").withColumn("root", F.coalesce("root", "no"))
    open_ = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).filter("r0 <> r1")
    members = labelled.join(open_.select("key", "n"), "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("no", F.lit(5)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda o: F.struct(F.least("own", o).alias("lo"), F.greatest("own", o).alias("hi")))
    placed = members.select("no", "band", "root", "own", "key", F.explode(pairs).alias("p")).select("no", "band", "root", "own", "key", "p.*")
    sketch = classes.select("no", "size", "dense", "occupied")

    def grouped(x: DataFrame) -> DataFrame:
        return x.join(sketch, "no").repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "no")

    wanted = cut(grouped(placed).mapInPandas(
        _screen(threshold), "no bigint, band int, root bigint, own int, key bigint, lo int, hi int"))
    sets = exact_sets(df, classes, wanted.select("no"), width)
    return cut(grouped(wanted.join(sets, "no")).mapInPandas(_confirm(threshold), "a bigint, b bigint"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 4,
                    group: int = 64, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; ``threshold`` is in whole percent."""
    spark = df.sparkSession
    modest_batches(spark)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = cut(sketches(df, width))
    classes = docs.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("doc_id").alias("first_id"), F.first("size").alias("size"),
        F.first("dense").alias("dense"), F.first("occupied").alias("occupied"))
    classes = cut(classes.withColumn("no", F.monotonically_increasing_id()))  # written, so the numbers stay
    rows = band_buckets(classes)
    stars = star_links(df, classes, rows, threshold, width, group, parts)
    roots = components(stars).select(F.col("node").alias("no"), "root")
    rest = rest_links(df, classes, rows, roots, threshold, width, block, parts)
    roots = components(stars.unionByName(rest)).select(F.col("node").alias("no"), "root")
    named = classes.select("digest", "no", "first_id").join(roots, "no", "left").withColumn("root", F.coalesce("root", "no"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_class = named.join(least, "root").select(F.col("digest").alias("set"), "component_id")
    found = docs.join(per_class, F.col("digest") == F.col("set"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))
