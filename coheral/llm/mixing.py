"""Operator 3, mixing sources to target weights: multivariate-hypergeometric splitting tree.

Native: DataFrame and SQL functions only.  Every text is cut into blocks of at most
``block_words`` words.  A source's target in words becomes an exact quota of blocks:
full passes over all its blocks, then the prefix of its permuted blocks that holds the
remaining words (of the last block only the words still wanted).  A binary tree over the output shards divides the quotas: at
each node the left half's share of every source is one draw from the multivariate
hypergeometric distribution (sequential univariate draws by inverse CDF), so the
shards' composition is that of dealing out all blocks at random while each draw
only touches a node's quota vector.  Each shard then owns a disjoint range of every
source's permuted blocks, and a random key orders it locally.

The permutation is the order of md5(doc, copy, block, seed).  Ranks and prefix sums are
taken in two levels (bucket of the hash, then inside the bucket), so a source that
holds a third of all rows spreads over ``16 ** bucket_digits`` windows.

Edge cases: null text has size 0 and takes nothing; a null source is a source of its
own, sorted last; null ids and repeated rows are kept apart by a copy number; an empty
table gives no rows.  A source's rank and target use windows over one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from coheral.llm.common import SPACE_WORD, cut

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3


def document_sizes(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size in words, copy number among rows with the same id)."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                     F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"))
    same_id = W.Window.partitionBy("doc_id").orderBy("source", "size")
    return rows.withColumn("copy", F.row_number().over(same_id))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target): weighted shares of all words, none above ``cap`` times its source.

    Capping and resharing until nothing is above ends where target = min(cap * size, level * weight)
    with one common level; it is read off the sources sorted by the level at which each is full.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = total.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * cap).alias("most"))
    order = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = W.Window.orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    after = W.Window.orderBy(*order).rowsBetween(0, W.Window.unboundedFollowing)
    level = ((F.sum("source_size").over(W.Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0)))
             / F.sum("weight").over(after))
    s = s.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    s = s.withColumn("level", F.first(fits, ignorenulls=True).over(
        W.Window.orderBy(*order).rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)))
    return s.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Inverse-CDF draw of the number of marked items among ``draws`` from ``population``.

    The probabilities are walked upwards from ten standard deviations below the mean, by
    the ratio of neighbouring terms; what lies outside has a mass below double precision.
    """
    def bind(rows: Column, **more) -> Column:
        """Give each value a name once: what follows refers to it instead of repeating its expression."""
        return F.transform(rows, lambda a: F.struct(a["R"].alias("R"), a["K"].alias("K"), a["n"].alias("n"), a["u"].alias("u"),
                                                    *[f(a).alias(name) for name, f in more.items()]))

    def ratio(a: Column, x: Column) -> Column:
        return (a["K"] - x) * (a["n"] - x) / ((x + 1) * (a["R"] - a["K"] - a["n"] + x + 1))

    def total(a: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(F.sequence(a["lo"], a["hi"]), start, lambda t, x: F.struct(
            F.when(x < a["hi"], t["w"] * ratio(a, x)).otherwise(F.lit(0.0)).alias("w"), (t["sum"] + t["w"]).alias("sum")),
            lambda t: t["sum"])

    def pick(a: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), a["lo"].alias("at"))
        return F.aggregate(F.sequence(a["lo"], a["hi"]), start, lambda t, x: F.struct(
            F.when(x < a["hi"], t["w"] * ratio(a, x)).otherwise(F.lit(0.0)).alias("w"), (t["sum"] + t["w"]).alias("sum"),
            F.when((x > a["lo"]) & (t["sum"] < a["goal"]), x).otherwise(t["at"]).alias("at")), lambda t: t["at"])

    given = F.array(F.struct(population.cast("double").alias("R"), marked.cast("double").alias("K"), draws.cast("double").alias("n"), u.alias("u")))
    spread = bind(given, mean=lambda a: a["n"] * a["K"] / a["R"], sd=lambda a: F.sqrt(F.greatest(
        F.lit(0.0), a["n"] * a["K"] / a["R"] * (1 - a["K"] / a["R"]) * (a["R"] - a["n"]) / F.greatest(a["R"] - 1, F.lit(1.0)))))
    ends = bind(spread,
                lo=lambda a: F.greatest(F.lit(0.0), a["n"] + a["K"] - a["R"], F.floor(a["mean"] - 10 * a["sd"] - 10).cast("double")).cast("long"),
                hi=lambda a: F.least(a["n"], a["K"], F.ceil(a["mean"] + 10 * a["sd"] + 10).cast("double")).cast("long"))
    goals = bind(ends, lo=lambda a: a["lo"], hi=lambda a: a["hi"], goal=lambda a: total(a) * a["u"])
    drawn = F.element_at(F.transform(goals, pick), 1)
    none = (population <= 0) | (draws <= 0) | (marked <= 0)
    return F.when(none, F.lit(0).cast("long")).when(draws >= population, marked.cast("long")).otherwise(drawn)


def _draw(seed: int, level: int):
    """Step of the fold over a node's quota vector: draw the left half's share of one source."""

    def step(acc: Column, e: Column) -> Column:
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), acc["node"], e["source"], e["none"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        x = F.array(hypergeometric(acc["left"], e["n"], acc["want"], u))
        return F.element_at(F.transform(x, lambda v: F.struct(
            acc["node"].alias("node"), (acc["left"] - e["n"]).alias("left"), (acc["want"] - v).alias("want"),
            F.concat(acc["got"], F.array(v)).alias("got"))), 1)

    return step


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(source, quota) -> (shard, source, n, start): how many of its blocks each of 2**depth shards gets,
    and where its range starts in the source's permuted sequence."""
    vec = F.sort_array(F.collect_list(F.struct((F.col("source").isNull()).alias("none"), F.col("source").alias("source"),
                                               F.col("quota").alias("n"))))
    node = quotas.agg(vec.alias("vec"), F.sum("quota").alias("total")).select(F.lit(0).cast("long").alias("node"), "vec", "total")
    for level in range(depth):
        half = F.lit(1 << (depth - level - 1))

        # blocks wanted by the left half: its share of all leaf capacities
        lo, mid = F.col("node") * half * 2, F.col("node") * half * 2 + half
        share = _capacity(mid, depth) - _capacity(lo, depth)
        start = F.struct(F.col("node").alias("node"), F.col("here").alias("left"), share.alias("want"),
                         F.array().cast("array<bigint>").alias("got"))
        node = node.withColumn("here", F.aggregate("vec", F.lit(0).cast("long"), lambda a, e: a + e["n"]))
        node = node.withColumn("got", F.aggregate("vec", start, _draw(seed, level), lambda a: a["got"]))

        def side(right: bool):
            return F.zip_with("vec", "got", lambda e, x: F.struct(
                e["none"].alias("none"), e["source"].alias("source"), ((e["n"] - x) if right else x).alias("n")))
        pair = F.array(F.struct((F.col("node") * 2).alias("node"), side(False).alias("vec")),
                       F.struct((F.col("node") * 2 + 1).alias("node"), side(True).alias("vec")))
        node = node.select("total", F.explode(pair).alias("p")).select("p.node", "p.vec", "total")
    leaf = node.select(F.col("node").alias("shard"), F.explode("vec").alias("e")).select("shard", "e.source", "e.n")
    run = W.Window.partitionBy("source").orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1)
    return leaf.withColumn("start", F.coalesce(F.sum("n").over(run), F.lit(0)).cast("long"))


def _capacity(leaf: Column, depth: int) -> Column:
    """Blocks in all leaves before ``leaf`` when the total is dealt evenly."""
    return F.floor(leaf.cast("decimal(20,0)") * F.col("total").cast("decimal(18,0)") / F.lit(1 << depth)).cast("long")


MIX_COLUMNS = ["shard", "order_key", "doc_id", "copy", "source", "block", "pass_no", "words"]


def mix(sizes: DataFrame, targets: DataFrame, shards: int = 64, block_words: int = 256, bucket_digits: int = 3,
        seed: int = 17) -> DataFrame:
    """The mix: one row per block taken, with its shard and the key that orders the shard.

    ``sizes`` comes from document_sizes, ``targets`` from source_targets; ``shards`` is a power of two.
    Write it with ``repartition(shards, 'shard').sortWithinPartitions('shard', 'order_key')``.
    """
    depth = shards.bit_length() - 1
    n_blocks = F.ceil(F.col("size") / block_words).cast("long")
    blocks = (sizes.filter("size > 0")
              .select("doc_id", "copy", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"))
              .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
              .withColumn("h", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                                                 F.col("copy"), F.col("block"), F.lit(seed)).cast("binary")))
              .withColumn("bucket", F.substring("h", 1, bucket_digits)).drop("size"))
    per_bucket = blocks.groupBy("source", "bucket").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    earlier = W.Window.partitionBy("source").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = per_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                                F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("words_before"),
                                F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    passes = targets.filter("source_size > 0").select(
        F.col("source").alias("t"), F.floor(F.col("target") / F.col("source_size")).cast("long").alias("passes"),
        (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).cast("long").alias("rest"))
    offsets = offsets.join(passes, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    inside = W.Window.partitionBy("source", "bucket").orderBy("h", "copy", "doc_id", "block")
    upto = inside.rowsBetween(W.Window.unboundedPreceding, -1)
    ranked = (blocks.withColumn("rank", F.row_number().over(inside) - 1)
              .withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
              .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
              .withColumn("rank", F.col("rank") + F.col("n_before"))
              .withColumn("before", F.col("before") + F.col("words_before"))
              .withColumn("last", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
              .select("doc_id", "copy", "source", "block", "words", "h", "rank", "last", "passes"))
    ranked = cut(ranked)
    tally = ranked.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("last") > 0).cast("long")).alias("r"),
                                         F.max("passes").alias("passes"))
    quotas = tally.select("source", (F.col("n") * F.col("passes") + F.col("r")).alias("quota"))
    # the tree's plan is long, its result has one row per shard and source: written once, later plans stay short
    owner = (cut(split_quotas(cut(quotas), depth, seed)).groupBy("source")
             .agg(F.sort_array(F.collect_list(F.struct("start", "shard", "n"))).alias("ranges"))
             .select(F.col("source").alias("o"), F.transform("ranges", lambda r: r["start"]).alias("starts")))
    tally = tally.select(F.col("source").alias("s"), F.col("n").alias("per_pass"))
    taken = (ranked.withColumn("times", F.col("passes") + (F.col("last") > 0).cast("long")).filter("times > 0")
             .join(tally.join(owner, F.col("s").eqNullSafe(F.col("o"))).drop("o"), F.col("source").eqNullSafe(F.col("s")))
             .withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))))
    taken = taken.withColumn("words", F.when(F.col("pass_no") < F.col("passes"), F.col("words")).otherwise(F.col("last")))
    at = F.col("pass_no") * F.col("per_pass") + F.col("rank")
    # empty shards share a start with their successor: the last shard that starts at or before a place owns it
    shard = F.aggregate("starts", F.lit(-1).cast("long"), lambda a, s: a + F.when(s <= at, 1).otherwise(0).cast("long"))
    return (taken.withColumn("shard", shard)
            .withColumn("order_key", F.xxhash64("h", "pass_no", F.lit(seed + 1))).select(*MIX_COLUMNS))


def taken_words(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, copy, source, size, source_size, target, taken."""
    sizes = cut(document_sizes(df, key, source, text))
    targets = cut(source_targets(sizes))
    got = mix(sizes, targets, **options).groupBy("doc_id", "copy").agg(F.sum("words").alias("taken"))
    got = got.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), "taken")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return (sizes.join(t, F.col("source").eqNullSafe(F.col("s")), "left")
            .join(got, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left")
            .select("doc_id", "copy", "source", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0).cast("long")).alias("taken")))


def oracle(block_words: int = 256, seed: int = 17) -> str:
    """The same figures in DuckDB: one plain window over all blocks of a source, no tree."""
    return f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source, size) AS copy FROM sizes),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight, source_size * 3 AS most FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / CAST(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
       FROM s1),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), weight *
        (SELECT level FROM s2 WHERE level * weight <= most ORDER BY most / weight, source NULLS LAST LIMIT 1)) AS target FROM s2),
b AS (SELECT doc_id, copy, source, blk, least({block_words}, size - blk * {block_words}) AS words,
        md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy || ':' || blk || ':{seed}') AS h
      FROM (SELECT *, unnest(range(CAST(ceil(size / {block_words}.0) AS BIGINT))) AS blk FROM d)),
p AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h, copy, doc_id, blk
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
k AS (SELECT p.doc_id, p.copy, sum(p.words * floor(target / source_size)
        + greatest(0, least(p.words, CAST(floor(target - floor(target / source_size) * source_size) AS BIGINT) - p.before))) AS taken
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source GROUP BY p.doc_id, p.copy)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.copy = k.copy"""
