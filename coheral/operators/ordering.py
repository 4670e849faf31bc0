"""Order-dependent building blocks that stay distributed.

* ``global_rank`` -- exact 0-based rank over a total order without a
  partition-less window (which would pull every row into one task): the order
  columns are range-partitioned, numbered inside each partition, and shifted by
  the sizes of the preceding partitions (a table with one row per partition).
* ``topk_per_group`` -- two-stage top-k: first inside (group, salt) sub-groups,
  then over the <= k * salts survivors, so a group holding a third of the table
  is never sorted by a single task.
* seeded sampling by MD5 order (``coheral.functions.hashing``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coheral.functions.hashing import hash_key
from coheral.session import cut_lineage


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_rank(df: DataFrame, order_cols: list, name: str = "rank", num_partitions: int | None = None,
                key: list[str] | None = None) -> DataFrame:
    """Append a dense 0-based position under ``order_cols`` (must be a total order).

    One range exchange sorts the rows; the place inside a partition is the low
    part of ``monotonically_increasing_id``, and a table with one row per
    partition shifts it.  The sorted frame is checkpointed (reliable checkpoint in
    ``spark.checkpoint.dir``) so that both passes see the same partitions.  With
    ``key`` only the order and key columns are sorted and written, and the
    position is joined back to the rows by key; without it ``df`` itself should
    be narrow.
    """
    oc = _cols(order_cols)
    if key is not None:
        order = [c.alias(f"_o{i}") for i, c in enumerate(oc)]
        narrow = global_rank(df.select(*key, *order), [f"_o{i}" for i in range(len(oc))], name, num_partitions)
        return df.join(narrow.select(*key, name), key)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *oc).sortWithinPartitions(*oc)
                         .withColumn("_m", F.monotonically_increasing_id()))
    pid, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(pid.alias("_pid")).agg((F.max(place) + 1).alias("_n"))
    offsets = sizes.select(F.col("_pid").alias("_p"), (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    # one row per partition: bounded by the partition count, safe to broadcast
    return (ranged.join(F.broadcast(offsets), pid == F.col("_p"))
            .withColumn(name, F.col("_off") + place).drop("_m", "_p", "_off"))


def rows_at(df: DataFrame, order_cols: list[str], positions: list[int]) -> dict[int, tuple]:
    """The order values at the given positions (one row each on the driver); positions past the end are absent."""
    ranked = global_rank(df.select(*order_cols), order_cols, "_pos")
    return {r["_pos"]: tuple(r[c] for c in order_cols) for r in ranked.filter(F.col("_pos").isin(positions)).collect()}


def _before(order_cols: list[str], bound: tuple) -> Column:
    return F.struct(*order_cols) < F.struct(*[F.lit(v) for v in bound])


def topk_per_group(df: DataFrame, group: list[str], order_cols: list, k: int, salts: int = 16,
                   salt_key: Column | None = None, rank_name: str = "rank") -> DataFrame:
    """Top ``k`` rows per group under ``order_cols`` (a total order), with 1-based rank."""
    oc = _cols(order_cols)
    key = salt_key if salt_key is not None else F.xxhash64(*[F.col(c) for c in df.columns])
    salted = df.withColumn("_salt", F.pmod(key, F.lit(salts)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*oc)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*oc)
    return stage1.withColumn(rank_name, F.row_number().over(w2)).filter(F.col(rank_name) <= k)


def shuffle_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Seeded shuffle, then the first ``n`` rows (nested: sample(n) is a prefix of sample(m > n)).

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps its
    own top n and only those reach the final merge.
    """
    return df.withColumn("_h", hash_key(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def split_train_test(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Seeded permutation; the first ``int(ratio * n)`` rows are train, the rest test.

    The hash at that position (found over the hashes alone) is the boundary the
    rows are compared with, so no row moves.  Adds column ``split``.
    """
    n = df.count()
    cut = int(ratio * n)
    hashed = df.withColumn("_h", hash_key(F.col(key), seed))
    bound = rows_at(hashed, ["_h", key], [cut]).get(cut)
    train = _before(["_h", key], bound) if bound is not None else F.lit(True)
    return hashed.withColumn("split", F.when(train, "train").otherwise("test")).drop("_h")


def slice_rows(df: DataFrame, order: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """P20 / S3: positional ``[begin:end]`` slice under ``order`` (Python slice semantics, begin/end >= 0).

    ``order`` is unique.  The order values at both ends are found over that column
    alone; the rows are filtered by comparison, without moving.
    """
    at = rows_at(df, [order], [p for p in (begin, end) if p])
    out = df
    if begin:
        out = out.filter(F.col(order) >= F.lit(at[begin][0])) if begin in at else out.limit(0)
    if end is not None:
        out = out.limit(0) if end == 0 else out.filter(F.col(order) < F.lit(at[end][0])) if end in at else out
    return out
