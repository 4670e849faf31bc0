"""Order-dependent greedy dedup over two keys, without a sequential pass.

Rows in order, a row is kept iff no kept row before it has its ``a`` or its ``b``.  Every group
(rows with one ``a``, or one ``b``) keeps one row at most, and of rows with the same ``a`` and
``b`` only the first can be kept.  A round looks at the two earliest undecided rows of each group and settles

* rows that are first in both their groups: kept, and all others of those groups rejected;
* chains: a row that is first in one group and second in the other depends on that group's first
  row alone and is its opposite.  Such rows point at the row they depend on; the pointers are
  doubled, so a chain of n rows is contracted in log2(n) joins and decided with its end;
* forced rows: where a group's second row depends on its first alone, one of the two is kept and
  all later rows of the group are rejected.

A round settles the earliest row at least, and all chains at once.  Only narrow rows
(order, two 64-bit pairs of hashes) take part; hot groups are reduced by partial aggregation and joined
with one row of their own, and every round is cut by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coheral.session import cut_lineage


def _two_first(rows: DataFrame, group: str) -> DataFrame:
    """(group, first, second) order values of every group; second is null for a single row."""
    first = rows.groupBy(group).agg(F.min("o").alias(f"{group}1"))
    later = rows.join(first, group).filter(F.col("o") > F.col(f"{group}1")).groupBy(group).agg(F.min("o").alias(f"{group}2"))
    return first.join(later, group, "left")


def _contract(chain: DataFrame) -> DataFrame:
    """(o, end, odd) of chain rows (o, to): the first row off the chain, and whether the way there has an odd number of steps."""
    at = cut_lineage(chain.select("o", F.col("to").alias("end"), F.lit(True).alias("odd")))
    while True:
        on = at.select(F.col("o").alias("end"), F.col("end").alias("next"), F.col("odd").alias("more"))
        if at.join(on, "end", "left_semi").isEmpty():
            return at
        at = cut_lineage(at.join(on, "end", "left").select(
            "o", F.coalesce("next", "end").alias("end"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd")))


def greedy_keep(rows: DataFrame) -> tuple[DataFrame, int]:
    """((o) of the kept rows, rounds taken) for rows (o, a, b) with unique ``o`` and no nulls."""
    left, kept, done = cut_lineage(rows.groupBy("a", "b").agg(F.min("o").alias("o"))), None, 0
    while True:
        done += 1
        flags = left.join(_two_first(left, "a"), "a").join(_two_first(left, "b"), "b")
        first_a, first_b = F.col("o") == F.col("a1"), F.col("o") == F.col("b1")
        second_a, second_b = F.col("o") == F.col("a2"), F.col("o") == F.col("b2")
        flags = cut_lineage(flags.select("o", "a", "b", "a2", "b2", (first_a & first_b).alias("keep"), F.when(
            first_a & second_b, F.col("b1")).when(first_b & second_a, F.col("a1")).alias("to"), (first_b & second_a).alias("in_a")))
        heads = flags.filter("keep").select("o", "a", "b")
        chain = flags.filter("to IS NOT NULL")
        if not chain.isEmpty():
            shut = [chain.filter(F.col("in_a") == (g == "a")).select(g).distinct() for g in ("a", "b")]
            forced = (flags.filter("o > a2").join(shut[0], "a", "left_semi").select("o")
                      .unionByName(flags.filter("o > b2").join(shut[1], "b", "left_semi").select("o"))).distinct()
            forced = cut_lineage(forced)
            ends = _contract(chain.select("o", "to"))
            settled = heads.select(F.col("o").alias("end"), F.lit(True).alias("good")).unionByName(
                forced.select(F.col("o").alias("end"), F.lit(False).alias("good")))
            from_ends = ends.join(settled, "end").filter(F.col("good") != F.col("odd")).select("o")
            heads = heads.unionByName(chain.join(from_ends, "o", "left_semi").select("o", "a", "b"))
        heads = cut_lineage(heads)
        kept = heads.select("o") if kept is None else kept.unionByName(heads.select("o"))
        rest = left.join(heads.select("a").distinct(), "a", "left_anti").join(heads.select("b").distinct(), "b", "left_anti")
        if not chain.isEmpty():
            rest = rest.join(forced, "o", "left_anti")
        left = cut_lineage(rest)
        if left.isEmpty():
            return kept, done
