"""The generic first/last-per-key pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order_cols: list[str], last: bool = False,
                  unique_order: bool = False) -> DataFrame:
    """Keep the first (or last) row of each key group by ``order_cols``.

    The first order value of each key is a hash aggregate over the key and order
    columns alone, reduced inside each map task before the shuffle, so a hot key
    never meets in one task and no text is sorted.  The rows are then picked by a
    semi join on key and order value, which spreads a hot key by its order values.
    Rows of a key that tie on the order are reduced to one (any) among those picked;
    ``unique_order`` says that there are none and saves that step.
    """
    order = F.col(order_cols[0]) if len(order_cols) == 1 else F.struct(*order_cols)
    pick = (F.max(order) if last else F.min(order)).alias("_o")
    firsts = df.groupBy(*keys).agg(pick).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_o")
    names = ["_o"] if len(order_cols) == 1 else [f"_o.{c}" for c in order_cols]
    firsts = firsts.select(*[f"_k{i}" for i in range(len(keys))], *[F.col(n).alias(f"_o{j}") for j, n in enumerate(names)])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on += [F.col(c).eqNullSafe(F.col(f"_o{j}")) for j, c in enumerate(order_cols)]
    picked = df.join(firsts, reduce(lambda a, b: a & b, on), "left_semi")
    return picked if unique_order else picked.dropDuplicates(keys)
