"""Classification metrics as two-level aggregations.

The rows are first reduced to a (group, gold, pred) confusion count -- a table
of at most |groups| x |classes|^2 rows, built with map-side partial aggregation
-- and every metric is computed from that tiny table.  Nothing is collected to
the driver and no Python runs per row.

Semantics follow the usual scikit-learn definitions: the class universe is
gold UNION pred (so an unparsable ``-1`` prediction is a class of its own),
an undefined ratio is ``zero_division`` (0 by default), macro = unweighted mean,
weighted = mean weighted by gold support, micro = pooled counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.operators.joins import first_per_key


def confusion_counts(df: DataFrame, gold: str = "gold", pred: str = "pred", group: list[str] | None = None) -> DataFrame:
    group = group or []
    return df.groupBy(*group, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class_counts(df: DataFrame, gold: str = "gold", pred: str = "pred", group: list[str] | None = None) -> DataFrame:
    """Per (group, class): tp, support (gold count) and predicted count."""
    group = group or []
    cc = confusion_counts(df, gold, pred, group)
    sides = F.explode(F.array(
        F.struct(F.col("gold").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp"))))
    return (cc.select(*group, sides.alias("s"))
            .groupBy(*group, F.col("s.cls").alias("cls"))
            .agg(F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"),
                 F.sum("s.predicted").alias("predicted")))


def _ratio(num: Column, den: Column, zero_division: float) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(float(zero_division)))


def per_class_metrics(df: DataFrame, gold: str = "gold", pred: str = "pred", group: list[str] | None = None,
                      zero_division: float = 0.0) -> DataFrame:
    pc = per_class_counts(df, gold, pred, group)
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    return pc.select("*",
                     _ratio(tp, prd, zero_division).alias("precision"),
                     _ratio(tp, sup, zero_division).alias("recall"),
                     _ratio(2 * tp, sup + prd, zero_division).alias("f1"))


def prf_metrics(df: DataFrame, gold: str = "gold", pred: str = "pred", group: list[str] | None = None,
                zero_division: float = 0.0, labels: list | None = None) -> DataFrame:
    """A1: precision / recall / F1 with macro, weighted and micro averages.

    ``labels`` restricts the averaged classes (A2 uses ``[1]``).  Output columns:
    precision_{macro,weighted,micro}, recall_*, f1_* (+ group columns).
    """
    group = group or []
    pc = per_class_metrics(df, gold, pred, group, zero_division)
    if labels is not None:
        pc = pc.filter(F.col("cls").isin(*labels))
    tp, sup, prd = F.sum("tp"), F.sum("support"), F.sum("predicted")
    aggs = []
    for m in ("precision", "recall", "f1"):
        aggs.append(F.avg(m).alias(f"{m}_macro"))
        aggs.append(_ratio(F.sum(F.col(m) * F.col("support")), sup, 0.0).alias(f"{m}_weighted"))
    aggs += [_ratio(tp, prd, zero_division).alias("precision_micro"),
             _ratio(tp, sup, zero_division).alias("recall_micro"),
             _ratio(2 * tp, sup + prd, zero_division).alias("f1_micro")]
    out = pc.groupBy(*group).agg(*aggs)
    cols = [f"{m}_{a}" for m in ("precision", "recall", "f1") for a in ("macro", "weighted", "micro")]
    return out.select(*group, *cols)


def accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred", group: list[str] | None = None) -> DataFrame:
    group = group or []
    return df.groupBy(*group).agg(F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("accuracy"),
                                  F.count(F.lit(1)).alias("n"))


def balanced_accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred", group: list[str] | None = None) -> DataFrame:
    """Mean recall over the classes present in gold."""
    group = group or []
    pc = per_class_metrics(df, gold, pred, group)
    return pc.filter(F.col("support") > 0).groupBy(*group).agg(F.avg("recall").alias("balanced_accuracy"))


def prf_positive_only(df: DataFrame, gold: str = "gold", pred: str = "pred", group: list[str] | None = None,
                      positive=1) -> DataFrame:
    """A2: the nine P/R/F1 averages restricted to the positive class, plus balanced accuracy.

    With a single class, macro and micro equal the class's own ratios and the
    weighted average is that ratio when the class has support (else 0): one
    aggregation over the per-class table.
    """
    g = group or []
    pc = per_class_metrics(df, gold, pred, g)
    pos = F.col("cls") == positive
    cols = [F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy")]
    for m in ("precision", "recall", "f1"):
        v = F.max(F.when(pos, F.col(m)))
        sup = F.max(F.when(pos, F.col("support")))
        cols += [v.alias(f"{m}_macro"), F.when(sup > 0, v).otherwise(F.lit(0.0)).alias(f"{m}_weighted"),
                 v.alias(f"{m}_micro")]
    return pc.groupBy(*g).agg(*cols)


def accuracy_prf_weighted(df: DataFrame, gold: str = "gold", pred: str = "pred",
                          group: list[str] | None = None) -> DataFrame:
    """A3: accuracy and weighted P/R/F1 in one pass over the confusion table."""
    group = group or []
    pc = per_class_metrics(df, gold, pred, group)
    sup = F.sum("support")
    return pc.groupBy(*group).agg(
        (F.sum("tp") / sup).alias("accuracy"),
        *[_ratio(F.sum(F.col(m) * F.col("support")), sup, 0.0).alias(f"{m}_weighted")
          for m in ("precision", "recall", "f1")])


def drop_invalid_predictions(df: DataFrame, valid: list, gold: str = "gold", pred: str = "pred"):
    """(kept rows, invalid count per gold label)."""
    ok = F.col(pred).isin(*valid)
    kept = df.filter(ok)
    invalid = df.filter(~ok | F.col(pred).isNull()).groupBy(gold).agg(F.count(F.lit(1)).alias("n_invalid"))
    return kept, invalid


def full_metrics(df: DataFrame, valid: list, gold: str = "gold", pred: str = "pred",
                 group: list[str] | None = None) -> DataFrame:
    """A4: accuracy + 9 P/R/F1 variants after dropping invalid predictions, long form.

    Accuracy is pooled tp / rows, i.e. the micro recall over all classes, so the
    whole row comes from one aggregation.  Output: (group..., metric, value).
    """
    g = group or []
    kept, _ = drop_invalid_predictions(df, valid, gold, pred)
    wide = prf_metrics(kept, gold, pred, g).withColumn("accuracy", F.col("recall_micro"))
    names = ["accuracy"] + [c for c in wide.columns if c not in g and c != "accuracy"]
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                for c in names]))
    return wide.select(*g, stack.alias("s")).select(*g, "s.metric", "s.value")


def macro_prf_per_task(df: DataFrame, gold: str = "gold", pred: str = "pred", task: str = "task",
                       zero_division: float = 1.0) -> DataFrame:
    """A5: macro P/R/F1 per task with zero_division = 1.0."""
    m = prf_metrics(df, gold, pred, [task], zero_division)
    return m.select(task, "precision_macro", "recall_macro", "f1_macro")


def acceptance_rate(df: DataFrame, reply: str = "reply", group: list[str] | None = None) -> DataFrame:
    """Share of replies whose first line parses to the integer 1; failures count as rejected."""
    group = group or []
    first = F.trim(F.split(F.col(reply), "\n", 2)[0])
    ok = first.try_cast("int") == 1
    return df.groupBy(*group).agg((F.sum(F.when(ok, 1).otherwise(0)) / F.count(F.lit(1))).alias("acceptance_rate"),
                                  F.count(F.lit(1)).alias("n"))


def win_rate(df: DataFrame, win: str = "win", group: list[str] | None = None) -> DataFrame:
    """Wins / non-null outcomes."""
    group = group or []
    return df.groupBy(*group).agg(F.avg(F.col(win).cast("double")).alias("win_rate"),
                                  F.count(win).alias("n_judged"))


def one_per_class(df: DataFrame, label: str, order: str = "ord") -> DataFrame:
    """The first row (by ``order``) for every label value -- partial aggregation, skew-safe."""
    return first_per_key(df, [label], [order])


def metric_collation(df: DataFrame, model: str, task: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Macro / micro / weighted P, R, F1 for every (model, task) in one grouped pass."""
    return prf_metrics(df, gold, pred, [model, task])
