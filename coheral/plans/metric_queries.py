"""Registered queries: classification metrics, acceptance and win rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coheral.functions.hashing import coin
from coheral.operators import metrics as M
from coheral.plans.oracle_fixtures import with_fixtures
from coheral.plans.registry import query
from coheral.sources import fixtures as fx
from coheral.sources.tables import Tables

ROUND = 6


def _r(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """Round double columns so both engines hash the same text."""
    return df.select(*[F.round(F.col(c), ROUND).alias(c) if t == "double" and c not in keep else F.col(c)
                       for c, t in df.dtypes])


# ---- SQL restatement of the per-class table (oracle side) --------------------
def _per_class_sql(src: str, group: list[str], zd: float) -> str:
    g = "".join(f"{c}, " for c in group)
    return f"""cc AS (SELECT {g}gold, pred, COUNT(*) AS n FROM {src} GROUP BY {g}gold, pred),
pc0 AS (SELECT {g}cls, SUM(tp) AS tp, SUM(sup) AS support, SUM(prd) AS predicted FROM (
    SELECT {g}gold AS cls, CASE WHEN gold = pred THEN n ELSE 0 END AS tp, n AS sup, 0 AS prd FROM cc
    UNION ALL SELECT {g}pred AS cls, 0 AS tp, 0 AS sup, n AS prd FROM cc) u GROUP BY {g}cls),
pc AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE {zd} END AS p,
              CASE WHEN support > 0 THEN tp / support ELSE {zd} END AS r,
              CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE {zd} END AS f FROM pc0)"""


def _avg_sql(zd: float, pc: str = "pc") -> str:
    w = lambda m: f"round(CAST(CASE WHEN SUM(support) > 0 THEN SUM({m} * support) / SUM(support) ELSE 0 END AS DOUBLE), 6)"
    return f"""round(CAST(AVG(p) AS DOUBLE), 6) AS precision_macro, {w('p')} AS precision_weighted,
  round(CAST(CASE WHEN SUM(predicted) > 0 THEN SUM(tp) / SUM(predicted) ELSE {zd} END AS DOUBLE), 6) AS precision_micro,
  round(CAST(AVG(r) AS DOUBLE), 6) AS recall_macro, {w('r')} AS recall_weighted,
  round(CAST(CASE WHEN SUM(support) > 0 THEN SUM(tp) / SUM(support) ELSE {zd} END AS DOUBLE), 6) AS recall_micro,
  round(CAST(AVG(f) AS DOUBLE), 6) AS f1_macro, {w('f')} AS f1_weighted,
  round(CAST(CASE WHEN SUM(support) + SUM(predicted) > 0 THEN 2 * SUM(tp) / (SUM(support) + SUM(predicted))
        ELSE {zd} END AS DOUBLE), 6) AS f1_micro"""


def _preds(spark, sf_dir) -> DataFrame:
    return fx.preds(Tables(spark, sf_dir))


@query("prf_metrics", "A1 S14", with_fixtures(f"WITH {_per_class_sql('preds', [], 0.0)}\nSELECT {_avg_sql(0.0)} FROM pc",
                                               "preds"))
def q_prf_metrics(spark, sf_dir):
    return _r(M.prf_metrics(_preds(spark, sf_dir)))


@query("prf_metrics_by_task", "A1 U2", with_fixtures(
    f"WITH {_per_class_sql('preds', ['task'], 0.0)}\nSELECT task, {_avg_sql(0.0)} FROM pc GROUP BY task", "preds"))
def q_prf_metrics_by_task(spark, sf_dir):
    return _r(M.prf_metrics(_preds(spark, sf_dir), group=["task"]))


@query("prf_positive_only", "A2", with_fixtures(
    f"WITH {_per_class_sql('preds', [], 0.0)}\n"
    "SELECT (SELECT round(CAST(AVG(r) AS DOUBLE), 6) FROM pc WHERE support > 0) AS balanced_accuracy, "
    f"{_avg_sql(0.0)} FROM pc WHERE cls = 1", "preds"))
def q_prf_positive_only(spark, sf_dir):
    return _r(M.prf_positive_only(_preds(spark, sf_dir)))


@query("accuracy_prf_weighted", "A3", with_fixtures(
    f"WITH {_per_class_sql('preds', ['task'], 0.0)}\n"
    "SELECT task, round(CAST(SUM(tp) / SUM(support) AS DOUBLE), 6) AS accuracy, "
    "round(CAST(SUM(p * support) / SUM(support) AS DOUBLE), 6) AS precision_weighted, "
    "round(CAST(SUM(r * support) / SUM(support) AS DOUBLE), 6) AS recall_weighted, "
    "round(CAST(SUM(f * support) / SUM(support) AS DOUBLE), 6) AS f1_weighted FROM pc GROUP BY task", "preds"))
def q_accuracy_prf_weighted(spark, sf_dir):
    return _r(M.accuracy_prf_weighted(_preds(spark, sf_dir), group=["task"]))


_FULL_SQL = with_fixtures(
    f"WITH kept AS (SELECT * FROM preds WHERE pred IN (0, 1)), {_per_class_sql('kept', ['task'], 0.0)},\n"
    "wide AS (SELECT pc.task, (SELECT round(CAST(AVG(CASE WHEN k.gold = k.pred THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) "
    f"FROM kept k WHERE k.task = pc.task) AS accuracy, {_avg_sql(0.0)} FROM pc GROUP BY pc.task)\n"
    "SELECT task, metric, value FROM wide UNPIVOT (value FOR metric IN (accuracy, precision_macro, precision_weighted, "
    "precision_micro, recall_macro, recall_weighted, recall_micro, f1_macro, f1_weighted, f1_micro))", "preds")


@query("full_metrics", "A4 P39", _FULL_SQL)
def q_full_metrics(spark, sf_dir):
    return _r(M.full_metrics(_preds(spark, sf_dir), valid=[0, 1], group=["task"]))


@query("macro_prf_per_task", "A5", with_fixtures(
    f"WITH {_per_class_sql('preds', ['task'], 1.0)}\n"
    "SELECT task, round(CAST(AVG(p) AS DOUBLE), 6) AS precision_macro, round(CAST(AVG(r) AS DOUBLE), 6) AS recall_macro, "
    "round(CAST(AVG(f) AS DOUBLE), 6) AS f1_macro FROM pc GROUP BY task", "preds"))
def q_macro_prf_per_task(spark, sf_dir):
    return _r(M.macro_prf_per_task(_preds(spark, sf_dir)))


@query("invalid_prediction_counts", "P39", with_fixtures(
    "SELECT gold, COUNT(*) AS n_invalid FROM preds WHERE pred NOT IN (0, 1) OR pred IS NULL GROUP BY gold", "preds"))
def q_invalid_prediction_counts(spark, sf_dir):
    return M.drop_invalid_predictions(_preds(spark, sf_dir), valid=[0, 1])[1]


@query("one_per_class", "D19", with_fixtures(
    "SELECT gold, ord, pred, task FROM (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY ord) AS rn FROM preds) z "
    "WHERE rn = 1", "preds"))
def q_one_per_class(spark, sf_dir):
    return M.one_per_class(_preds(spark, sf_dir), "gold", "ord").select("gold", "ord", "pred", "task")


@query("acceptance_rate", "A6 P30", with_fixtures(
    "SELECT task, round(CAST(SUM(CASE WHEN TRY_CAST(trim(split_part(reply, chr(10), 1)) AS INTEGER) = 1 THEN 1 ELSE 0 END)"
    " / COUNT(*) AS DOUBLE), 6) AS acceptance_rate, COUNT(*) AS n FROM "
    "(SELECT task, CAST(pred AS VARCHAR) || chr(10) || 'explanation' AS reply FROM preds) z GROUP BY task", "preds"))
def q_acceptance_rate(spark, sf_dir):
    p = _preds(spark, sf_dir).select("task", F.concat(F.col("pred").cast("string"), F.lit("\nexplanation")).alias("reply"))
    return _r(M.acceptance_rate(p, "reply", ["task"]))


WIN_SEED = 7


@query("win_rate", "A7 P36 D21", with_fixtures(
    f"SELECT round(AVG(CAST(choice = pred_pos AS INTEGER)), 6) AS win_rate, COUNT(choice) AS n_judged FROM ("
    f"SELECT CASE WHEN substr(md5('{WIN_SEED}:' || CAST(ord AS VARCHAR)), 1, 1) < '8' THEN 1 ELSE 2 END AS pred_pos, "
    "CASE right(judgment, 1) WHEN 'm' THEN 1 WHEN 'M' THEN 2 END AS choice FROM judge_outputs) z", "judge_outputs"))
def q_win_rate(spark, sf_dir):
    from coheral.operators.judge import parse_win_choice
    j = fx.judge_outputs(Tables(spark, sf_dir))
    j = j.withColumn("pred_pos", F.when(coin(F.col("ord"), WIN_SEED), 1).otherwise(2))
    j = parse_win_choice(j, "judgment", "pred_pos")
    return _r(M.win_rate(j, "win"))
