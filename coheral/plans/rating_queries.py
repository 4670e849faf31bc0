"""Registered queries: pairwise matrices, Bradley-Terry, bootstrap, leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coheral.operators import arena as A
from coheral.operators import ratings as R
from coheral.plans.metric_queries import _r
from coheral.plans.oracle_fixtures import with_fixtures
from coheral.plans.registry import query
from coheral.sources import fixtures as fx
from coheral.sources.tables import Tables


def _anon(spark, sf_dir) -> DataFrame:
    b = fx.battles(Tables(spark, sf_dir)).filter(F.col("anony"))
    return b.withColumn("tstamp", A.epoch_seconds(F.col("ts")))


def _no_ties(spark, sf_dir) -> DataFrame:
    return _anon(spark, sf_dir).filter(~F.col("winner").contains("tie"))


_BOTH = ("bo AS (SELECT model_a AS row, model_b AS col, CAST(winner = 'model_a' AS INTEGER) AS won FROM nt "
         "UNION ALL SELECT model_b, model_a, CAST(winner = 'model_b' AS INTEGER) FROM nt)")
_NT = "nt AS (SELECT * FROM battles WHERE anony AND NOT contains(winner, 'tie'))"


@query("win_fraction_matrix", "A23", with_fixtures(
    f"WITH {_NT}, {_BOTH} SELECT row, col, round(SUM(won) / COUNT(*), 6) AS win_frac FROM bo GROUP BY row, col",
    "battles"))
def q_win_fraction_matrix(spark, sf_dir):
    return _r(R.win_fraction_matrix(_no_ties(spark, sf_dir)))


@query("win_fraction_table", "A23", with_fixtures(f"""
WITH {_NT}, {_BOTH}, wf AS (SELECT row, col, SUM(won) / COUNT(*) AS f FROM bo GROUP BY row, col),
o AS (SELECT * FROM (SELECT row AS model, row_number() OVER (ORDER BY round(AVG(f), 9) DESC, row) AS pos FROM wf GROUP BY row) z WHERE pos <= 6)
SELECT a.model AS row, b.model AS col, CAST(a.pos AS INTEGER) AS row_pos, CAST(b.pos AS INTEGER) AS col_pos, round(wf.f, 6) AS win_frac
FROM o a CROSS JOIN o b LEFT JOIN wf ON wf.row = a.model AND wf.col = b.model""", "battles"))
def q_win_fraction_table(spark, sf_dir):
    return _r(R.win_fraction_table(_no_ties(spark, sf_dir), limit=6))


@query("battle_count_matrix", "A24", with_fixtures(
    f"WITH {_NT}, {_BOTH} SELECT row, col, COUNT(*) AS n FROM bo GROUP BY row, col", "battles"))
def q_battle_count_matrix(spark, sf_dir):
    return R.battle_count_matrix(_no_ties(spark, sf_dir))


_AVG_SQL = (f"WITH {_NT}, {_BOTH}, wf AS (SELECT row, col, SUM(won) / COUNT(*) AS f FROM bo GROUP BY row, col), "
            "aw AS (SELECT row AS model, AVG(f) AS avg_win_rate FROM wf GROUP BY row)")


@query("average_win_rate", "A25", with_fixtures(
    f"{_AVG_SQL} SELECT model, round(avg_win_rate, 6) AS avg_win_rate FROM aw", "battles"))
def q_average_win_rate(spark, sf_dir):
    return _r(R.average_win_rate(_no_ties(spark, sf_dir)))


@query("rank_ratings", "D10", with_fixtures(
    f"{_AVG_SQL} SELECT model, round(avg_win_rate, 6) AS avg_win_rate, "
    "CAST(row_number() OVER (ORDER BY round(avg_win_rate, 9) DESC, model) AS INTEGER) AS rank FROM aw", "battles"))
def q_rank_ratings(spark, sf_dir):
    aw = R.average_win_rate(_no_ties(spark, sf_dir)).withColumn("_key", F.round("avg_win_rate", 9))
    return _r(R.rank_ratings(aw, "_key").drop("_key"))  # rank on a value both engines agree on


_NB_SQL = ("nb AS (SELECT coalesce(a.model, b.model) AS model, coalesce(a.n, 0) + coalesce(b.n, 0) AS num_battles FROM "
           "(SELECT model_a AS model, COUNT(*) AS n FROM battles WHERE anony GROUP BY 1) a FULL JOIN "
           "(SELECT model_b AS model, COUNT(*) AS n FROM battles WHERE anony GROUP BY 1) b ON a.model = b.model)")


@query("num_battles", "A26", with_fixtures(f"WITH {_NB_SQL} SELECT model, num_battles FROM nb", "battles"))
def q_num_battles(spark, sf_dir):
    return R.num_battles(_anon(spark, sf_dir))


@query("leaderboard_totals", "A33", with_fixtures(
    f"WITH {_NB_SQL} SELECT COUNT(*) AS n_models, CAST(floor(SUM(num_battles) / 2) AS BIGINT) AS n_votes, "
    "(SELECT round(max(epoch_us(ts)) / 1e6, 6) FROM battles WHERE anony) AS last_updated FROM nb", "battles"))
def q_leaderboard_totals(spark, sf_dir):
    b = _anon(spark, sf_dir)
    return _r(R.leaderboard_totals(R.num_battles(b), b))


@query("distinct_models", "U5", with_fixtures(
    "SELECT model_a AS model FROM battles UNION SELECT model_b FROM battles", "battles"))
def q_distinct_models(spark, sf_dir):
    return R.distinct_models(fx.battles(Tables(spark, sf_dir)))


@query("bt_mle", "M2 U4")
def q_bt_mle(spark, sf_dir):
    return R.bt_mle(_anon(spark, sf_dir)).select("model", F.round("rating", 2).alias("rating"))


@query("bt_optimality", "M2 U4", with_fixtures(
    "SELECT DISTINCT model, true AS optimal FROM (SELECT model_a AS model FROM battles WHERE anony "
    "UNION ALL SELECT model_b FROM battles WHERE anony) z", "battles"))
def q_bt_optimality(spark, sf_dir):
    """The fit's certificate: no model's gradient exceeds a millionth of the battles."""
    b = _anon(spark, sf_dir)
    n = b.agg(F.count(F.lit(1))).scalar()
    g = R.bt_gradient(b, R.bt_mle(b, anchor=None))
    return g.select("model", (F.abs("gradient") <= n * 1e-6).alias("optimal"))


@query("bootstrap_summary", "M3 A27 D20 F24")
def q_bootstrap_summary(spark, sf_dir):
    return R.bootstrap_summary(R.bootstrap_ratings(_anon(spark, sf_dir), rounds=100, seed=42))


@query("leaderboard", "M4 D10 A26 F27")
def q_leaderboard(spark, sf_dir):
    lb = R.leaderboard(_anon(spark, sf_dir).withColumn("anony", F.lit(True)), rounds=50)
    return lb.withColumn("ci", R.ci_text(F.col("rating"), F.col("rating_q025"), F.col("rating_q975")))
