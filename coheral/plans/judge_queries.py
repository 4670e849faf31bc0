"""Registered queries: judge verdict parsing, judgment dedup, results, agreement, matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coheral.operators import judge as J
from coheral.operators.external import stub_judge
from coheral.plans.metric_queries import _r
from coheral.plans.oracle_fixtures import with_fixtures
from coheral.plans.registry import query
from coheral.sources import fixtures as fx
from coheral.sources.tables import Tables

_ONE = r"\[\[(\d+\.?\d*)\]\]"
_ONE_B = r"\[(\d+\.?\d*)\]"
_TWO = r"\[\[(\d+\.?\d*),\s?(\d+\.?\d*)\]\]"
_TWO_B = r"\[(\d+\.?\d*),\s?(\d+\.?\d*)\]"

_SCORE_SQL = (f"CASE WHEN regexp_matches(judgment, '{_ONE}') THEN CAST(regexp_extract(judgment, '{_ONE}', 1) AS DOUBLE) "
              f"WHEN regexp_matches(judgment, '{_ONE_B}') THEN CAST(regexp_extract(judgment, '{_ONE_B}', 1) AS DOUBLE) "
              "ELSE -1.0 END")
_VERDICT_SQL = ("CASE WHEN contains(judgment, '[[A]]') THEN 'A' WHEN contains(judgment, '[[B]]') THEN 'B' "
                "WHEN contains(judgment, '[[C]]') THEN 'tie' ELSE 'error' END")
_A = (f"CAST(CASE WHEN regexp_matches(judgment, '{_TWO}') THEN regexp_extract(judgment, '{_TWO}', 1) "
      f"ELSE regexp_extract(judgment, '{_TWO_B}', 1) END AS DOUBLE)")
_B = _A.replace("', 1)", "', 2)")
_SCORES_SQL = (f"CASE WHEN NOT (regexp_matches(judgment, '{_TWO}') OR regexp_matches(judgment, '{_TWO_B}')) THEN 'error' "
               f"WHEN abs({_A} - {_B}) <= 0.1 THEN 'tie' WHEN {_A} > {_B} THEN 'A' ELSE 'B' END")


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


@query("parse_single_score", "P31", with_fixtures(f"SELECT ord, {_SCORE_SQL} AS score FROM judge_outputs", "judge_outputs"))
def q_parse_single_score(spark, sf_dir):
    j = fx.judge_outputs(_t(spark, sf_dir))
    return j.select("ord", J.parse_single_score("judgment").alias("score"))


@query("parse_pair_verdict", "P32", with_fixtures(f"SELECT ord, {_VERDICT_SQL} AS verdict FROM judge_outputs",
                                                   "judge_outputs"))
def q_parse_pair_verdict(spark, sf_dir):
    j = fx.judge_outputs(_t(spark, sf_dir))
    return j.select("ord", J.parse_pair_verdict("judgment").alias("verdict"))


@query("parse_pair_scores", "P33", with_fixtures(f"SELECT ord, {_SCORES_SQL} AS verdict FROM judge_outputs",
                                                  "judge_outputs"))
def q_parse_pair_scores(spark, sf_dir):
    j = fx.judge_outputs(_t(spark, sf_dir))
    return j.select("ord", J.parse_pair_scores("judgment").alias("verdict"))


@query("map_positions", "P34 A20", with_fixtures(
    "SELECT ord, g1_winner, g2_winner, CASE WHEN g1_winner = g2_winner THEN g1_winner ELSE 'inconsistent' END AS winner "
    "FROM (SELECT ord, CASE v1 WHEN 'A' THEN 'model_1' WHEN 'B' THEN 'model_2' ELSE v1 END AS g1_winner, "
    "CASE v2 WHEN 'A' THEN 'model_2' WHEN 'B' THEN 'model_1' ELSE v2 END AS g2_winner "
    f"FROM (SELECT ord, {_VERDICT_SQL} AS v1, {_SCORES_SQL} AS v2 FROM judge_outputs) a) b", "judge_outputs"))
def q_map_positions(spark, sf_dir):
    j = fx.judge_outputs(_t(spark, sf_dir))
    g1, g2 = J.map_positions(J.parse_pair_verdict("judgment"), J.parse_pair_scores("judgment"))
    j = j.select("ord", g1.alias("g1_winner"), g2.alias("g2_winner"))
    return j.withColumn("winner", J.pair_winner("g1_winner", "g2_winner"))


_SS_CTE = ("ss AS (SELECT model, question_id, turn, avg(score) AS s FROM single_judgments WHERE score <> -1 "
           "GROUP BY model, question_id, turn)")


@query("scores_to_winner", "P35", with_fixtures(
    f"WITH {_SS_CTE} SELECT p.ord, round(a.s, 6) AS score_1, round(b.s, 6) AS score_2, "
    "CASE WHEN abs(a.s - b.s) <= 0.1 THEN 'tie' WHEN a.s > b.s THEN 'model_1' ELSE 'model_2' END AS winner "
    "FROM pair_judgments p JOIN ss a ON a.model = p.model_1 AND a.question_id = p.question_id AND a.turn = p.turn "
    "JOIN ss b ON b.model = p.model_2 AND b.question_id = p.question_id AND b.turn = p.turn",
    "single_judgments", "pair_judgments"))
def q_scores_to_winner(spark, sf_dir):
    t = _t(spark, sf_dir)
    ss = (fx.single_judgments(t).filter(F.col("score") != -1)
          .groupBy("model", "question_id", "turn").agg(F.avg("score").alias("s")))
    a = ss.select(F.col("model").alias("model_1"), "question_id", "turn", F.col("s").alias("score_1"))
    b = ss.select(F.col("model").alias("model_2"), "question_id", "turn", F.col("s").alias("score_2"))
    p = fx.pair_judgments(t).join(a, ["model_1", "question_id", "turn"]).join(b, ["model_2", "question_id", "turn"])
    return _r(p.select("ord", "score_1", "score_2", J.scores_to_winner("score_1", "score_2").alias("winner")))


@query("single_scores", "A18", with_fixtures(
    "SELECT model, turn, round(avg(score), 6) AS score, COUNT(*) AS n FROM single_judgments WHERE score <> -1 "
    "GROUP BY GROUPING SETS ((model, turn), (model))", "single_judgments"))
def q_single_scores(spark, sf_dir):
    return _r(J.single_scores(fx.single_judgments(_t(spark, sf_dir))))


def _pairwise_sql(baseline: str | None) -> str:
    bfilter = f" AND (model_1 = '{baseline}' OR model_2 = '{baseline}')" if baseline else ""
    bdrop = f" WHERE model <> '{baseline}'" if baseline else ""
    return with_fixtures(f"""
WITH d AS (SELECT *, (g1_winner = 'tie' OR g1_winner <> g2_winner) AS t, g1_winner = 'model_1' AS w1
           FROM pair_judgments WHERE g1_winner <> 'error' AND g2_winner <> 'error'{bfilter}),
r AS (SELECT model_1 AS model, CAST(NOT t AND w1 AS INT) AS win, CAST(NOT t AND NOT w1 AS INT) AS loss,
             CAST(t AS INT) AS tie FROM d
      UNION ALL SELECT model_2, CAST(NOT t AND NOT w1 AS INT), CAST(NOT t AND w1 AS INT), CAST(t AS INT) FROM d),
g AS (SELECT model, CAST(SUM(win) AS BIGINT) AS win, CAST(SUM(loss) AS BIGINT) AS loss, CAST(SUM(tie) AS BIGINT) AS tie
      FROM r GROUP BY model)
SELECT model, win, loss, tie, round(win / (win + loss + tie), 6) AS win_rate,
       round(loss / (win + loss + tie), 6) AS loss_rate,
       round((win + 0.5 * tie) / (win + loss + tie), 6) AS win_rate_adjusted FROM g{bdrop}""", "pair_judgments")


@query("pairwise_results", "A19", _pairwise_sql(None))
def q_pairwise_results(spark, sf_dir):
    return _r(J.pairwise_results(fx.pair_judgments(_t(spark, sf_dir))))


@query("pairwise_results_baseline", "A19", _pairwise_sql("m0"))
def q_pairwise_results_baseline(spark, sf_dir):
    return _r(J.pairwise_results(fx.pair_judgments(_t(spark, sf_dir)), baseline="m0"))


@query("judgments_last_by_game", "D6 A20", with_fixtures("""
WITH r AS (SELECT turn, question_id, model_1, model_2, min(ord) AS first_ord, max(ord) AS src_ord,
                  arg_max(CASE WHEN g1_winner = g2_winner THEN g1_winner ELSE 'inconsistent' END, ord) AS w,
                  arg_max(g1_judgment, ord) AS j1, arg_max(g2_judgment, ord) AS j2
           FROM pair_judgments GROUP BY turn, question_id, model_1, model_2),
n AS (SELECT turn, question_id, CASE WHEN model_1 >= model_2 THEN model_2 ELSE model_1 END AS model_lo,
             CASE WHEN model_1 >= model_2 THEN model_1 ELSE model_2 END AS model_hi,
             CASE WHEN model_1 >= model_2 THEN (CASE w WHEN 'model_1' THEN 'model_2' WHEN 'model_2' THEN 'model_1'
                  ELSE w END) ELSE w END AS winner, first_ord, src_ord,
             CASE WHEN model_1 >= model_2 THEN j2 ELSE j1 END AS j1, CASE WHEN model_1 >= model_2 THEN j1 ELSE j2 END AS j2 FROM r)
SELECT turn, question_id, model_lo, model_hi, arg_max(winner, first_ord) AS winner, arg_max(src_ord, first_ord) AS src_ord,
       arg_max(j1, first_ord) AS g1_judgment, arg_max(j2, first_ord) AS g2_judgment
FROM n GROUP BY turn, question_id, model_lo, model_hi""", "pair_judgments"))
def q_judgments_last_by_game(spark, sf_dir):
    g = J.judgments_last_by_game(fx.pair_judgments(_t(spark, sf_dir)))
    return g.select("turn", "question_id", "model_lo", "model_hi", "winner", "src_ord", "g1_judgment", "g2_judgment")


_MODELS8 = [f"m{i}" for i in range(8)]


@query("dedup_judgments_first", "D5", with_fixtures(
    "SELECT model, question_id, judge_prompt, ord, turn, score FROM (SELECT *, row_number() OVER (PARTITION BY model, "
    "question_id, judge_prompt ORDER BY ord) AS rn FROM single_judgments) z WHERE rn = 1 AND model IN ("
    + ", ".join(f"'{m}'" for m in _MODELS8) + ")", "single_judgments"))
def q_dedup_judgments_first(spark, sf_dir):
    d = J.dedup_judgments_first(fx.single_judgments(_t(spark, sf_dir)), models=_MODELS8)
    return d.select("model", "question_id", "judge_prompt", "ord", "turn", "score")


@query("dedup_answers_last", "D4", with_fixtures(
    "SELECT model, question_id, max(ord) AS ord, arg_max(score, ord) AS score FROM single_judgments "
    "GROUP BY model, question_id", "single_judgments"))
def q_dedup_answers_last(spark, sf_dir):
    d = J.dedup_answers_last(fx.single_judgments(_t(spark, sf_dir)).select("model", "question_id", "ord", "score"))
    return d.select("model", "question_id", "ord", "score")


_EXPECTED = [f"m{i}" for i in range(12)]


@query("missing_models", "U6", with_fixtures(
    "SELECT model FROM (VALUES " + ", ".join(f"('{m}')" for m in _EXPECTED) + ") e(model) "
    "WHERE model NOT IN (SELECT model FROM single_judgments)", "single_judgments"))
def q_missing_models(spark, sf_dir):
    seen = fx.single_judgments(_t(spark, sf_dir))
    expected = seen.sparkSession.createDataFrame([(m,) for m in _EXPECTED], "model string")
    return J.missing_models(expected, seen)


@query("votes_by_game", "A22", with_fixtures(
    "SELECT question_id, turn, least(model_a, model_b) AS model_lo, greatest(model_a, model_b) AS model_hi, "
    "CASE WHEN model_a >= model_b THEN (CASE winner WHEN 'model_a' THEN 'model_b' WHEN 'model_b' THEN 'model_a' "
    "ELSE winner END) ELSE winner END AS winner, CASE WHEN starts_with(judge, 'expert') THEN 'human' "
    "WHEN starts_with(judge, 'author') THEN 'author' WHEN starts_with(judge, 'gpt-4:pair') THEN 'gpt4-pair' END AS judge_group, "
    "ord FROM judge_votes", "judge_votes"))
def q_votes_by_game(spark, sf_dir):
    return J.votes_by_game(fx.judge_votes(_t(spark, sf_dir)))


_AGREE_SQL = with_fixtures("""
WITH v AS (SELECT turn, question_id, least(model_a, model_b) AS lo, greatest(model_a, model_b) AS hi,
                  CASE WHEN model_a >= model_b THEN (CASE winner WHEN 'model_a' THEN 'model_b' WHEN 'model_b'
                       THEN 'model_a' ELSE winner END) ELSE winner END AS w,
                  CASE WHEN starts_with(judge, 'expert') THEN 'human' WHEN starts_with(judge, 'gpt-4:pair')
                  THEN 'gpt4-pair' END AS g FROM judge_votes),
c AS (SELECT turn, question_id, lo, hi, CASE WHEN contains(w, 'tie') THEN 'tie' ELSE w END AS cls,
             COUNT(CASE WHEN g = 'gpt4-pair' THEN 1 END) AS nj, COUNT(CASE WHEN g = 'human' THEN 1 END) AS nh
      FROM v WHERE g IS NOT NULL GROUP BY ALL),
t AS (SELECT true AS with_tie UNION ALL SELECT false),
pg AS (SELECT turn, with_tie, question_id, lo, hi, SUM(nj * nh) AS ja, SUM(nj) * SUM(nh) AS jt,
              SUM(nh * (nh - 1) / 2) AS ha, SUM(nh) * (SUM(nh) - 1) / 2 AS ht
       FROM c JOIN t ON (t.with_tie OR c.cls <> 'tie') GROUP BY turn, with_tie, question_id, lo, hi),
a AS (SELECT turn, with_tie, CAST(SUM(ja) AS BIGINT) AS ja, CAST(SUM(jt) AS BIGINT) AS jt,
             CAST(SUM(ha) AS BIGINT) AS ha, CAST(SUM(ht) AS BIGINT) AS ht FROM pg GROUP BY turn, with_tie)
SELECT turn, with_tie, 'gpt4-pair_vs_human' AS pair, ja AS agree, jt AS total,
       round(CASE WHEN jt > 0 THEN ja / jt END, 6) AS ratio FROM a
UNION ALL
SELECT turn, with_tie, 'human_vs_human', ha, ht, round(CASE WHEN ht > 0 THEN ha / ht END, 6) FROM a""", "judge_votes")


@query("judge_agreement", "A21 J13 J14", _AGREE_SQL)
def q_judge_agreement(spark, sf_dir):
    return _r(J.judge_agreement(fx.judge_votes(_t(spark, sf_dir))))


@query("question_preview", "P43", with_fixtures(
    "SELECT category, question_id, CAST(question_id AS VARCHAR) || ': ' || substr(turns[1], 1, 128) || '...' AS preview "
    "FROM questions", "questions"))
def q_question_preview(spark, sf_dir):
    return J.question_preview(fx.questions(_t(spark, sf_dir)))


@query("resolve_judge", "P41 F26", with_fixtures(
    "SELECT question_id, category, CAST(t AS INTEGER) AS turn, 'pair' || CASE WHEN category IN ('math', 'reasoning', "
    "'coding', 'arena-hard-200') THEN '-math-v1' ELSE '-v2' END || CASE WHEN t >= 2 THEN '-multi-turn' ELSE '' END "
    "AS judge_prompt FROM (SELECT question_id, category, unnest(range(1, len(turns) + 1)) AS t FROM questions) z",
    "questions"))
def q_resolve_judge(spark, sf_dir):
    return J.resolve_judge(fx.questions(_t(spark, sf_dir)))


@query("match_single", "J8 A32", with_fixtures(
    "SELECT a.question_id, a.model_id, q.category, CAST(len(q.turns) AS INTEGER) AS n_turns FROM answers a "
    "JOIN questions q ON a.question_id = q.question_id", "answers"))
def q_match_single(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = J.match_single(fx.questions(t), fx.answers(t))
    return m.select("question_id", "model_id", "category", F.size("turns").alias("n_turns"))


@query("match_baseline", "J6", with_fixtures(
    "SELECT a.question_id, a.model_id, 'm0' AS baseline FROM answers a JOIN questions q ON a.question_id = q.question_id "
    "JOIN answers b ON b.question_id = a.question_id AND b.model_id = 'm0' WHERE a.model_id <> 'm0'", "answers"))
def q_match_baseline(spark, sf_dir):
    t = _t(spark, sf_dir)
    return J.match_baseline(fx.questions(t), fx.answers(t), "m0").select("question_id", "model_id", "baseline")


_PAIR_MODELS = [f"m{i}" for i in range(6)]


@query("match_all_pairs", "J7", with_fixtures(
    "SELECT a.question_id, a.model_id AS model_1, b.model_id AS model_2 FROM answers a JOIN answers b "
    "ON a.question_id = b.question_id AND a.model_id < b.model_id WHERE a.model_id IN ("
    + ", ".join(f"'{m}'" for m in _PAIR_MODELS) + ") AND b.model_id IN (" + ", ".join(f"'{m}'" for m in _PAIR_MODELS)
    + ")", "answers"))
def q_match_all_pairs(spark, sf_dir):
    t = _t(spark, sf_dir)
    return J.match_all_pairs(fx.questions(t), fx.answers(t), _PAIR_MODELS).select("question_id", "model_1", "model_2")


_CHECK_MODELS = [f"m{i}" for i in range(10)]


@query("check_completeness", "J9", with_fixtures(
    "SELECT q.question_id, m.model_id FROM questions q, (VALUES " + ", ".join(f"('{m}')" for m in _CHECK_MODELS)
    + ") m(model_id) WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.question_id = q.question_id "
    "AND a.model_id = m.model_id)", "answers"))
def q_check_completeness(spark, sf_dir):
    t = _t(spark, sf_dir)
    return J.check_completeness(fx.answers(t), fx.questions(t), _CHECK_MODELS)


@query("explanation_view", "P40", with_fixtures("""
WITH r AS (SELECT turn, question_id, model_1, model_2, min(ord) AS first_ord, arg_max(g1_judgment, ord) AS j1,
                  arg_max(g2_judgment, ord) AS j2 FROM pair_judgments GROUP BY turn, question_id, model_1, model_2),
n AS (SELECT turn, question_id, first_ord, CASE WHEN model_1 = 'm3' THEN j1 ELSE j2 END AS as_a,
             CASE WHEN model_1 = 'm3' THEN j2 ELSE j1 END AS as_b FROM r
      WHERE (model_1 = 'm3' AND model_2 = 'm1') OR (model_1 = 'm1' AND model_2 = 'm3')),
g AS (SELECT turn, question_id, arg_max(as_a, first_ord) AS g1, arg_max(as_b, first_ord) AS g2 FROM n GROUP BY turn, question_id)
SELECT q.question_id, 1 AS turn, 'm3' AS model_a, 'm1' AS model_b, coalesce('**Game 1**. **A**: m3, **B**: m1' || chr(10) || chr(10) ||
       '**Judgment**: ' || g.g1 || chr(10) || chr(10) || '`--------------------------`' || chr(10) || chr(10) ||
       '**Game 2**. **A**: m1, **B**: m3' || chr(10) || chr(10) || '**Judgment**: ' || g.g2, 'N/A') AS explanation
FROM questions q LEFT JOIN g ON g.question_id = q.question_id AND g.turn = 1""", "pair_judgments", "questions"))
def q_explanation_view(spark, sf_dir):
    t = _t(spark, sf_dir)
    games = fx.questions(t).select("question_id", F.lit(1).alias("turn"))
    return J.explanation_view(games, J.judgments_last_by_game(fx.pair_judgments(t)), "m3", "m1")


_REF_SQL = ("refs AS (SELECT question_id, list_transform(turns, lambda x: 'Reference for: ' || x) AS turns FROM questions "
            "WHERE question_id % 4 <> 0)")
_HEAD = "CASE WHEN q.category = 'math' THEN 'Reference: ' || r.turns[1] || chr(10) ELSE '' END"


def _verdict(h: str) -> str:
    return f"CASE WHEN {h} IS NULL THEN 'error' WHEN {h}[1] < '6' THEN 'A' WHEN {h}[1] < 'c' THEN 'B' WHEN {h}[1] < 'f' THEN 'tie' ELSE 'error' END"


@query("judge_run_pairs", "X4 F12 J6 J7 X1", with_fixtures(f"""
WITH {_REF_SQL}, m AS (
  SELECT q.question_id, a.model_id AS model_1, b.model_id AS model_2,
         CASE WHEN q.category = 'math' THEN 'pair-math-v1' ELSE 'pair-v2' END AS judge_prompt,
         'Compare the two answers.' || chr(10) || chr(10) || {_HEAD} || 'Q: ' || q.turns[1] || chr(10) || 'A: ' AS head,
         a.model_id || ' says: ' || q.turns[1] AS x, b.model_id || ' says: ' || q.turns[1] AS y
  FROM questions q JOIN answers a ON a.question_id = q.question_id JOIN answers b ON b.question_id = q.question_id
       AND a.model_id < b.model_id LEFT JOIN refs r ON r.question_id = q.question_id
  WHERE a.model_id IN ('m0', 'm1', 'm2', 'm3', 'm4', 'm5') AND b.model_id IN ('m0', 'm1', 'm2', 'm3', 'm4', 'm5')),
p AS (SELECT *, head || x || chr(10) || 'B: ' || y AS p1, head || y || chr(10) || 'B: ' || x AS p2 FROM m),
v AS (SELECT *, {_verdict("md5(p1)")} AS v1, {_verdict("md5(p2)")} AS v2 FROM p)
SELECT question_id, model_1, model_2, judge_prompt, 1 AS turn, md5(p1) AS g1_md5, md5(p2) AS g2_md5,
       CASE v1 WHEN 'A' THEN 'model_1' WHEN 'B' THEN 'model_2' ELSE v1 END AS g1_winner,
       CASE v2 WHEN 'A' THEN 'model_2' WHEN 'B' THEN 'model_1' ELSE v2 END AS g2_winner FROM v""", "answers"))
def q_judge_run_pairs(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = J.match_all_pairs(fx.questions(t), fx.answers(t), _PAIR_MODELS)
    m = m.select("question_id", "category", "turns", "model_1", "model_2",
                 F.col("answer_1")[0]["turns"].alias("answer_1"), F.col("answer_2")[0]["turns"].alias("answer_2"))
    out = J.judge_pairs(J.attach_references(m, fx.reference_answers(t)), fx.judge_prompts(t), stub_judge, missing="skip")
    return out.select("question_id", "model_1", "model_2", "judge_prompt", "turn", F.md5("g1_user_prompt").alias("g1_md5"),
                      F.md5("g2_user_prompt").alias("g2_md5"), "g1_winner", "g2_winner")


@query("judge_run_singles", "X4 F12 J8 X1", with_fixtures(f"""
WITH {_REF_SQL}, p AS (
  SELECT q.question_id, a.model_id, CASE WHEN q.category = 'math' THEN 'single-math-v1' ELSE 'single-v1' END || '-multi-turn' AS judge_prompt,
         'Grade the answer.' || chr(10) || chr(10) || {_HEAD} || 'Q1: ' || q.turns[1] || chr(10) || 'A1: ' || a.model_id || ' says: ' ||
         q.turns[1] || chr(10) || 'Q2: ' || q.turns[2] || chr(10) || 'A2: ' || a.model_id || ' says: ' || q.turns[2] AS prompt
  FROM questions q JOIN answers a ON a.question_id = q.question_id LEFT JOIN refs r ON r.question_id = q.question_id
  WHERE len(q.turns) >= 2)
SELECT question_id, model_id, judge_prompt, 2 AS turn, md5(prompt) AS prompt_md5,
       coalesce(CAST((strpos('0123456789abcdef', md5(prompt)[2]) - 1) % 10 + 1 AS DOUBLE), -1) AS score FROM p""", "answers"))
def q_judge_run_singles(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = J.match_single(fx.questions(t), fx.answers(t)).filter(F.size("turns") >= 2)
    m = m.select("question_id", "category", "turns", "model_id", F.col("choices")[0]["turns"].alias("answer"))
    out = J.judge_singles(J.attach_references(m, fx.reference_answers(t)), fx.judge_prompts(t), stub_judge, multi_turn=True, missing="skip")
    return out.select("question_id", "model_id", "judge_prompt", "turn", F.md5("user_prompt").alias("prompt_md5"), "score")


@query("missing_references", "J9", with_fixtures(
    "SELECT question_id FROM questions WHERE category = 'math' AND question_id % 4 = 0", "questions"))
def q_missing_references(spark, sf_dir):
    t = _t(spark, sf_dir)
    return J.missing_references(fx.questions(t), fx.reference_answers(t))
