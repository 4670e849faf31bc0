"""Registered queries: chat release cleaning and statistics, splits and unions,
leaderboard rendering and joins, metric collation, scalar text helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coheral.functions import text as TX
from coheral.functions.text import split_sentences
from coheral.operators import arena as A
from coheral.operators import judge as J
from coheral.operators import metrics as M
from coheral.operators import pairs as P
from coheral.operators import ratings as R
from coheral.operators.conversations import merge_files
from coheral.operators.external import hashed_embedding
from coheral.plans.arena_queries import _ARENA_LOG_CTE
from coheral.plans.conversation_queries import _lang_sql
from coheral.plans.metric_queries import _avg_sql, _per_class_sql, _r
from coheral.plans.oracle_fixtures import with_fixtures
from coheral.plans.registry import query
from coheral.sources import fixtures as fx
from coheral.sources.tables import Tables


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


# ------------------------------------------------------------------ P24 / A14
_NET = A.NETWORK_ERROR_MSG.lower()
_CHAT_CTE = _ARENA_LOG_CTE + f""",
k AS (SELECT * FROM log WHERE type = 'chat' AND conv0 IS NOT NULL AND hid0 IS NOT NULL AND len(msg0) > 0
        AND NOT list_bool_or(list_transform(msg0, lambda m: m[2] IS NULL))
        AND NOT contains(lower(array_to_string(list_transform(msg0, lambda m: m[2]), '')), '{_NET}')),
u AS (SELECT ip, row_number() OVER (ORDER BY min(ord), ip) - 1 AS user_id FROM k GROUP BY ip),
cc AS (SELECT conv0 AS conversation_id, arg_max(hid0, (tstamp, ord)) AS model,
              arg_max(CAST(len(msg0) // 2 AS INTEGER), (tstamp, ord)) AS turn,
              arg_max(u.user_id, (tstamp, ord)) AS user_id, arg_max(k.ord, (tstamp, ord)) AS ord,
              arg_max(msg0, (tstamp, ord)) AS msg0
       FROM k JOIN u ON k.ip = u.ip GROUP BY conv0)"""


def _clean_chats(spark, sf_dir) -> DataFrame:
    return A.clean_chats(fx.arena_log(_t(spark, sf_dir)), "chat")


@query("clean_chats", "P24 D3 D14 F15", with_fixtures(
    f"WITH {_CHAT_CTE} SELECT conversation_id, model, turn, user_id, ord FROM cc", "activity"))
def q_clean_chats(spark, sf_dir):
    return _clean_chats(spark, sf_dir).select("conversation_id", "model", "turn", "user_id", "ord")


_TOKS = "len(regexp_extract_all({v}, '[^ \\t\\n\\r]+'))"


@query("release_stats", "A14 X7", with_fixtures(
    f"WITH {_CHAT_CTE}, l AS (SELECT *, {_lang_sql('msg0[1][2]')} AS language FROM cc), "
    "m AS (SELECT CASE WHEN i % 2 = 0 THEN " + _TOKS.format(v="msg0[i + 1][2]") + " END AS p, "
    "CASE WHEN i % 2 = 1 THEN " + _TOKS.format(v="msg0[i + 1][2]") + " END AS r "
    "FROM (SELECT msg0, unnest(range(len(msg0))) AS i FROM cc) z) "
    "SELECT COUNT(*) AS n_conversations, COUNT(DISTINCT user_id) AS n_users, COUNT(DISTINCT model) AS n_models, "
    "COUNT(DISTINCT language) AS n_languages, round(AVG(turn), 6) AS avg_turns, "
    "(SELECT round(AVG(p), 6) FROM m) AS avg_prompt_tokens, (SELECT round(AVG(r), 6) FROM m) AS avg_response_tokens "
    "FROM l", "activity"))
def q_release_stats(spark, sf_dir):
    return _r(A.release_stats(_clean_chats(spark, sf_dir)))


@query("language_counts", "A14", with_fixtures(
    f"WITH {_CHAT_CTE} SELECT language, COUNT(*) AS n FROM (SELECT {_lang_sql('msg0[1][2]')} AS language FROM cc) z "
    "GROUP BY language ORDER BY n DESC, language LIMIT 25", "activity"))
def q_language_counts(spark, sf_dir):
    return A.language_counts(_clean_chats(spark, sf_dir))


# ---------------------------------------------------------- D18, U7, A17
def _stories(spark, sf_dir) -> DataFrame:
    t = _t(spark, sf_dir)
    e = fx.essays(t).join(fx.topics(t), "prompt_id")
    return e.select(F.col("ord").alias("uid"), F.col("topic").alias("title"), "text")


_CUT = format(int(0.85 * 16 ** 13), "013x")
_SPLIT_SQL = with_fixtures(
    "SELECT e.ord AS uid, CASE WHEN substr(md5('42:' || t.topic), 1, 13) < '" + _CUT + "' THEN 'train' ELSE 'dev' END "
    "AS split FROM essays e JOIN topics t ON e.prompt_id = t.prompt_id", "essays", "topics")


@query("split_by_title", "D18 S13", _SPLIT_SQL)
def q_split_by_title(spark, sf_dir):
    return P.split_by_title(_stories(spark, sf_dir)).select("uid", "split")


@query("all_splits", "U7", with_fixtures(
    "SELECT split, COUNT(*) AS n FROM (SELECT CASE WHEN substr(md5('42:' || t.topic), 1, 13) < '" + _CUT + "' "
    "THEN 'train' ELSE 'dev' END AS split FROM essays e JOIN topics t ON e.prompt_id = t.prompt_id) z GROUP BY split",
    "essays", "topics"))
def q_all_splits(spark, sf_dir):
    s = P.split_by_title(_stories(spark, sf_dir))
    parts = [s.filter(F.col("split") == x) for x in ("train", "dev")]
    return parts[0].unionByName(parts[1]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("consensus_scores", "A17", with_fixtures(
    "WITH s AS (SELECT e.ord, t.topic AS title, e.text, CAST(2 * l.quality + l.toxic AS INTEGER) AS hol, "
    "CAST(coalesce(a.n, 0) AS INTEGER) AS inc FROM essays e JOIN topics t ON e.prompt_id = t.prompt_id JOIN labels l ON l.doc_id = e.ord "
    "LEFT JOIN (SELECT story_id, COUNT(*) AS n FROM annotations GROUP BY story_id) a ON a.story_id = e.ord) "
    "SELECT 'holistic' AS kind, title, md5(text) AS text_md5, hol AS consensus FROM s "
    "UNION ALL SELECT 'incremental', title, md5(text), inc FROM s", "essays", "topics", "annotations"))
def q_consensus_scores(spark, sf_dir):
    t = _t(spark, sf_dir)
    lab = t.labels.select(F.col("doc_id").alias("uid"), (2 * F.col("quality") + F.col("toxic")).cast("int").alias("holistic_consensus"))
    inc = fx.annotations(t).groupBy(F.col("story_id").alias("uid")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    s = (_stories(spark, sf_dir).join(lab, "uid").join(inc, "uid", "left")
         .withColumn("incremental_consensus", F.coalesce("n", F.lit(0))))
    both = [x.select(F.lit(k).alias("kind"), "title", F.md5("text").alias("text_md5"), "consensus")
            for k, x in zip(("holistic", "incremental"), P.consensus_scores(s))]
    return both[0].unionByName(both[1])


# ------------------------------------------------------------ U2, U3, P4
_TASKS = ["sent_binary", "sent_cohesion", "sent_consistency", "sent_relevance"]


@query("concat_tasks", "U2", with_fixtures(
    "SELECT ord, CASE task " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(_TASKS)) +
    " END AS task_ids, gold, pred FROM preds", "preds"))
def q_concat_tasks(spark, sf_dir):
    p = fx.preds(_t(spark, sf_dir))
    ids = F.lit(None).cast("int")
    for i, t in enumerate(_TASKS):
        ids = F.when(F.col("task") == t, i).otherwise(ids)
    return p.filter(F.col("task").isin(_TASKS)).select("ord", ids.alias("task_ids"), "gold", "pred")


@query("combine_corpora", "U3", with_fixtures(
    "SELECT source, COUNT(*) AS n FROM (SELECT 'pairs' AS source FROM (SELECT unnest(range(1, len(sents))) FROM "
    "essay_sents s JOIN topics t ON s.prompt_id = t.prompt_id) a UNION ALL SELECT 'stories' FROM (SELECT "
    "unnest(range(0, len(sents))) FROM essay_sents s JOIN topics t ON s.prompt_id = t.prompt_id) b) z GROUP BY source",
    "essay_sents", "topics"))
def q_combine_corpora(spark, sf_dir):
    t = _t(spark, sf_dir)
    pairs = P.incremental_pairs(fx.essays(t), fx.topics(t)).select(
        F.col("context").alias("sent1"), F.col("sentence").alias("sent2"), F.lit("pairs").alias("source"))
    st = _stories(spark, sf_dir).select("uid", "title", split_sentences("text").alias("sents"))
    stories = P.story_pairs_long(st).select("sent1", "sent2", F.lit("stories").alias("source"))
    return merge_files(pairs, stories).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("two_sentence_pairs", "P4 P8", with_fixtures("""
SELECT CAST(ord * 100000 + sent_idx AS VARCHAR) || '-0' AS guid, array_to_string(sents[1:sent_idx], ' ') AS sent1,
       sents[sent_idx + 1] AS sent2, CAST((ord * 100000 + sent_idx) % 2 AS INTEGER) AS label
FROM (SELECT s.ord, s.sents, unnest(range(1, len(s.sents))) AS sent_idx
      FROM essay_sents s JOIN topics t ON s.prompt_id = t.prompt_id) x""", "essay_sents", "topics"))
def q_two_sentence_pairs(spark, sf_dir):
    t = _t(spark, sf_dir)
    e = fx.essays(t)
    p = P.incremental_pairs(e, fx.topics(t), carry=("ord",))
    p = p.withColumn("label", ((F.col("ord") * 100000 + F.col("sent_idx")) % 2).cast("int"))
    # P4 consumes the story-format rows of P8: (uid, sents = [context, sentence], labels map)
    rows = p.select((F.col("ord") * 100000 + F.col("sent_idx")).alias("uid"),
                    F.array("context", "sentence").alias("sents"),
                    F.create_map(F.lit("sent0"), F.lit(False), F.lit("sent1"), F.col("label") == 1).alias("labels"))
    return P.two_sentence_pairs(rows)


# ------------------------------------------------------------ A28, J10, J11
_NB = ("nb AS (SELECT coalesce(a.model, b.model) AS model, coalesce(a.n, 0) + coalesce(b.n, 0) AS num_battles FROM "
       "(SELECT model_a AS model, COUNT(*) AS n FROM battles WHERE anony GROUP BY 1) a FULL JOIN "
       "(SELECT model_b AS model, COUNT(*) AS n FROM battles WHERE anony GROUP BY 1) b ON a.model = b.model)")
_AW = ("nt AS (SELECT * FROM battles WHERE anony AND NOT contains(winner, 'tie')), "
       "bo AS (SELECT model_a AS row, model_b AS col, CAST(winner = 'model_a' AS INTEGER) AS won FROM nt "
       "UNION ALL SELECT model_b, model_a, CAST(winner = 'model_b' AS INTEGER) FROM nt), "
       "aw AS (SELECT row AS model, AVG(f) AS avg_win_rate FROM (SELECT row, col, SUM(won) / COUNT(*) AS f FROM bo "
       "GROUP BY row, col) z GROUP BY row)")


def _anon(spark, sf_dir):
    return fx.battles(_t(spark, sf_dir)).filter(F.col("anony"))


@query("leaderboard_csv_render", "A28 K9", with_fixtures(
    f"WITH {_NB}, {_AW} SELECT nb.model, coalesce(CAST(round(aw.avg_win_rate, 3) AS VARCHAR), '-') AS score, "
    "CAST(nb.num_battles AS VARCHAR) AS num_battles FROM nb LEFT JOIN aw ON nb.model = aw.model", "battles"))
def q_leaderboard_csv_render(spark, sf_dir):
    b = _anon(spark, sf_dir)
    aw = R.average_win_rate(b.filter(~F.col("winner").contains("tie")))
    t = R.num_battles(b).join(aw, "model", "left").withColumn("score", F.round("avg_win_rate", 3))
    return R.leaderboard_csv_render(t, "score", ["model", "score", "num_battles"])


@query("leaderboard_join", "J10 J11 D10", with_fixtures(
    f"WITH {_NB}, {_AW} SELECT aw.model, round(aw.avg_win_rate, 6) AS avg_win_rate, nb.num_battles, "
    "CAST(row_number() OVER (ORDER BY round(aw.avg_win_rate, 9) DESC, aw.model) AS INTEGER) AS rank, "
    "coalesce(i.link, '-') AS link_or_default, coalesce(i.description, '-') AS description_or_default "
    "FROM aw LEFT JOIN nb ON aw.model = nb.model LEFT JOIN model_info i ON i.model = aw.model",
    "battles", "model_info"))
def q_leaderboard_join(spark, sf_dir):
    b = _anon(spark, sf_dir)
    aw = R.average_win_rate(b.filter(~F.col("winner").contains("tie")))
    aw = aw.withColumn("_key", F.round("avg_win_rate", 9))  # rank on a value both engines agree on
    ranked = R.rank_ratings(aw, "_key").join(R.num_battles(b), "model", "left")
    out = R.leaderboard_join(ranked, fx.model_info(_t(spark, sf_dir)))
    return _r(out.select("model", "avg_win_rate", "num_battles", "rank", "link_or_default", "description_or_default"))


@query("model_info_lookup", "J11", with_fixtures(
    "SELECT e.model, coalesce(r.simple_name, e.model) AS simple_name, coalesce(r.link, '') AS link, "
    "coalesce(r.description, '') AS description FROM (SELECT DISTINCT 'm' || CAST(user_id % 40 AS VARCHAR) AS model FROM events) e "
    "LEFT JOIN model_info r ON e.model = r.model", "model_info"))
def q_model_info_lookup(spark, sf_dir):
    t = _t(spark, sf_dir)
    names = t.events.select(F.concat(F.lit("m"), (F.col("user_id") % 40).cast("string")).alias("model")).distinct()
    return R.model_info_lookup(names, fx.model_info(t)).select("model", "simple_name", "link", "description")


# --------------------------------------------------------------- A30, A32
@query("metric_collation", "A30", with_fixtures(
    "WITH mp AS (SELECT p.*, d.source AS model FROM preds p JOIN documents d ON p.ord = d.doc_id), "
    f"{_per_class_sql('mp', ['model', 'task'], 0.0)}\nSELECT model, task, {_avg_sql(0.0)} FROM pc GROUP BY model, task",
    "preds"))
def q_metric_collation(spark, sf_dir):
    t = _t(spark, sf_dir)
    p = fx.preds(t).join(t.documents.select(F.col("doc_id").alias("ord"), F.col("source").alias("model")), "ord")
    return _r(M.metric_collation(p, "model", "task"))


@query("judge_stats", "A32", with_fixtures(
    "SELECT COUNT(*) AS n_matches, COUNT(DISTINCT model_id) AS n_models, COUNT(DISTINCT a.question_id) AS n_questions "
    "FROM answers a JOIN questions q ON a.question_id = q.question_id", "answers"))
def q_judge_stats(spark, sf_dir):
    t = _t(spark, sf_dir)
    return J.judge_stats(J.match_single(fx.questions(t), fx.answers(t)))


# ------------------------------------------------------ F5-F8, F25, F26, X6
@query("text_helpers", "F5 F6 F7 F8", """
SELECT conv_id, turn,
  md5(regexp_replace(regexp_replace(replace(text, '•', '- '), '\\n\\n(\\d+\\. )', chr(10) || '\\1', 'g'), '\\n\\n(- )', chr(10) || '\\1', 'g'))
    AS post_md5,
  (ends_with(text, '.') OR ends_with(text, '?') OR ends_with(text, '!') OR ends_with(text, '...') OR ends_with(text, '。')
   OR ends_with(text, '？') OR ends_with(text, '！') OR ends_with(text, '…') OR ends_with(text, '"')
   OR ends_with(text, '''') OR ends_with(text, '”')) AS complete,
  coalesce(list_bool_or(list_transform(range(0, least(length(text), 3)), lambda i:
     starts_with('er.', CASE WHEN i = 0 THEN text ELSE right(text, CAST(i AS INTEGER)) END))), false) AS partial_stop,
  CAST(length(regexp_replace(CASE WHEN f IS NOT NULL THEN substr(text, 1, f - 1) ELSE text END, '^\\s+|\\s+$', '', 'g')) AS INTEGER)
    AS trimmed_len
FROM (SELECT *, least(CASE WHEN strpos(text, '.') > 1 THEN strpos(text, '.') END,
                     CASE WHEN strpos(text, chr(10)) > 1 THEN strpos(text, chr(10)) END) AS f FROM conversations) c""")
def q_text_helpers(spark, sf_dir):
    c = _t(spark, sf_dir).conversations
    return c.select("conv_id", "turn", F.md5(TX.post_process_answer("text")).alias("post_md5"),
                    TX.is_sentence_complete("text").alias("complete"),
                    TX.is_partial_stop("text", "er.").alias("partial_stop"),
                    F.length(TX.trim_at_stop("text", [".", "\n"])).alias("trimmed_len"))


_FAMS = ["bert-base-uncased", "deberta-v3-large", "flan-t5-large", "t5-base", "gpt-3.5-turbo", "text-davinci-003"]


@query("model_family_and_temperature", "F25 F26", with_fixtures(
    "SELECT q.question_id, CASE WHEN contains(n, 'deberta') THEN 'deberta' WHEN contains(n, 'bert') THEN 'bert' "
    "WHEN contains(n, 'flan') THEN 'flan_t5' WHEN contains(n, 't5') THEN 't5' WHEN contains(n, 'gpt') THEN 'chatgpt' "
    "WHEN contains(n, 'davinci') THEN 'gpt_davinci' END || CASE WHEN contains(n, 'base') THEN '_base' "
    "WHEN contains(n, 'large') THEN '_large' ELSE '' END AS family, "
    "CAST(CASE category WHEN 'math' THEN 0.0 ELSE 0.7 END AS DOUBLE) AS temperature FROM (SELECT *, [" + ", ".join(f"'{x}'" for x in _FAMS)
    + "][question_id % 6 + 1] AS n FROM questions) q", "questions"))
def q_model_family_and_temperature(spark, sf_dir):
    q = fx.questions(_t(spark, sf_dir))
    n = F.element_at(F.array(*[F.lit(x) for x in _FAMS]), (F.col("question_id") % 6 + 1).cast("int"))
    return q.select("question_id", TX.model_to_name(n).alias("family"), TX.temperature("category").alias("temperature"))


@query("embed_texts", "X6 F23")
def q_embed_texts(spark, sf_dir):
    d = _t(spark, sf_dir).documents
    e = hashed_embedding(d.select("doc_id", "text"), "text", 64)
    return e.select("doc_id", F.size("embedding").alias("dim"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sq_norm"))
