"""Registered queries: conversation cleaning, filtering, splitting, sampling, corpus statistics."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coheral.functions.hashing import hash_key
from coheral.functions.subword import Subwords
from coheral.functions.text import word_count
from coheral.operators import conversations as C
from coheral.operators import ordering as O
from coheral.plans.metric_queries import _r
from coheral.plans.oracle_fixtures import with_fixtures
from coheral.plans.registry import query
from coheral.sources import fixtures as fx
from coheral.sources.tables import Tables


def _chats(spark, sf_dir) -> DataFrame:
    return fx.chats(Tables(spark, sf_dir))


def _flat(df: DataFrame, *extra) -> DataFrame:
    """Scalar fingerprint of a conversation: message count, role sequence, md5 of the values."""
    conv = F.col("conversations")
    return df.select("id", *extra, F.size(conv).alias("n_msgs"),
                     F.array_join(F.transform(conv, lambda m: m["from"]), ",").alias("roles"),
                     F.md5(F.array_join(F.transform(conv, lambda m: m["value"]), "\n")).alias("text_md5"))


def _flat_sql(src: str, extra: str = "", conv: str = "conversations") -> str:
    return (f"SELECT id{extra}, CAST(len({conv}) AS INTEGER) AS n_msgs, "
            f"array_to_string(list_transform({conv}, lambda m: m.\"from\"), ',') AS roles, "
            f"md5(array_to_string(list_transform({conv}, lambda m: m.value), chr(10))) AS text_md5 FROM {src}")


@query("first_round", "P11 F16", with_fixtures(_flat_sql("chats", conv="conversations[1:2]"), "chats"))
def q_first_round(spark, sf_dir):
    return _flat(C.first_round(_chats(spark, sf_dir)))


@query("gpt4_only", "P12", with_fixtures("SELECT id, model FROM chats WHERE model IS NULL OR model = 'gpt4'", "chats"))
def q_gpt4_only(spark, sf_dir):
    return C.gpt4_only(_chats(spark, sf_dir)).select("id", "model")


@query("filter_wrong_format", "P13", with_fixtures(
    "SELECT id FROM chats WHERE NOT list_bool_or(list_transform(conversations, lambda m: "
    "regexp_matches(m.value, '\\n1\\. [^2]*\\n1\\. ')))", "chats"))
def q_filter_wrong_format(spark, sf_dir):
    return C.filter_wrong_format(_chats(spark, sf_dir)).select("id")


@query("filter_repeated_digits", "P14", with_fixtures(
    "SELECT id FROM chats WHERE NOT list_bool_or(list_transform(conversations, lambda m: regexp_matches(m.value, '"
    + "|".join(f"{d}{{9}}" for d in range(10)) + "')))", "chats"))
def q_filter_repeated_digits(spark, sf_dir):
    return C.filter_repeated_digits(_chats(spark, sf_dir)).select("id")


@query("filter_invalid_roles", "P16", with_fixtures(
    "SELECT id FROM chats WHERE len(conversations) > 0 AND list_bool_and(list_transform(conversations, "
    "lambda m, i: m.\"from\" = CASE WHEN (i - 1) % 2 = 0 THEN 'human' ELSE 'gpt' END))", "chats"))
def q_filter_invalid_roles(spark, sf_dir):
    return C.filter_invalid_roles(_chats(spark, sf_dir)).select("id")


@query("enforce_limits", "P44", with_fixtures(
    "SELECT id, CAST(len(conversations) AS INTEGER) AS n_msgs, "
    "CAST(list_max(list_transform(conversations, lambda m: length(substr(m.value, 1, 2000)))) AS INTEGER) AS max_len "
    "FROM chats WHERE len(conversations) // 2 < 4", "chats"))
def q_enforce_limits(spark, sf_dir):
    c = C.enforce_limits(_chats(spark, sf_dir), max_chars=2000, max_rounds=4)
    return c.select("id", F.size("conversations").alias("n_msgs"),
                    F.array_max(F.transform("conversations", lambda m: F.length(m["value"]))).alias("max_len"))


_SPECIAL = ["<s>", "</s>", "Ai", "x"]


@query("escape_special_tokens", "P19", with_fixtures(_flat_sql(
    "(SELECT id, list_transform(conversations, lambda m: {'from': m.\"from\", 'value': "
    "replace(replace(replace(replace(m.value, '<s>', '<|s|>'), '</s>', '<|/s|>'), 'Ai', 'A|i'), 'x', ' ')}) "
    "AS conversations FROM chats) z"), "chats"))
def q_escape_special_tokens(spark, sf_dir):
    return _flat(C.escape_special_tokens(_chats(spark, sf_dir), _SPECIAL))


@query("alpaca_to_chat", "P10 T7 F14", """
SELECT 'alpaca_' || CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN length(regexp_replace(inp, '^\\s+|\\s+$', '', 'g')) > 1 THEN instr_ || chr(10) || 'Input:' || chr(10) || inp
            ELSE instr_ END AS prompt, md5(text) AS output_md5
FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS instr_, split_part(text, chr(10), 2) AS inp FROM documents) z""")
def q_alpaca_to_chat(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    parts = F.split("text", "\n")
    rows = d.select(F.col("doc_id").alias("ord"), parts[0].alias("instruction"),
                    F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("input"), F.col("text").alias("output"))
    c = C.alpaca_to_chat(rows)
    return c.select("id", F.col("conversations")[0]["value"].alias("prompt"),
                    F.md5(F.col("conversations")[1]["value"]).alias("output_md5"))


def _lang_sql(text: str) -> str:
    words = f"regexp_split_to_array(lower({text}), '[^\\pL]+')"
    cnt = {n: f"len(list_filter({words}, lambda w: list_contains([{', '.join(repr(x) for x in sw)}], w)))"
           for n, sw in C.STOPWORDS.items()}
    best = f"greatest({', '.join(cnt.values())})"
    cases = " ".join(f"WHEN {c} = {best} THEN '{n}'" for n, c in cnt.items())
    return f"CASE WHEN {text} IS NULL THEN 'unknown' WHEN {best} <= 0 THEN 'unknown' {cases} END"


@query("detect_language", "P15", f"SELECT doc_id, lang, {_lang_sql('text')} AS detected FROM documents")
def q_detect_language(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", "lang", C.detect_language("text").alias("detected"))


@query("filter_language", "P15", with_fixtures(
    "SELECT id, lang FROM (SELECT id, " + _lang_sql("array_to_string(list_transform(conversations, lambda m: m.value), "
                                                    "chr(10))") + " AS lang FROM chats) z WHERE lang <> 'German'",
    "chats"))
def q_filter_language(spark, sf_dir):
    return C.filter_language(_chats(spark, sf_dir), skip_lang="German").select("id", "lang")


@query("html_to_markdown", "P18")
def q_html_to_markdown(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    md = C.html_to_markdown("html")
    return p.select("page_id", F.length(md).alias("md_chars"), F.md5(md).alias("md_md5"))


@query("clean_html_conversation", "P17 P18 F9 A31")
def q_clean_html_conversation(spark, sf_dir):
    h = C.clean_html_conversation(fx.html_chats(Tables(spark, sf_dir)))
    return _flat(h, "error_code")


def _dup_chats(spark, sf_dir) -> DataFrame:
    """Chats with ids shared by consecutive conversations and recycled first exchanges.

    Conversation k reuses the first two messages of conversation k - 5 when
    k % 7 == 0, and ids are ``k // 2`` -- so both dedup rules fire.
    """
    c = _chats(spark, sf_dir)
    donor = c.select((F.col("ord") + 5).alias("ord"), F.slice("conversations", 1, 2).alias("head"))
    j = c.join(donor, "ord", "left")
    conv = F.when((F.col("ord") % 7 == 0) & F.col("head").isNotNull() & (F.size("conversations") >= 2),
                  F.concat("head", F.slice("conversations", 3, F.greatest(F.size("conversations") - 2, F.lit(0)))))
    return j.select(F.floor(F.col("ord") / 2).cast("string").alias("id"), "ord", "model",
                    F.when(F.col("ord") % 11 == 5, F.lit("web")).cast("string").alias("plugins"),
                    F.coalesce(conv, F.col("conversations")).alias("conversations"))


_DUP_CTE = """src AS (SELECT CAST(c.ord // 2 AS VARCHAR) AS id, c.ord, c.ord % 11 = 5 AS plugin,
           CASE WHEN c.ord % 7 = 0 AND d.conversations IS NOT NULL AND len(c.conversations) >= 2
                THEN d.conversations[1:2] || c.conversations[3:] ELSE c.conversations END AS conv
    FROM chats c LEFT JOIN chats d ON c.ord = d.ord + 5),
keyed AS (SELECT id, ord, plugin, row_number() OVER (ORDER BY ord) AS n, conv[1].value || chr(0) || conv[2].value AS k FROM src),
walk(n, ids, keys, id, ord, reason) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), ''
  UNION ALL
  SELECT r.n, CASE WHEN why = 'kept' THEN list_append(w.ids, r.id) ELSE w.ids END,
         CASE WHEN why = 'kept' THEN list_append(w.keys, r.k) ELSE w.keys END, r.id, r.ord, why
  FROM walk w JOIN keyed r ON r.n = w.n + 1,
       LATERAL (SELECT CASE WHEN list_contains(w.ids, r.id) THEN 'id_duplication' WHEN r.plugin THEN 'plugin'
                            WHEN r.k IS NOT NULL AND list_contains(w.keys, r.k) THEN 'value_duplication' ELSE 'kept' END AS why) l)"""


@query("dedup_conversations", "D1", with_fixtures(f"WITH RECURSIVE {_DUP_CTE} SELECT id, ord FROM walk WHERE reason = 'kept'", "chats"))
def q_dedup_conversations(spark, sf_dir):
    return C.dedup_conversations(_dup_chats(spark, sf_dir)).select("id", "ord")


@query("dedup_reasons", "D1 A31", with_fixtures(f"WITH RECURSIVE {_DUP_CTE} SELECT ord, reason FROM walk WHERE n > 0", "chats"))
def q_dedup_reasons(spark, sf_dir):
    return C.dedup_reasons(_dup_chats(spark, sf_dir))


_TOK = "len(regexp_extract_all({v}, '[^ \\t\\n\\r]+'))"
_STATS_CTE = ("per AS (SELECT id, len(conversations) // 2 AS turns, conversations FROM chats), "
              "pr AS (SELECT id, turns, " + _TOK.format(v="conversations[2 * i + 1].value") + " AS p, "
              + _TOK.format(v="conversations[2 * i + 2].value") + " AS r FROM "
              "(SELECT id, turns, conversations, unnest(range(0, turns)) AS i FROM per WHERE turns > 0) z), "
              "lens AS (SELECT per.id, per.turns, coalesce((SELECT SUM(p + r) FROM pr WHERE pr.id = per.id), 0) AS len "
              "FROM per)")


@query("corpus_stats", "A15", with_fixtures(
    f"WITH {_STATS_CTE} SELECT COUNT(*) AS n_conversations, CAST(SUM(len) AS BIGINT) AS n_tokens, "
    "round(AVG(turns), 6) AS avg_turns, (SELECT round(AVG(p), 6) FROM pr) AS avg_prompt_len, "
    "(SELECT round(AVG(r), 6) FROM pr) AS avg_response_len FROM lens", "chats"))
def q_corpus_stats(spark, sf_dir):
    return _r(C.corpus_stats(_chats(spark, sf_dir))[0])


@query("corpus_histogram", "A15", with_fixtures(
    f"WITH {_STATS_CTE}, b AS (SELECT CASE WHEN len >= 16384 AND len <= 32768 THEN 5 WHEN len >= 8192 AND len < 16384 "
    "THEN 4 WHEN len >= 4096 AND len < 8192 THEN 3 WHEN len >= 2048 AND len < 4096 THEN 2 WHEN len >= 1024 AND "
    "len < 2048 THEN 1 WHEN len >= 0 AND len < 1024 THEN 0 END AS bin FROM lens) "
    "SELECT [0, 1024, 2048, 4096, 8192, 16384, 32768][bin + 1] AS lo, [0, 1024, 2048, 4096, 8192, 16384, 32768][bin + 2] "
    "AS hi, COUNT(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin", "chats"))
def q_corpus_histogram(spark, sf_dir):
    return C.corpus_stats(_chats(spark, sf_dir))[1]


@query("merge_files", "U1 S2", with_fixtures(
    "SELECT 'chat' AS source, id, CAST(len(conversations) AS INTEGER) AS n_msgs FROM chats UNION ALL "
    "SELECT 'html', CAST(page_id // 2 AS VARCHAR), CAST(COUNT(*) AS INTEGER) FROM pages GROUP BY page_id // 2", "chats"))
def q_merge_files(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = C.merge_files(fx.chats(t).withColumn("source", F.lit("chat")),
                      fx.html_chats(t).withColumn("source", F.lit("html")))
    return m.select("source", "id", F.size("conversations").alias("n_msgs"))


SAMPLE_SEED = 42


@query("shuffle_sample", "D15 D22", with_fixtures(
    f"SELECT id FROM chats ORDER BY md5('{SAMPLE_SEED}:' || id), id LIMIT 30", "chats"))
def q_shuffle_sample(spark, sf_dir):
    return O.shuffle_sample(_chats(spark, sf_dir), "id", 30, SAMPLE_SEED).select("id")


@query("sample_short", "D16 P20", with_fixtures(
    f"SELECT id FROM (SELECT id, conversations, row_number() OVER (ORDER BY md5('{SAMPLE_SEED}:' || id)) - 1 AS pos "
    "FROM chats) z WHERE pos >= 10 AND pos < 60 AND length(array_to_string(list_transform(conversations, "
    "lambda m: m.value), '')) <= 3000", "chats"))
def q_sample_short(spark, sf_dir):
    return C.sample_short(_chats(spark, sf_dir), 10, 60, 3000, seed=SAMPLE_SEED).select("id")


@query("split_train_test", "D17", with_fixtures(
    f"SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('{SAMPLE_SEED}:' || id), id) - 1 < "
    "CAST(floor(0.9 * (SELECT COUNT(*) FROM chats)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM chats",
    "chats"))
def q_split_train_test(spark, sf_dir):
    return O.split_train_test(_chats(spark, sf_dir), "id", 0.9, SAMPLE_SEED).select("id", "split")


@query("slice_rows", "P20 S3", with_fixtures(
    "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY ord) - 1 AS pos FROM chats) z WHERE pos >= 5 AND pos < 25",
    "chats"))
def q_slice_rows(spark, sf_dir):
    return O.slice_rows(_chats(spark, sf_dir), "ord", 5, 25).select("id")


@query("tokenize_count", "X7", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS INTEGER) AS n_tokens "
                                "FROM documents")
def q_tokenize_count(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", word_count("text").alias("n_tokens"))


VOCABULARY = os.environ.get("COHERAL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")


@query("subword_stats", "X7 A15")
def q_subword_stats(spark, sf_dir):
    """Corpus statistics in subword tokens of the vocabulary file that COHERAL_VOCABULARY names."""
    return C.corpus_stats(_chats(spark, sf_dir), Subwords(spark, VOCABULARY))[0]


@query("subword_count", "X7")
def q_subword_count(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", Subwords(spark, VOCABULARY)("text").alias("n_tokens"))


def _split_sql(keep_tail: bool) -> str:
    tail = "r.last AND r.len + (CASE WHEN w.n = 0 THEN 0 ELSE w.cur END) > 400" if keep_tail else "false"
    return with_fixtures(f"""
WITH RECURSIVE rounds AS (
  SELECT id, i, i = len(conversations) // 2 AS last,
         {_TOK.format(v="conversations[2 * i - 1].value")} + {_TOK.format(v="conversations[2 * i].value")} + 12 AS len
  FROM (SELECT id, conversations, unnest(range(1, len(conversations) // 2 + 1)) AS i FROM chats) z),
walk(id, n, start, cur, s, e, s2, e2) AS (
  SELECT DISTINCT id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
         CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM rounds
  UNION ALL
  SELECT w.id, r.i, CASE WHEN w.cur + r.len > 400 THEN 2 * (r.i - 1) ELSE w.start END,
         CASE WHEN w.cur + r.len > 400 THEN r.len ELSE w.cur + r.len END,
         CASE WHEN w.cur + r.len > 400 OR r.last THEN w.start END,
         CASE WHEN w.cur + r.len > 400 THEN 2 * (r.i - 1) WHEN r.last THEN 2 * r.i END,
         CASE WHEN {tail} THEN 2 * (r.i - 1) END, CASE WHEN {tail} THEN 2 * r.i END
  FROM walk w JOIN rounds r ON r.id = w.id AND r.i = w.n + 1)
SELECT id || '_' || CAST(s AS VARCHAR) AS id, CAST(s AS INTEGER) AS start, CAST(e - s AS INTEGER) AS n_msgs FROM walk WHERE s IS NOT NULL
UNION ALL SELECT id || '_' || CAST(s2 AS VARCHAR), CAST(s2 AS INTEGER), CAST(e2 - s2 AS INTEGER) FROM walk WHERE s2 IS NOT NULL""", "chats")


@query("split_long_conversation", "D7 X7", _split_sql(False))
def q_split_long_conversation(spark, sf_dir):
    s = C.split_long_conversation(_chats(spark, sf_dir), max_length=400)
    return s.select("id", "start", F.size("conversations").alias("n_msgs"))


@query("split_long_conversation_keep_tail", "D7 X7", _split_sql(True))
def q_split_long_conversation_keep_tail(spark, sf_dir):
    s = C.split_long_conversation(_chats(spark, sf_dir), max_length=400, keep_tail=True)
    return s.select("id", "start", F.size("conversations").alias("n_msgs"))
