"""Registered queries: reply parsing, external model calls, SFT example builders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coheral.operators import replies as RP
from coheral.operators import sft as S
from coheral.functions.text import parse_flag_map, parse_list
from coheral.operators.external import llm_map, moderation_tag, tags_per_message
from coheral.operators.pairs import incremental_pairs
from coheral.plans.oracle_fixtures import with_fixtures
from coheral.plans.registry import query
from coheral.sources import fixtures as fx
from coheral.sources.tables import Tables

_F = "CASE WHEN len(string_split(lines[{k}], ': ')) >= 2 THEN regexp_replace(string_split(lines[{k}], ': ')[2], '^\\s+|\\s+$', '', 'g') END"


def _annot_sql() -> str:
    fields = ", ".join(f"{_F.format(k=k + 2)} AS f{k}" for k in range(8))
    out = []
    ok = "label IS NOT NULL AND label = '0'"
    for k, n in enumerate(["r1", "r2", "r3", "r4", "r5", "r6", "r7", "rewrite"]):
        ok = f"{ok} AND f{k} IS NOT NULL"
        out.append(f"CASE WHEN {ok} THEN f{k} ELSE '' END AS {n}")
    return with_fixtures(
        f"SELECT ord, coalesce(label, '') AS label, {', '.join(out)} FROM (SELECT ord, {_F.format(k=1)} AS label, "
        f"{fields} FROM (SELECT ord, string_split(reply, chr(10)) AS lines FROM llm_replies) a) b", "llm_replies")


@query("parse_annotation_reply", "P29", _annot_sql())
def q_parse_annotation_reply(spark, sf_dir):
    r = fx.llm_replies(Tables(spark, sf_dir))
    return RP.parse_annotation_reply(r, "reply").drop("reply")


@query("parse_annotation_reply_full_text", "P29", with_fixtures(
    "SELECT ord, CASE WHEN starts_with(reply, '- [Coherence]: 0') THEN 'For example: doc ' || CAST(ord AS VARCHAR) ELSE '' END AS rewrite "
    "FROM llm_replies", "llm_replies"))
def q_parse_annotation_reply_full_text(spark, sf_dir):
    r = fx.llm_replies(Tables(spark, sf_dir))
    return RP.parse_annotation_reply(r, "reply", full_text=True).select("ord", "rewrite")


_DET_TEXT = ("CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars % 2 AS VARCHAR) || chr(10) || 'because' "
             "WHEN doc_id % 3 = 1 THEN 'Answer: ' || CAST(n_chars % 2 AS VARCHAR) || ' ' ELSE source END")


def _det_rows(spark, sf_dir) -> DataFrame:
    d = Tables(spark, sf_dir).documents
    txt = (F.when(F.col("doc_id") % 3 == 0, F.concat((F.col("n_chars") % 2).cast("string"), F.lit("\nbecause")))
           .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Answer: "), (F.col("n_chars") % 2).cast("string"), F.lit(" ")))
           .otherwise(F.col("source")))
    return d.select("doc_id", txt.alias("reply"))


@query("parse_detection_reply", "P30", f"""
SELECT doc_id, coalesce(TRY_CAST(regexp_replace(split_part(reply, chr(10), 1), '^\\s+|\\s+$', '', 'g') AS INTEGER), -1)
         AS api_pred,
       CASE WHEN len(string_split(reply, 'Answer: ')) >= 2 THEN
         TRY_CAST(regexp_replace(string_split(reply, 'Answer: ')[2], '^\\s+|\\s+$', '', 'g') AS INTEGER) END AS local_pred
FROM (SELECT doc_id, {_DET_TEXT} AS reply FROM documents) z""")
def q_parse_detection_reply(spark, sf_dir):
    r = _det_rows(spark, sf_dir)
    return r.select("doc_id", RP.parse_detection_reply_api("reply").alias("api_pred"),
                    RP.parse_detection_reply_local("reply").alias("local_pred"))


@query("normalise_label_text", "P37", with_fixtures(
    "SELECT ord, lower(CASE WHEN length(regexp_replace(reply, '[ \\n]', '', 'g')) = 0 THEN 'None' "
    "ELSE regexp_replace(reply, '[ \\n]', '', 'g') END) AS label FROM llm_replies", "llm_replies"))
def q_normalise_label_text(spark, sf_dir):
    r = fx.llm_replies(Tables(spark, sf_dir))
    return r.select("ord", RP.normalise_label_text("reply").alias("label"))


_SCORE_TEXT = ("CASE doc_id % 6 WHEN 0 THEN 'Coherence' WHEN 1 THEN CAST(n_chars % 5 + 1 AS VARCHAR) "
               "WHEN 2 THEN CAST(n_chars % 5 + 1 AS VARCHAR) || '.0' WHEN 3 THEN CAST(n_chars % 5 + 1 AS VARCHAR) || '/5' "
               "WHEN 4 THEN 'maybe' ELSE CAST(n_chars % 7 AS VARCHAR) END")


@query("coerce_prediction", "P38 S10 F28", f"""
SELECT doc_id, CASE WHEN lower(p) IN ('coherence', 'co') THEN 5 WHEN p IN ('1', '2', '3', '4', '5') THEN CAST(p AS INTEGER)
  WHEN split_part(p, '.', 1) IN ('1', '2', '3', '4', '5') THEN CAST(split_part(p, '.', 1) AS INTEGER)
  WHEN split_part(p, '/', 1) IN ('1', '2', '3', '4', '5') THEN CAST(split_part(p, '/', 1) AS INTEGER)
  ELSE 5 - gold END AS score_pred,
  CASE WHEN lower(bw) = 'yes' THEN 1 WHEN lower(bw) = 'no' THEN 0 END AS bin_gold,
  CASE WHEN lower(bl) = 'yes' THEN 1 WHEN lower(bl) IN ('no', 'n') THEN 0
       ELSE 1 - (CASE WHEN lower(bw) = 'yes' THEN 1 WHEN lower(bw) = 'no' THEN 0 END) END AS bin_pred
FROM (SELECT doc_id, {_SCORE_TEXT} AS p, CAST(n_chars % 5 + 1 AS INTEGER) AS gold,
             CASE WHEN n_chars % 2 = 0 THEN 'Yes' ELSE 'no' END AS bw,
             string_split(CASE doc_id % 4 WHEN 0 THEN 'I think yes' WHEN 1 THEN 'No' WHEN 2 THEN 'n' ELSE 'unsure' END,
                          ' ')[-1] AS bl FROM documents) z""")
def q_coerce_prediction(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    m = F.col("doc_id") % 6
    v = (F.col("n_chars") % 5 + 1).cast("string")
    p = (F.when(m == 0, "Coherence").when(m == 1, v).when(m == 2, F.concat(v, F.lit(".0")))
         .when(m == 3, F.concat(v, F.lit("/5"))).when(m == 4, "maybe").otherwise((F.col("n_chars") % 7).cast("string")))
    gold = (F.col("n_chars") % 5 + 1).cast("int")
    bw = F.when(F.col("n_chars") % 2 == 0, "Yes").otherwise("no")
    k = F.col("doc_id") % 4
    bt = F.when(k == 0, "I think yes").when(k == 1, "No").when(k == 2, "n").otherwise("unsure")
    g, bp = RP.coerce_binary_prediction(bt, bw)
    return d.select("doc_id", RP.coerce_score_prediction(p, gold).alias("score_pred"), g.alias("bin_gold"),
                    bp.alias("bin_pred"))


def _pairs(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    e = fx.essays(t)
    p = incremental_pairs(e, fx.topics(t), carry=("ord",))
    return p.withColumn("label", ((F.col("ord") * 100000 + F.col("sent_idx")) % 2).cast("int"))


_SFT_PRE = S.DETECTION_TEMPLATE.split("{context}")[0].replace("'", "''").replace("\n", "' || chr(10) || '")
_SFT_MID = S.DETECTION_TEMPLATE.split("{context}")[1].split("{sentence}")[0].replace("\n", "' || chr(10) || '")
_SFT_END = S.DETECTION_TEMPLATE.split("{sentence}")[1].replace("\n", "' || chr(10) || '")


@query("sft_examples", "X8 F11 X7", with_fixtures(f"""
SELECT essay_id, CAST(sent_idx AS INTEGER) AS sent_idx, md5(prompt) AS prompt_md5, completion,
       CAST(len(regexp_extract_all(prompt, '[^ \\t\\n\\r]+')) + 2 AS INTEGER) AS mask_len
FROM (SELECT essay_id, sent_idx, '{_SFT_PRE}' || context || '{_SFT_MID}' || sentence || '{_SFT_END}' AS prompt,
             'Answer: ' || CAST(CAST((ord * 100000 + sent_idx) % 2 AS INTEGER) AS VARCHAR) || '</s>' AS completion
      FROM (SELECT s.essay_id, s.ord, s.sents, unnest(range(1, len(s.sents))) AS sent_idx
            FROM essay_sents s JOIN topics t ON s.prompt_id = t.prompt_id) x,
           LATERAL (SELECT array_to_string(x.sents[1:x.sent_idx], ' ') AS context, x.sents[x.sent_idx + 1] AS sentence) y
     ) z""", "essay_sents", "topics"))
def q_sft_examples(spark, sf_dir):
    s = S.sft_examples(_pairs(spark, sf_dir))
    return s.select("essay_id", "sent_idx", F.md5("prompt").alias("prompt_md5"), "completion", "mask_len")


@query("reason_instructions", "F10", with_fixtures(
    "SELECT ord, " + " || ".join(f"CASE WHEN (ord >> {i}) & 1 = 1 THEN '{s}' ELSE '' END"
                                 for i, s in enumerate(S.REASON_SENTENCES)) + " AS instructions FROM preds", "preds"))
def q_reason_instructions(spark, sf_dir):
    p = fx.preds(Tables(spark, sf_dir))
    rs = [F.shiftright(F.col("ord"), i).bitwiseAND(1) for i in range(7)]
    return p.select("ord", S.reason_instructions(rs).alias("instructions"))


@query("render_conversation", "F13 F18", with_fixtures(
    "SELECT id, md5('" + S.CHAT_SYSTEM.replace("'", "''") + " ' || array_to_string(list_transform(conversations, "
    "lambda m, i: CASE WHEN (i - 1) % 2 = 0 THEN 'USER' ELSE 'ASSISTANT' END || ': ' || m.value || "
    "CASE WHEN (i - 1) % 2 = 0 THEN ' ' ELSE '</s>' END), '')) AS text_md5 FROM chats", "chats"))
def q_render_conversation(spark, sf_dir):
    c = fx.chats(Tables(spark, sf_dir))
    return c.select("id", F.md5(S.render_conversation(F.col("conversations"))).alias("text_md5"))


_PIECES = r"len(regexp_extract_all({v}, '</s>|\w+|[^\w\s]'))"


@query("chat_sft_masks", "X9", with_fixtures(f"""
WITH c AS (SELECT id, CASE WHEN len(conversations) > 0 AND conversations[1]['from'] <> 'human' THEN conversations[2:]
                      ELSE conversations END AS conv FROM chats),
t AS (SELECT id, '{S.CHAT_SYSTEM.replace("'", "''")} ' || array_to_string(list_transform(conv, lambda m, i:
        CASE WHEN i % 2 = 1 THEN 'USER' ELSE 'ASSISTANT' END || CASE WHEN coalesce(m.value, '') = '' THEN ':'
        ELSE ': ' || m.value || CASE WHEN i % 2 = 1 THEN ' ' ELSE '</s>' END END), '') AS text FROM c),
p AS (SELECT id, text, i, CASE WHEN i = 1 THEN parts[i] ELSE '</s>' || parts[i] END AS turn, parts[i] = '' AS none
      FROM (SELECT id, text, string_split(text, '</s>') AS parts, unnest(range(1, len(string_split(text, '</s>')) + 1)) AS i FROM t) z),
k AS (SELECT * FROM (SELECT *, max(CAST(none AS INT)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended
      FROM p) z WHERE ended = 0),
n AS (SELECT id, i, {_PIECES.format(v="turn")} AS n, {_PIECES.format(v="CASE WHEN contains(turn, 'ASSISTANT: ') THEN split_part(turn, 'ASSISTANT: ', 1) || 'ASSISTANT: ' ELSE turn END")} AS masked FROM k),
s AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY i) - n + masked AS start FROM n)
SELECT t.id, CAST({_PIECES.format(v="t.text")} AS INTEGER) AS n_tokens, CAST(coalesce(g.total, 0) = {_PIECES.format(v="t.text")} OR coalesce(g.total, 0) >= 2048 AS BOOLEAN) AS matched,
       CASE WHEN coalesce(g.total, 0) = {_PIECES.format(v="t.text")} OR coalesce(g.total, 0) >= 2048 THEN coalesce(g.spans, '') ELSE '' END AS spans
FROM t LEFT JOIN (SELECT id, sum(n) AS total, string_agg(CASE WHEN masked < n THEN CAST(start AS BIGINT) || '+' || (n - masked) END, ',' ORDER BY i) AS spans
                  FROM s GROUP BY id) g ON g.id = t.id""", "chats"))
def q_chat_sft_masks(spark, sf_dir):
    m = S.chat_sft_masks(fx.chats(Tables(spark, sf_dir)))
    spans = F.array_join(F.transform("train_spans", lambda x: F.concat_ws("+", x["start"].cast("string"), x["length"].cast("string"))), ",")
    return m.select("id", "n_tokens", "matched", spans.alias("spans"))


def _style_sql(name: str) -> str:
    """The rendered text of ``conversations`` in one style, written out per style."""
    sys_msg, (user, bot), style, sep, sep2 = S.CONV_TEMPLATES[name]
    q = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    role = f"CASE WHEN i % 2 = 1 THEN {q(user)} ELSE {q(bot)} END"
    two = f"CASE WHEN i % 2 = 1 THEN {q(sep)} ELSE {q(sep2 or sep)} END"
    full, bare, head = {
        "ADD_COLON_SINGLE": (f"{role} || ': ' || m.value || {q(sep)}", f"{role} || ':'", sys_msg + sep),
        "ADD_COLON_TWO": (f"{role} || ': ' || m.value || {two}", f"{role} || ':'", sys_msg + sep),
        "ADD_COLON_SPACE_SINGLE": (f"{role} || ': ' || m.value || {q(sep)}", f"{role} || ': '", sys_msg + sep),
        "NO_COLON_SINGLE": (f"{role} || m.value || {q(sep)}", role, sys_msg),
        "NO_COLON_TWO": (f"{role} || m.value || {two}", role, sys_msg),
        "ADD_NEW_LINE_SINGLE": (f"{role} || chr(10) || m.value || {q(sep)}", f"{role} || chr(10)", sys_msg and sys_msg + sep),
        "LLAMA2": (f"CASE WHEN i = 1 THEN m.value || ' ' ELSE {role} || ' ' || m.value || {two} END", role, sys_msg or "[INST] "),
        "CHATML": (f"{role} || chr(10) || m.value || {q(sep)} || chr(10)", f"{role} || chr(10)", sys_msg and sys_msg + sep + "\n"),
        "ROBIN": (f"{role} || ':' || chr(10) || m.value || {q(sep)}", f"{role} || ':' || chr(10)", sys_msg + sep),
        "PHOENIX": (f"{role} || ': <s>' || m.value || '</s>'", f"{role} || ': <s>'", sys_msg),
        "DOLLY": (f"{role} || ':' || chr(10) || m.value || {two} || CASE WHEN i % 2 = 0 THEN chr(10) || chr(10) ELSE '' END",
                  f"{role} || ':' || chr(10)", sys_msg)}[style]
    return (f"{q(head)} || array_to_string(list_transform(conversations, lambda m, i: CASE WHEN coalesce(m.value, '') = '' "
            f"THEN {bare} ELSE {full} END), '')")


@query("render_styles", "F13", with_fixtures(" UNION ALL ".join(
    f"SELECT id, '{n}' AS style, md5({_style_sql(n)}) AS text_md5 FROM chats" for n in S.CONV_TEMPLATES), "chats"))
def q_render_styles(spark, sf_dir):
    c = fx.chats(Tables(spark, sf_dir))
    each = F.array(*[F.struct(F.lit(n).alias("style"), F.md5(S.render_conversation(F.col("conversations"), n)).alias("text_md5"))
                     for n in S.CONV_TEMPLATES])
    return c.select("id", F.inline(each))


_TASK_NAMES = list(S.TASK_TEMPLATES)
_REASON_SQL = " || ".join(f"CASE WHEN (ord >> {i}) & 1 = 1 THEN '{r}' ELSE '' END" for i, r in enumerate(S.REASON_SENTENCES))


def _template_sql(template: str) -> str:
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, value in (("context", "context"), ("sentence", "sentence"), ("reason_texts", _REASON_SQL)):
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


@query("task_prompts", "F11 X8 F10", with_fixtures(
    "SELECT essay_id, CAST(sent_idx AS INTEGER) AS sent_idx, task, md5(CASE task " + " ".join(
        f"WHEN '{n}' THEN {_template_sql(t)}" for n, t in S.TASK_TEMPLATES.items()) + " END) AS prompt_md5 FROM (SELECT *, ["
    + ", ".join(f"'{n}'" for n in _TASK_NAMES) + f"][ord % {len(_TASK_NAMES)} + 1] AS task FROM (SELECT s.essay_id, s.ord, s.sents, "
    "unnest(range(1, len(s.sents))) AS sent_idx FROM essay_sents s JOIN topics t ON s.prompt_id = t.prompt_id) x, LATERAL (SELECT "
    "array_to_string(x.sents[1:x.sent_idx], ' ') AS context, x.sents[x.sent_idx + 1] AS sentence) y) z", "essay_sents", "topics"))
def q_task_prompts(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    task = F.element_at(F.array(*[F.lit(n) for n in _TASK_NAMES]), (F.col("ord") % len(_TASK_NAMES) + 1).cast("int"))
    reasons = S.reason_instructions([F.shiftright(F.col("ord"), i).bitwiseAND(1) for i in range(7)])
    return S.task_prompts(p, task, reasons).select("essay_id", "sent_idx", "task", F.md5("prompt").alias("prompt_md5"))


@query("typed_import", "F19", """
SELECT doc_id, n_chars % 2 = 0 AS sent0, doc_id % 3 = 0 AS sent1, CAST(n_chars % 7 + doc_id % 5 AS BIGINT) AS total FROM documents""")
def q_typed_import(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "n_chars")
    word = lambda c: F.when(c, "True").otherwise("False")
    flags = F.format_string("{'sent0': %s, 'sent1': %s}", word(F.col("n_chars") % 2 == 0), word(F.col("doc_id") % 3 == 0))
    numbers = F.format_string("[%d, %d]", F.col("n_chars") % 7, F.col("doc_id") % 5)
    rows = d.select("doc_id", parse_flag_map(flags).alias("m"), parse_list(numbers).alias("l"))
    return rows.select("doc_id", F.col("m")["sent0"].alias("sent0"), F.col("m")["sent1"].alias("sent1"),
                       F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("qa_examples", "X10", with_fixtures("""
SELECT id, CAST(i - 1 AS INTEGER) AS i, md5(array_to_string(q[greatest(len(q) - 63, 1):], ' ') || '</s>') AS question_md5,
       md5(array_to_string(a[1:64], ' ') || '</s>') AS answer_md5
FROM (SELECT id, i, regexp_split_to_array(array_to_string(list_transform(conversations[1:i - 1], lambda m: m['from'] || ': ' || m.value),
             chr(10)), '\\s+') AS q, regexp_split_to_array(conversations[i].value, '\\s+') AS a, conversations[i]['from'] AS who
      FROM (SELECT id, conversations, unnest(range(1, len(conversations) + 1)) AS i FROM chats) z) y WHERE who = 'gpt'""", "chats"))
def q_qa_examples(spark, sf_dir):
    return S.qa_examples(fx.chats(Tables(spark, sf_dir)), max_tokens=64).select(
        "id", "i", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query("llm_map", "X1 X2", with_fixtures(f"""
SELECT essay_id, CAST(sent_idx AS INTEGER) AS sent_idx, CASE WHEN md5(prompt) < '8' THEN 1 ELSE 0 END AS pred
FROM (SELECT essay_id, sent_idx, '{_SFT_PRE}' || context || '{_SFT_MID}' || sentence || '{_SFT_END}' AS prompt
      FROM (SELECT s.essay_id, s.ord, s.sents, unnest(range(1, len(s.sents))) AS sent_idx
            FROM essay_sents s JOIN topics t ON s.prompt_id = t.prompt_id) x,
           LATERAL (SELECT array_to_string(x.sents[1:x.sent_idx], ' ') AS context, x.sents[x.sent_idx + 1] AS sentence) y
     ) z""", "essay_sents", "topics"))
def q_llm_map(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    s = S.sft_examples(p)
    out = llm_map(s.select("essay_id", "sent_idx", "prompt"), "prompt", out_col="reply")
    return out.select("essay_id", "sent_idx", RP.parse_detection_reply_api("reply").alias("pred"))


_MOD_SQL = ("SELECT conv_id, turn, text || CASE WHEN (conv_id + turn) % 7 = 0 THEN ' <redacted>' ELSE '' END || "
            "CASE WHEN (conv_id + turn) % 10 = 3 THEN ' <anonymized>' ELSE '' END AS text FROM conversations WHERE role = 'user'")


def _moderated(spark, sf_dir) -> DataFrame:
    c = Tables(spark, sf_dir).conversations.filter(F.col("role") == "user")
    k = F.col("conv_id") + F.col("turn")
    text = F.concat("text", F.when(k % 7 == 0, " <redacted>").otherwise(""), F.when(k % 10 == 3, " <anonymized>").otherwise(""))
    return moderation_tag(c.select("conv_id", "turn", text.alias("text")), "text")


@query("moderation_tag", "X5", f"""
SELECT conv_id, turn, contains(text, '<redacted>') OR contains(text, '<anonymized>') AS flagged,
       array_to_string(list_filter([CASE WHEN contains(text, '<redacted>') THEN 'redacted' END,
                                    CASE WHEN contains(text, '<anonymized>') THEN 'anonymized' END], lambda x: x IS NOT NULL), ',') AS categories
FROM ({_MOD_SQL}) z""")
def q_moderation_tag(spark, sf_dir):
    return _moderated(spark, sf_dir).select("conv_id", "turn", "flagged", F.array_join("categories", ",").alias("categories"))


@query("tags_per_message", "J4", f"""
SELECT conv_id, string_agg(CASE WHEN contains(text, '<redacted>') OR contains(text, '<anonymized>') THEN '1' ELSE '0' END, '' ORDER BY turn) AS tags
FROM ({_MOD_SQL}) z GROUP BY conv_id""")
def q_tags_per_message(spark, sf_dir):
    t = tags_per_message(_moderated(spark, sf_dir))
    return t.select("conv_id", F.array_join(F.transform("tags", lambda x: F.when(x, "1").otherwise("0")), "").alias("tags"))


@query("logit_decisions", "F17 F29", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax,
       CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN 1 / (1 + exp(-x)) > 0.5 THEN 1 ELSE 0 END))
            AS INTEGER) AS n_positive,
       ['a', 'b', 'c'][list_position([embedding[1], embedding[3], embedding[5]],
                                      list_max([embedding[1], embedding[3], embedding[5]]))] AS best_label
FROM embeddings""")
def q_logit_decisions(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return e.select("vec_id", RP.argmax("embedding").alias("argmax"),
                    F.aggregate(RP.sigmoid_labels("embedding"), F.lit(0), lambda a, x: a + x).alias("n_positive"),
                    RP.best_allowed_label("embedding", [0, 2, 4], ["a", "x", "b", "y", "c"]).alias("best_label"))


_W_PRE = S.WORD_TEMPLATE.split("{target_word}")[0].replace("\n", "' || chr(10) || '")
_W_MID = S.WORD_TEMPLATE.split("{target_word}")[1].split("{sentence}")[0].replace("\n", "' || chr(10) || '")


@query("match_word_sft", "X11", f"""
SELECT doc_id, sent_idx, md5(prompt) AS prompt_md5, completion,
       CAST(len(regexp_extract_all(prompt, '[^ \\t\\n\\r]+')) + 5 AS INTEGER) AS mask_len
FROM (SELECT doc_id, sent_idx, '{{_W_PRE}}' || words[2] || '{{_W_MID}}' ||
             array_to_string(list_transform(words, lambda w, i: CASE WHEN i = 2 THEN '**' || w || '**' ELSE w END), ' ')
             AS prompt,
             'Substitutes: ' || array_to_string(words[3:5], ', ') || '</s>' AS completion
      FROM (SELECT doc_id, CAST(i AS INTEGER) AS sent_idx, string_split(sents[i + 1], ' ') AS words
            FROM (SELECT doc_id, string_split(text, '.') AS sents, unnest(range(len(string_split(text, '.')))) AS i
                  FROM documents) z) a
      WHERE len(words) >= 5) b""".replace("{_W_PRE}", _W_PRE).replace("{_W_MID}", _W_MID))
def q_match_word_sft(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    sents = d.select("doc_id", F.posexplode(F.split("text", r"\.", -1)).alias("sent_idx", "sentence"))
    rows = sents.select("doc_id", "sent_idx", F.split("sentence", " ", -1).alias("w")).filter(F.size("w") >= 5).select(
        "doc_id", "sent_idx", F.col("w")[1].alias("target_word"),
        F.array_join(F.transform("w", lambda x, i: F.when(i == 1, F.concat(F.lit("**"), x, F.lit("**")))
                                 .otherwise(x)), " ").alias("sentence"),
        F.slice("w", 3, 3).alias("substitutes"))
    out = S.match_word_sft(rows)
    return out.select("doc_id", "sent_idx", F.md5("prompt").alias("prompt_md5"), "completion", "mask_len")
