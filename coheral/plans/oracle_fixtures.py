"""DuckDB restatements of the derived fixtures, used as CTEs by the oracles."""

from __future__ import annotations

FIXTURE_SQL = {
    "topics": "SELECT 'P' || CAST(item_id + 1 AS VARCHAR) AS prompt_id, text AS topic FROM benchmark",
    "essays": "SELECT CAST(doc_id AS VARCHAR) AS essay_id, 'P' || CAST(doc_id % (SELECT COUNT(*) FROM benchmark) + 1 AS VARCHAR) AS prompt_id, "
              "text, doc_id AS ord FROM documents",
    "preds": "SELECT d.doc_id AS ord, CAST(l.quality AS INT) AS gold, CAST(CASE WHEN d.n_chars % 17 = 0 THEN -1 "
             "WHEN d.n_chars % 3 = 0 THEN 0 ELSE 1 END AS INT) AS pred, CASE WHEN d.doc_id % 4 = 0 THEN 'sent_binary' "
             "WHEN d.doc_id % 4 = 1 THEN 'sent_cohesion' WHEN d.doc_id % 4 = 2 THEN 'sent_consistency' "
             "ELSE 'sent_relevance' END AS task FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "annotations": "SELECT l_orderkey AS story_id, l_linenumber AS sent_i, 'annot' || CAST(l_suppkey % 3 AS VARCHAR) "
                   "AS annot, CAST(1 + l_partkey % 8 AS INT) AS reason, 3 AS num_annotators FROM lineitem",
    "battles": "SELECT event_id AS ord, 'm' || CAST(user_id % 8 AS VARCHAR) AS model_a, "
               "'m' || CAST((user_id + 1 + event_id % 7) % 8 AS VARCHAR) AS model_b, CASE event_type "
               "WHEN 'view' THEN 'model_a' WHEN 'click' THEN 'model_b' WHEN 'purchase' THEN 'tie' WHEN 'error' THEN "
               "'tie (bothbad)' ELSE CASE WHEN event_id % 2 = 0 THEN 'model_a' ELSE 'model_b' END END AS winner, CAST(user_id AS VARCHAR) AS judge, event_id % 3 <> 0 AS anony, "
               "ts FROM events",
    "activity": "SELECT event_id AS ord, ts, CASE event_type WHEN 'view' THEN 'chat' WHEN 'click' THEN 'leftvote' "
                "WHEN 'purchase' THEN 'rightvote' WHEN 'error' THEN 'tievote' ELSE 'bothbad_vote' END AS type, "
                "'m' || CAST(event_id % 8 AS VARCHAR) AS model, CASE WHEN event_id % 3 = 0 THEN 'named' ELSE '' END "
                "AS model_0, CAST(user_id AS VARCHAR) AS ip FROM events",
    "single_judgments": "SELECT l_orderkey * 10 + l_linenumber AS ord, l_partkey % (SELECT COUNT(*) FROM benchmark) + 1 AS question_id, "
                        "'m' || CAST(l_suppkey % 10 AS VARCHAR) AS model, CAST(1 + l_linenumber % 2 AS INT) AS turn, "
                        "CASE WHEN l_linenumber % 2 = 0 THEN 'single-v1' ELSE 'single-v1-multi-turn' END AS judge_prompt, "
                        "CASE WHEN l_partkey % 13 = 0 THEN -1.0E0 ELSE CAST(1 + l_partkey % 10 AS DOUBLE) END AS score "
                        "FROM lineitem",
    "pair_judgments": "SELECT o_orderkey AS ord, o_orderkey % (SELECT COUNT(*) FROM benchmark) + 1 AS question_id, 'm' || CAST(o_custkey % 6 AS VARCHAR) "
                      "AS model_1, 'm' || CAST((o_custkey + 1 + o_orderkey % 5) % 6 AS VARCHAR) AS model_2, "
                      "CASE o_orderkey % 7 WHEN 0 THEN 'tie' WHEN 1 THEN 'error' WHEN 2 THEN 'model_2' WHEN 3 THEN "
                      "'model_2' ELSE 'model_1' END AS g1_winner, 'first game of ' || CAST(o_orderkey AS VARCHAR) AS g1_judgment, 'second game of ' || CAST(o_orderkey AS VARCHAR) AS g2_judgment, CASE o_orderkey % 5 WHEN 0 THEN 'tie' WHEN 1 THEN "
                      "'model_2' ELSE 'model_1' END AS g2_winner, CAST(1 + o_orderkey % 2 AS INT) AS turn FROM orders",
    "human_votes": "SELECT o_orderkey AS ord, o_orderkey % (SELECT COUNT(*) FROM benchmark) + 1 AS question_id, 'm' || CAST(o_custkey % 6 AS VARCHAR) "
                   "AS model_a, 'm' || CAST((o_custkey + 1 + o_orderkey % 5) % 6 AS VARCHAR) AS model_b, "
                   "CASE o_orderkey % 4 WHEN 0 THEN 'model_a' WHEN 1 THEN 'model_b' WHEN 2 THEN 'tie' "
                   "ELSE 'tie (bothbad)' END AS winner, CASE WHEN o_custkey % 9 = 0 THEN 'author_0' "
                   "ELSE 'expert_' || CAST(o_custkey % 9 AS VARCHAR) END AS judge, CAST(1 + o_orderkey % 2 AS INT) "
                   "AS turn FROM orders",
    "model_info": "SELECT 'm' || CAST(n_nationkey AS VARCHAR) AS model, n_name AS simple_name, 'https://example.org/models/' "
                  "|| CAST(n_nationkey AS VARCHAR) AS link, 'a model from ' || n_name AS description FROM nation",
    "judge_votes": "SELECT ord, question_id, model_a, model_b, winner, judge, turn FROM human_votes UNION ALL "
                   "SELECT max(ord), question_id, least(model_1, model_2), greatest(model_1, model_2), arg_max(CASE "
                   "WHEN g1_winner <> g2_winner THEN 'tie (inconsistent)' WHEN g1_winner IN ('model_1', 'model_2') THEN "
                   "CASE WHEN (g1_winner = 'model_1') = (model_1 <= model_2) THEN 'model_a' ELSE 'model_b' END ELSE 'tie' "
                   "END, ord), 'gpt-4:pair-v2', turn FROM pair_judgments GROUP BY question_id, turn, "
                   "least(model_1, model_2), greatest(model_1, model_2)",
    "judge_outputs": "SELECT event_id AS ord, CASE WHEN event_id % 6 = 0 THEN 'Clear and correct. Rating: [[' || "
                     "CAST(1 + event_id % 10 AS VARCHAR) || ']]' WHEN event_id % 6 = 1 THEN 'Rating: [' || "
                     "CAST(1 + event_id % 10 AS VARCHAR) || ']' WHEN event_id % 6 = 2 THEN 'A is better [[A]]' "
                     "WHEN event_id % 6 = 3 THEN 'B is better [[B]] m' WHEN event_id % 6 = 4 THEN 'scores [[' || "
                     "CAST(1 + event_id % 10 AS VARCHAR) || ', ' || CAST(1 + event_id % 9 AS VARCHAR) || ']] M' "
                     "ELSE 'no verdict' END AS judgment FROM events",
    "llm_replies": "SELECT doc_id AS ord, CASE WHEN doc_id % 5 = 0 THEN '- [Coherence]: 1 ' || chr(10) || '- Done' "
                   "WHEN doc_id % 5 = 4 THEN 'I cannot answer' ELSE '- [Coherence]: 0 ' || chr(10) || "
                   "'- [Reason 1]: ' || CAST(doc_id % 2 AS VARCHAR) || chr(10) || '- [Reason 2]: 0' || chr(10) || "
                   "'- [Reason 3]: ' || CAST(doc_id % 3 % 2 AS VARCHAR) || chr(10) || '- [Reason 4]: 0' || chr(10) || "
                   "'- [Reason 5]: 0' || chr(10) || '- [Reason 6]: 0' || chr(10) || '- [Reason 7]: 0' || chr(10) || "
                   "'- [Rewrite]: For example: doc ' || CAST(doc_id AS VARCHAR) END AS reply FROM documents",
    # ---- nested ----
    "chats": "SELECT CAST(conv_id AS VARCHAR) AS id, conv_id AS ord, CASE WHEN conv_id % 3 = 0 THEN 'gpt4' "
             "WHEN conv_id % 3 = 1 THEN NULL ELSE 'other' END AS model, CAST(NULL AS VARCHAR) AS plugins, "
             "list({'from': CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, "
             "'value': text || CASE WHEN turn = 0 AND conv_id % 9 = 4 THEN chr(10) || '1. one' || chr(10) || '1. two' "
             "WHEN turn = 0 AND conv_id % 9 = 7 THEN ' call 777777777' ELSE '' END} ORDER BY turn) AS conversations "
             "FROM conversations GROUP BY conv_id",
    "questions": "SELECT item_id AS question_id, CASE WHEN item_id % 5 = 0 THEN 'math' ELSE 'generic' END AS category, "
                 "CASE WHEN item_id % 2 = 0 THEN [text, 'Now expand on: ' || text] ELSE [text] END AS turns FROM benchmark",
    "answers": "SELECT DISTINCT s.question_id, s.model AS model_id FROM single_judgments s "
               "JOIN questions q ON s.question_id = q.question_id",
    # sentence split of P1 / F1 (Python: [s.strip() + '.' for s in text.split('.') if s.strip()])
    "essay_sents": "SELECT essay_id, prompt_id, ord, list_transform(list_filter(list_transform(string_split(text, '.'), "
                   "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), lambda x: x || '.') AS sents FROM essays",
}

# dependencies between fixture CTEs
DEPS = {"judge_votes": ["human_votes", "pair_judgments"], "essay_sents": ["essays"], "answers": ["single_judgments", "questions"]}


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with ``WITH`` clauses for ``names`` (and their dependencies)."""
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
