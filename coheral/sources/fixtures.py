"""Derived fixtures: the reference's inputs re-expressed over the driver tables.

Each builder is a plain DataFrame transformation of the Parquet tables, so the
work grows with the scale factor.  The flat ones restate the SQL in FIXTURES.md
one-to-one; the SQL oracle in ``coheral.plans.oracle`` repeats the same text as
CTEs.  Nested fixtures (``chats``, ``arena_log``, ``questions`` ...) are built with
grouped ``collect_list`` over naturally bounded groups (one conversation, one
page pair) -- never over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.functions.timefn import ntz_seconds
from coheral.sources.tables import Tables


def _n_questions(t: Tables) -> Column:
    """Number of bench questions (scalar subquery)."""
    return t.benchmark.agg(F.count(F.lit(1))).scalar()


def _m(c: Column) -> Column:
    """'m' || <int>: model names used by the synthetic judge/battle fixtures."""
    return F.concat(F.lit("m"), c.cast("string"))


# ---------------------------------------------------------------- flat fixtures
def topics(t: Tables) -> DataFrame:
    return t.benchmark.select(F.concat(F.lit("P"), (F.col("item_id") + 1).cast("string")).alias("prompt_id"),
                              F.col("text").alias("topic"))


def essays(t: Tables) -> DataFrame:
    """Every document as an essay; its prompt is one of all topics."""
    n = t.benchmark.agg(F.count(F.lit(1))).scalar()  # scalar subquery, no join
    return t.documents.select(F.col("doc_id").cast("string").alias("essay_id"),
                              F.concat(F.lit("P"), (F.col("doc_id") % n + 1).cast("string")).alias("prompt_id"),
                              "text", F.col("doc_id").alias("ord"))


def preds(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars")
    lab = t.labels.select("doc_id", "quality")
    return (d.join(lab, "doc_id")
            .select(F.col("doc_id").alias("ord"),
                    F.col("quality").cast("int").alias("gold"),
                    F.when(F.col("n_chars") % 17 == 0, -1)
                     .when(F.col("n_chars") % 3 == 0, 0).otherwise(1).cast("int").alias("pred"),
                    F.when(F.col("doc_id") % 4 == 0, "sent_binary")
                     .when(F.col("doc_id") % 4 == 1, "sent_cohesion")
                     .when(F.col("doc_id") % 4 == 2, "sent_consistency")
                     .otherwise("sent_relevance").alias("task")))


def annotations(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select(F.col("l_orderkey").alias("story_id"),
                     F.col("l_linenumber").alias("sent_i"),
                     F.concat(F.lit("annot"), (F.col("l_suppkey") % 3).cast("string")).alias("annot"),
                     (F.lit(1) + F.col("l_partkey") % 8).cast("int").alias("reason"),
                     F.lit(3).alias("num_annotators"))


def battles(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("ord"),
        _m(F.col("user_id") % 8).alias("model_a"),
        _m((F.col("user_id") + 1 + F.col("event_id") % 7) % 8).alias("model_b"),
        F.when(F.col("event_type") == "view", "model_a")
         .when(F.col("event_type") == "click", "model_b")
         .when(F.col("event_type") == "purchase", "tie")
         .when(F.col("event_type") == "error", "tie (bothbad)")
         .otherwise(F.when(F.col("event_id") % 2 == 0, "model_a").otherwise("model_b")).alias("winner"),
        F.col("user_id").cast("string").alias("judge"),
        (F.col("event_id") % 3 != 0).alias("anony"),
        F.col("ts"))


def activity(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        F.col("event_id").alias("ord"), "ts",
        F.when(F.col("event_type") == "view", "chat")
         .when(F.col("event_type") == "click", "leftvote")
         .when(F.col("event_type") == "purchase", "rightvote")
         .when(F.col("event_type") == "error", "tievote")
         .otherwise("bothbad_vote").alias("type"),
        _m(F.col("event_id") % 8).alias("model"),
        F.when(F.col("event_id") % 3 == 0, "named").otherwise("").alias("model_0"),
        F.col("user_id").cast("string").alias("ip"))


def single_judgments(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        (F.col("l_partkey") % _n_questions(t) + 1).alias("question_id"),
        _m(F.col("l_suppkey") % 10).alias("model"),
        (F.lit(1) + F.col("l_linenumber") % 2).cast("int").alias("turn"),
        F.when(F.col("l_linenumber") % 2 == 0, "single-v1").otherwise("single-v1-multi-turn").alias("judge_prompt"),
        F.when(F.col("l_partkey") % 13 == 0, F.lit(-1.0))
         .otherwise((F.lit(1) + F.col("l_partkey") % 10).cast("double")).alias("score"))


def _pair_models(o_custkey: Column, o_orderkey: Column, n: int = 6):
    return (_m(o_custkey % n), _m((o_custkey + 1 + o_orderkey % 5) % n))


def pair_judgments(t: Tables) -> DataFrame:
    o = t.orders
    k = F.col("o_orderkey")
    m1, m2 = _pair_models(F.col("o_custkey"), k)
    return o.select(
        k.alias("ord"), (k % _n_questions(t) + 1).alias("question_id"), m1.alias("model_1"), m2.alias("model_2"),
        F.when(k % 7 == 0, "tie").when(k % 7 == 1, "error").when(k % 7 == 2, "model_2")
         .when(k % 7 == 3, "model_2").otherwise("model_1").alias("g1_winner"),
        F.concat(F.lit("first game of "), k.cast("string")).alias("g1_judgment"),
        F.concat(F.lit("second game of "), k.cast("string")).alias("g2_judgment"),
        F.when(k % 5 == 0, "tie").when(k % 5 == 1, "model_2").otherwise("model_1").alias("g2_winner"),
        (F.lit(1) + k % 2).cast("int").alias("turn"))


def human_votes(t: Tables) -> DataFrame:
    o = t.orders
    k = F.col("o_orderkey")
    ma, mb = _pair_models(F.col("o_custkey"), k)
    return o.select(
        k.alias("ord"), (k % _n_questions(t) + 1).alias("question_id"), ma.alias("model_a"), mb.alias("model_b"),
        F.when(k % 4 == 0, "model_a").when(k % 4 == 1, "model_b").when(k % 4 == 2, "tie")
         .otherwise("tie (bothbad)").alias("winner"),
        F.when(F.col("o_custkey") % 9 == 0, "author_0")
         .otherwise(F.concat(F.lit("expert_"), (F.col("o_custkey") % 9).cast("string"))).alias("judge"),
        (F.lit(1) + k % 2).cast("int").alias("turn"))


def judge_votes(t: Tables) -> DataFrame:
    """Votes for judge agreement: the human votes and one vote of the model judge per game (its last judgment)."""
    p = pair_judgments(t)
    first = F.col("model_1") <= F.col("model_2")
    w = (F.when(F.col("g1_winner") != F.col("g2_winner"), "tie (inconsistent)")
         .when(F.col("g1_winner") == "model_1", F.when(first, "model_a").otherwise("model_b"))
         .when(F.col("g1_winner") == "model_2", F.when(first, "model_b").otherwise("model_a")).otherwise("tie"))
    model = (p.withColumn("w", w).groupBy("question_id", "turn", F.least("model_1", "model_2").alias("model_a"),
                                          F.greatest("model_1", "model_2").alias("model_b"))
             .agg(F.max("ord").alias("ord"), F.max_by("w", "ord").alias("winner")).withColumn("judge", F.lit("gpt-4:pair-v2")))
    return human_votes(t).unionByName(model.select(human_votes(t).columns))


def judge_prompts(t: Tables) -> DataFrame:
    """Judge prompts (S5's columns) with short wording of our own."""
    rows = []
    for ref in ("", "-math"):
        for multi in ("", "-multi-turn"):
            extra = "Reference: {ref_answer_1}\n" if ref else ""
            if multi:
                pair = "Q1: {question_1}\nA1: {answer_a_1}\nB1: {answer_b_1}\nQ2: {question_2}\nA2: {answer_a_2}\nB2: {answer_b_2}"
                single = "Q1: {question_1}\nA1: {answer_1}\nQ2: {question_2}\nA2: {answer_2}"
            else:
                pair, single = "Q: {question}\nA: {answer_a}\nB: {answer_b}", "Q: {question}\nA: {answer}"
            rows.append((f"pair{ref}-v{1 if ref else 2}{multi}", "Compare the two answers.", extra + pair))
            rows.append((f"single{ref}-v1{multi}", "Grade the answer.", extra + single))
    return t.spark.createDataFrame(rows, "name string, system_prompt string, prompt_template string")


def reference_answers(t: Tables) -> DataFrame:
    """Reference answers for three quarters of the questions."""
    q = questions(t)
    return q.filter(F.col("question_id") % 4 != 0).select(
        "question_id", F.transform("turns", lambda x: F.concat(F.lit("Reference for: "), x)).alias("turns"))


def judge_outputs(t: Tables) -> DataFrame:
    e = t.events
    i = F.col("event_id")
    s10 = (F.lit(1) + i % 10).cast("string")
    s9 = (F.lit(1) + i % 9).cast("string")
    return e.select(
        i.alias("ord"),
        F.when(i % 6 == 0, F.concat(F.lit("Clear and correct. Rating: [["), s10, F.lit("]]")))
         .when(i % 6 == 1, F.concat(F.lit("Rating: ["), s10, F.lit("]")))
         .when(i % 6 == 2, F.lit("A is better [[A]]"))
         .when(i % 6 == 3, F.lit("B is better [[B]] m"))
         .when(i % 6 == 4, F.concat(F.lit("scores [["), s10, F.lit(", "), s9, F.lit("]] M")))
         .otherwise(F.lit("no verdict")).alias("judgment"))


def llm_replies(t: Tables) -> DataFrame:
    d = t.documents
    i = F.col("doc_id")
    nl = F.lit("\n")
    full = F.concat(
        F.lit("- [Coherence]: 0 "), nl,
        F.lit("- [Reason 1]: "), (i % 2).cast("string"), nl,
        F.lit("- [Reason 2]: 0"), nl,
        F.lit("- [Reason 3]: "), (i % 3 % 2).cast("string"), nl,
        F.lit("- [Reason 4]: 0"), nl, F.lit("- [Reason 5]: 0"), nl,
        F.lit("- [Reason 6]: 0"), nl, F.lit("- [Reason 7]: 0"), nl,
        F.lit("- [Rewrite]: For example: doc "), i.cast("string"))
    return d.select(
        i.alias("ord"),
        F.when(i % 5 == 0, F.concat(F.lit("- [Coherence]: 1 "), nl, F.lit("- Done")))
         .when(i % 5 == 4, F.lit("I cannot answer"))
         .otherwise(full).alias("reply"))


# -------------------------------------------------------------- nested fixtures
ROLE_MAP = {"user": "human", "assistant": "gpt"}


def chats(t: Tables) -> DataFrame:
    """ShareGPT-shaped conversations, one row per ``conv_id``.

    Some first messages end in a list numbered 1. twice, others in a digit repeated nine times.
    """
    k = F.when(F.col("turn") == 0, F.col("conv_id") % 9)
    c = t.conversations.withColumn("text", F.concat(
        "text", F.when(k == 4, "\n1. one\n1. two").when(k == 7, " call 777777777").otherwise("")))
    frm = (F.when(F.col("role") == "user", "human")
            .when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")))
    grouped = (c.groupBy("conv_id")
               .agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), frm.alias("from"),
                                                         F.col("text").alias("value")))).alias("msgs")))
    return grouped.select(
        F.col("conv_id").cast("string").alias("id"),
        F.col("conv_id").alias("ord"),
        F.when(F.col("conv_id") % 3 == 0, "gpt4").when(F.col("conv_id") % 3 == 1, F.lit(None))
         .otherwise("other").alias("model"),
        F.lit(None).cast("string").alias("plugins"),
        F.transform("msgs", lambda m: F.struct(m["from"].alias("from"), m["value"].alias("value")))
         .alias("conversations"))


def html_chats(t: Tables) -> DataFrame:
    """Pages paired into two-message HTML conversations (page 2k human, 2k+1 gpt)."""
    i = F.col("page_id")
    # some pages come back with a blocked phrase, empty, or from the other side
    p = t.pages.withColumn("html", F.when(i % 22 == 5, F.concat("html", F.lit("<p>made with ChatGPT</p>")))
                           .when(i % 26 == 8, "").otherwise(F.col("html")))
    k = F.floor(F.col("page_id") / 2)
    frm = F.when((i % 2 == 0) | (i % 18 == 3), "human").otherwise("gpt")
    grouped = (p.groupBy(k.alias("k"))
               .agg(F.sort_array(F.collect_list(F.struct(F.col("page_id"), frm.alias("from"),
                                                         F.col("html").alias("value")))).alias("msgs")))
    return grouped.select(
        F.col("k").cast("string").alias("id"), F.col("k").alias("ord"),
        F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("plugins"),
        F.transform("msgs", lambda m: F.struct(m["from"].alias("from"), m["value"].alias("value")))
         .alias("conversations"))


def conversation_messages(t: Tables) -> DataFrame:
    """The messages of every conversation: conv_id string, messages: ``[role, text]`` pairs by turn."""
    return (t.conversations.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
            .select(F.col("conv_id").cast("string").alias("conv_id"),
                    F.transform("m", lambda x: F.array(x["role"], x["text"])).alias("messages")))


def arena_log(t: Tables, messages: bool = True) -> DataFrame:
    """Arena log events (T8): activity joined to two conversation states.

    Named (``model_0 = 'named'``) events show the real model names publicly,
    anonymous ones show ['', ''].  State 0 is conversation ``event_id % n``, state 1 ``(event_id + 1) % n`` where
    ``n`` is the number of conversations; messages are ``[role, text]`` pairs with
    roles user/assistant, offset 0.  ``tstamp`` is epoch seconds (double).
    Without ``messages`` the states name their conversation only (see ``conversation_messages``).
    """
    act = activity(t)
    n = t.conversations.agg(F.countDistinct("conv_id")).scalar()  # scalar subquery, no join
    # events are dealt out while narrow: what they meet is worked on in many tasks
    a = (act.repartition("ord").withColumn("c0", (F.col("ord") % n).cast("string"))
         .withColumn("c1", ((F.col("ord") + 1) % n).cast("string")))
    if messages:
        for i in (0, 1):
            a = a.join(conversation_messages(t).withColumnsRenamed({"conv_id": f"c{i}", "messages": f"msg{i}"}), f"c{i}", "left")
    model_b = F.concat(F.lit("m"), ((F.col("ord") + 3) % 8).cast("string"))
    state = lambda cid, name, msg: F.struct(cid.alias("conv_id"), name.alias("model_name"), F.lit(0).alias("offset"),
                                            *([F.col(msg).alias("messages")] if messages else []))
    return a.select(
        "ord", "type",
        ntz_seconds(F.col("ts")).alias("tstamp"),
        "model",
        F.when(F.col("model_0") == "", F.array(F.lit(""), F.lit(""))).otherwise(F.array(F.col("model"), model_b))
         .alias("models"),
        F.array(state(F.col("c0"), F.col("model"), "msg0"), state(F.col("c1"), model_b, "msg1")).alias("states"),
        state(F.col("c0"), F.col("model"), "msg0").alias("state"),
        "ip")


def questions(t: Tables) -> DataFrame:
    """Bench questions (T11) from ``benchmark``."""
    b = t.benchmark
    follow = F.concat(F.lit("Now expand on: "), F.col("text"))
    return b.select(
        F.col("item_id").alias("question_id"),
        F.when(F.col("item_id") % 5 == 0, "math").otherwise("generic").alias("category"),
        F.when(F.col("item_id") % 2 == 0, F.array(F.col("text"), follow))
         .otherwise(F.array(F.col("text"))).alias("turns"))


def answers(t: Tables) -> DataFrame:
    """Model answers: one per (question, model) that was judged in ``single_judgments``.

    Derived from data (not a cross product of fixed lists) so it grows with the tables.
    """
    sj = single_judgments(t).select("question_id", "model").distinct()
    q = questions(t).select("question_id", "turns")
    return (sj.join(q, "question_id")
            .select("question_id", F.col("model").alias("model_id"),
                    F.array(F.struct(F.lit(0).alias("index"),
                                     F.transform("turns", lambda x: F.concat(F.col("model"), F.lit(" says: "), x))
                                     .alias("turns"))).alias("choices")))


def model_info(t: Tables) -> DataFrame:
    """Model registry: one model per nation."""
    k = F.col("n_nationkey").cast("string")
    return t.nation.select(F.concat(F.lit("m"), k).alias("model"), F.col("n_name").alias("simple_name"),
                           F.concat(F.lit("https://example.org/models/"), k).alias("link"),
                           F.concat(F.lit("a model from "), F.col("n_name")).alias("description"))
