"""Order-dependent and numeric operators checked against literal Python restatements
on small random or hand-made inputs (SURVEY §5 strategy points 2-4)."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coheral.operators import conversations as C
from coheral.operators import metrics as M
from coheral.operators import ordering as O
from coheral.operators import pairs as P
from coheral.operators import ratings as R
from coheral.operators.arena import clean_battles

CONV_T = "id string, ord long, model string, plugins string, conversations array<struct<from:string,value:string>>"


# ---------------------------------------------------------------- D1 dedup
def greedy_dedup(rows):
    """Keep the first undecided row, strike out those that share its id or first exchange, and so on."""
    left = sorted(((r["ord"], r["id"], r["conversations"][:2]) for r in rows if r["plugins"] is None))
    kept = []
    while left:
        first = left[0]
        kept.append(first[0])
        left = [r for r in left if r[1] != first[1] and r[2] != first[2]]
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_dedup_matches_greedy_loop(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for o in range(60):
        rows.append({"id": f"i{rnd.randrange(20)}", "ord": o, "model": None,
                     "plugins": "p" if rnd.random() < 0.1 else None,
                     "conversations": [("human", f"q{rnd.randrange(15)}"), ("gpt", f"a{rnd.randrange(3)}")]})
    df = spark.createDataFrame([(r["id"], r["ord"], r["model"], r["plugins"], r["conversations"]) for r in rows], CONV_T)
    got = sorted(r["ord"] for r in C.dedup_conversations(df).select("ord").collect())
    assert got == greedy_dedup(rows)


def test_dedup_chain_is_not_two_windows(spark):
    # C shares id with B, B shares first exchange with A: A and C are kept, B is not
    rows = [("x", 0, None, None, [("human", "q"), ("gpt", "a")]),
            ("y", 1, None, None, [("human", "q"), ("gpt", "a")]),
            ("y", 2, None, None, [("human", "r"), ("gpt", "b")])]
    df = spark.createDataFrame(rows, CONV_T)
    assert sorted(r["ord"] for r in C.dedup_conversations(df).collect()) == [0, 2]


# ------------------------------------------------------------ D7 splitting
def packed_spans(lens, limit):
    """Spans of whole exchanges by the packing rule, from cumulative sums.

    An exchange joins the open span unless the span, counted from the last cut on, would pass the
    limit; a cut gives the span before it, and the last exchange only closes a span it joins.
    """
    pairs = np.array(lens[: len(lens) // 2 * 2]).reshape(-1, 2).sum(1)
    ends, cuts = np.cumsum(pairs), []
    while len(pairs):
        before = ends[cuts[-1] - 1] if cuts and cuts[-1] else 0
        first = cuts[-1] + 1 if cuts else 0  # the exchange at a cut stays in, however long it is
        over = np.flatnonzero(ends[first:] > before + limit)
        if not len(over):
            break
        cuts.append(first + int(over[0]))
    edges = [0, *cuts] + ([len(pairs)] if len(pairs) and (not cuts or cuts[-1] < len(pairs) - 1) else [])
    return [(2 * a, 2 * b) for a, b in zip(edges, edges[1:])]


@pytest.mark.parametrize("seed", range(3))
def test_split_long_conversation_packs_exchanges(spark, seed):
    rnd = random.Random(seed)
    rows, expect = [], []
    for k in range(40):
        n = rnd.randrange(0, 9)
        conv = [("human" if i % 2 == 0 else "gpt", " ".join("w" for _ in range(rnd.randrange(1, 30)))) for i in range(n)]
        rows.append((f"c{k}", k, "m", None, conv))
        lens = [len(v.split()) + 6 for _, v in conv]
        for s, e in packed_spans(lens, 60):
            expect.append((f"c{k}_{s}", e - s))
    df = spark.createDataFrame(rows, CONV_T)
    got = sorted((r["id"], r["n"]) for r in C.split_long_conversation(df, 60)
                 .select("id", F.size("conversations").alias("n")).collect())
    assert got == sorted(expect)


# ------------------------------------------------------- A1 metrics
def prf_literal(gold, pred):
    classes = sorted(set(gold) | set(pred))
    P, Rc, F1, sup = [], [], [], []
    for c in classes:
        tp = sum(g == c and p == c for g, p in zip(gold, pred))
        npred = sum(p == c for p in pred)
        ngold = sum(g == c for g in gold)
        p = tp / npred if npred else 0.0
        r = tp / ngold if ngold else 0.0
        f = 2 * p * r / (p + r) if p + r else 0.0
        P.append(p); Rc.append(r); F1.append(f); sup.append(ngold)
    tot = sum(sup)
    acc = sum(g == p for g, p in zip(gold, pred)) / len(gold)
    return {"precision_macro": np.mean(P), "recall_macro": np.mean(Rc), "f1_macro": np.mean(F1),
            "precision_weighted": sum(p * s for p, s in zip(P, sup)) / tot,
            "recall_weighted": sum(r * s for r, s in zip(Rc, sup)) / tot,
            "f1_weighted": sum(f * s for f, s in zip(F1, sup)) / tot,
            "precision_micro": acc, "recall_micro": acc, "f1_micro": acc}


@pytest.mark.parametrize("seed", range(3))
def test_prf_matches_definitions(spark, seed):
    rnd = random.Random(seed)
    gold = [rnd.choice([0, 1, 2]) for _ in range(200)]
    pred = [rnd.choice([-1, 0, 1, 2, 3]) for _ in range(200)]
    df = spark.createDataFrame(list(zip(gold, pred)), "gold int, pred int")
    got = M.prf_metrics(df).first().asDict()
    exp = prf_literal(gold, pred)
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, abs=1e-12), k


# ------------------------------------------------------- ordering helpers
def test_global_rank_is_exact(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    r = O.global_rank(df, ["k"], "pos", num_partitions=7)
    assert all(row["k"] == row["pos"] for row in r.collect())


def test_topk_per_group_matches_pandas(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", "c"]) if i % 3 else "a", i, rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = sorted((r["g"], r["id"]) for r in O.topk_per_group(df, ["g"], [F.desc("v"), "id"], 5, salts=8).collect())
    pdf = pd.DataFrame(rows, columns=["g", "id", "v"]).sort_values(["g", "v", "id"], ascending=[True, False, True])
    exp = sorted((g, i) for g, grp in pdf.groupby("g") for i in grp["id"].head(5))
    assert got == exp


# ------------------------------------------------------------- ratings
def test_bt_mle_matches_newton(spark):
    rnd = random.Random(5)
    strength = {f"m{i}": i * 0.3 for i in range(5)}
    rows = []
    for _ in range(3000):
        a, b = rnd.sample(list(strength), 2)
        p = 1 / (1 + math.exp(strength[b] - strength[a]))
        u = rnd.random()
        rows.append((a, b, "model_a" if u < p * 0.9 else ("tie" if u < p * 0.9 + 0.1 else "model_b")))
    df = spark.createDataFrame(rows, "model_a string, model_b string, winner string")
    got = {r["model"]: r["rating"] for r in R.bt_mle(df).collect()}
    cells = R._bt_rows(R.outcome_counts(df)).toPandas()
    exp = R._newton_bt(cells).set_index("model")["rating"].to_dict()
    for k in exp:
        assert got[k] == pytest.approx(exp[k], abs=0.05)


def test_bootstrap_summary_shape(spark):
    rows = [(f"m{i % 3}", f"m{(i + 1) % 3}", "model_a" if i % 4 else "tie") for i in range(300)]
    df = spark.createDataFrame(rows, "model_a string, model_b string, winner string")
    s = R.bootstrap_summary(R.bootstrap_ratings(df, rounds=20, seed=1)).collect()
    assert len(s) == 3
    for r in s:
        assert r["rating_q025"] <= r["median"] <= r["rating_q975"]


# ------------------------------------------------------- P17 html cleaning
def test_clean_html_error_codes(spark):
    rows = [
        ("one", 0, None, None, [("human", "hi")]),                                   # too short -> 1
        ("lead", 1, None, None, [("gpt", "x"), ("human", "<p>hello there friend</p>"),
                                 ("gpt", "<div>a long enough answer</div>")]),      # drop leading gpt -> 0
        ("role", 2, None, None, [("human", "q1"), ("human", "q2"), ("gpt", "a")]),    # wrong format -> 2
        ("block", 3, None, None, [("human", "ask ChatGPT please"), ("gpt", "answer text here")]),  # -> 3
        ("short", 4, None, None, [("human", "a"), ("gpt", "b")]),                     # chars < 16 -> 1
    ]
    df = spark.createDataFrame(rows, CONV_T)
    got = {r["id"]: r["error_code"] for r in C.clean_html_conversation(df).collect()}
    assert got == {"one": 1, "lead": 0, "role": 2, "block": 3, "short": 1}


def test_html_to_markdown_basics(spark):
    df = spark.createDataFrame([("<div class='x'><p>Hello <b>world</b></p><ul><li>one</li></ul></div>",),
                                ("1 / 2Plain &amp; simple",)], "h string")
    got = [r[0] for r in df.select(C.html_to_markdown("h")).collect()]
    assert got[0].startswith("Hello **world**") and "* one" in got[0]
    assert got[1] == "Plain & simple"


# --------------------------------------------------------- P23 cleaning
def test_clean_battles_checks(spark):
    st = "array<struct<conv_id:string,model_name:string,offset:int,messages:array<array<string>>>>"
    schema = f"ord long, type string, tstamp double, models array<string>, states {st}, ip string"
    msgs = [["user", "hello"], ["assistant", "hi there"]]
    s = lambda a, b, m0=msgs, m1=msgs: [("c1", a, 0, m0), ("c2", b, 0, m1)]
    rows = [
        (0, "leftvote", 1.7e9, ["", ""], s("gpt-4", "bard"), "1.1.1.1"),                 # anony, renamed
        (1, "rightvote", 1.7e9, ["x", ""], s("a", "b"), "1.1.1.1"),                      # one public empty
        (2, "tievote", 1.7e9, ["a", "b"], s("a", "c"), "2.2.2.2"),                       # public != hidden
        (3, "leftvote", 1.7e9, ["", ""], s("a", "b", [["user", "I am Koala"]]), "3.3.3.3"),  # leaked
        (4, "leftvote", 1.7e9, ["", ""], s("a", "b"), "9.9.9.9"),                        # banned
        (5, "chat", 1.7e9, ["", ""], s("a", "b"), "1.1.1.1"),                            # not a vote
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["ord"]: (r["reason"], r["model_a"], r["model_b"]) for r in
           clean_battles(df, ban_ips=["9.9.9.9"]).collect()}
    assert got[0] == (None, "gpt-4-0613", "palm-2")
    assert got[1][0] == "invalid" and got[2][0] == "invalid"
    assert got[3][0] == "leaked_identity" and got[4][0] == "banned"
    assert 5 not in got


def test_release_filter_chat_mode_with_char_map(spark):
    from coheral.operators.arena import release_filter
    schema = "id int, conversation array<struct<role:string,content:string>>"
    rows = [(1, [("user", "hello"), ("assistant", "fine")]),
            (2, [("user", "a <redacted> b"), ("assistant", "x")]),
            (3, [("user", "說 禁詞"), ("assistant", "y")]),
            (4, [])]
    df = spark.createDataFrame(rows, schema)
    code = release_filter(F.col("conversation"), blocked_words=["说 禁词"], chat_mode=True,
                          char_map={"說": "说", "詞": "词"})
    got = {r["id"]: r["c"] for r in df.select("id", code.alias("c")).collect()}
    assert got == {1: None, 2: "REDACTED", 3: "BLOCKED_WORD", 4: "BAD_FORMAT"}


def test_clean_battles_sanitized_ids_follow_first_appearance(spark):
    st = "array<struct<conv_id:string,model_name:string,offset:int,messages:array<array<string>>>>"
    schema = f"ord long, type string, tstamp double, models array<string>, states {st}, ip string"
    msgs = [["user", "hello"], ["assistant", "hi there"]]
    s = [("c1", "a", 0, msgs), ("c2", "b", 0, msgs)]
    rows = [(o, "leftvote", 1.7e9 + o, ["", ""], s, ip) for o, ip in enumerate(["z", "y", "z", "x", "y"])]
    got = {r["ord"]: r["judge"] for r in clean_battles(spark.createDataFrame(rows, schema), sanitize_ip=True).collect()}
    assert got == {0: "arena_user_0", 1: "arena_user_1", 2: "arena_user_0", 3: "arena_user_2", 4: "arena_user_1"}


def test_clean_chats_vote_sides_and_latest(spark):
    from coheral.operators.arena import clean_chats
    st = "struct<conv_id:string,model_name:string,offset:int,messages:array<array<string>>>"
    schema = f"ord long, type string, tstamp double, model string, state {st}, states array<{st}>, ip string"
    m1 = [["user", "q"], ["assistant", "a"]]
    m2 = [["user", "q"], ["assistant", "a"], ["user", "q2"], ["assistant", "a2"]]
    net = [["user", "q"], ["assistant", "NETWORK ERROR DUE TO HIGH TRAFFIC. PLEASE REGENERATE OR REFRESH THIS PAGE."]]
    A_ = lambda c, m, msgs: (c, m, 0, msgs)
    rows = [
        (0, "leftvote", 1.0, None, None, [A_("c1", "gpt-4", m1), A_("c2", "bard", m1)], "ip1"),
        (1, "leftvote", 2.0, None, None, [A_("c1", "gpt-4", m2), A_("c2", "bard", m2)], "ip2"),   # later c1 wins
        (2, "rightvote", 3.0, None, None, [A_("c3", "x", m1), A_("c4", "bard", m1)], "ip1"),
        (3, "leftvote", 4.0, None, None, [A_(None, "y", m1), A_("c5", "z", m1)], "ip3"),          # no conv id
        (4, "leftvote", 5.0, None, None, [A_("c6", "y", net), A_("c7", "z", m1)], "ip3"),         # network error
    ]
    df = spark.createDataFrame(rows, schema)
    left = {r["conversation_id"]: (r["model"], r["turn"]) for r in clean_chats(df, "leftvote").collect()}
    assert left == {"c1": ("gpt-4-0314", 2)}
    right = {r["conversation_id"]: r["model"] for r in clean_chats(df, "rightvote").collect()}
    assert right == {"c4": "palm-2"}


def test_daily_counts_pacific_days_and_exclusion(spark):
    from coheral.operators.arena import daily_counts
    # 2024-01-02 07:30 UTC is 2024-01-01 23:30 in Los Angeles
    rows = [("chat", ["", ""], 1704180600 * 10**6), ("leftvote", ["", ""], 1704180600 * 10**6),
            ("leftvote", ["named", "x"], 1704180600 * 10**6), ("chat", ["", ""], 1704240000 * 10**6)]
    df = spark.createDataFrame(rows, "type string, models array<string>, ts_us long")
    got = {(r["day"], r["kind"]): r["n"] for r in daily_counts(df).collect()}
    assert got == {("2024-01-01", "chat"): 1, ("2024-01-01", "anony_vote"): 1, ("2024-01-02", "chat"): 1}
    got2 = {(r["day"], r["kind"]) for r in daily_counts(df, exclude_days=["2024-01-01"]).collect()}
    assert got2 == {("2024-01-02", "chat")}


# ---------------------------------------------------------------- P2 / P3 story labels
@pytest.mark.parametrize("multilabel", [False, True])
def test_labels_of_no_sentence_belong_to_no_pair(spark, multilabel):
    stories = spark.createDataFrame([(1, "t", ["a.", "b."]), (2, "t", ["c."]), (3, None, []), (None, "t", ["d."])],
                                    "uid long, title string, sents array<string>")
    labels = spark.createDataFrame([(1, None, True), (1, 1, True), (2, None, True), (None, 0, True), (None, None, True)],
                                   "uid long, sent_i int, coherence boolean")
    labels = labels.withColumns({c: F.lit(True) for c in ("cohesion", "consistency", "relevance")})
    got = {(r.uid, r.sent_i): r.label for r in P.story_to_pairs(stories, labels, multilabel).collect()}
    want = {(1, 0): 0, (1, 1): 1, (2, 0): 0, (None, 0): 0}
    assert got == {k: [v] * 4 if multilabel else v for k, v in want.items()}
