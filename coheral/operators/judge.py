"""LLM-as-judge layer: verdict parsing, judgment dedup, result tables, agreement
(SURVEY P31-P36, P40, P41, P43, A18-A22, D4-D6, J6-J9, U6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coheral.operators.joins import first_per_key

# ---- fixed values: verdict patterns and constants of the judge protocol -----
TIE_DELTA = 0.1
ONE_SCORE = r"\[\[(\d+\.?\d*)\]\]"
ONE_SCORE_BACKUP = r"\[(\d+\.?\d*)\]"
TWO_SCORE = r"\[\[(\d+\.?\d*),\s?(\d+\.?\d*)\]\]"
TWO_SCORE_BACKUP = r"\[(\d+\.?\d*),\s?(\d+\.?\d*)\]"
NEED_REF_CATS = ["math", "reasoning", "coding", "arena-hard-200"]
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _first_match(text: Column, primary: str, backup: str, idx: int = 1) -> Column:
    """Group ``idx`` of the first match of ``primary``, else of ``backup``, else null."""
    p = F.regexp_extract(text, primary, idx)
    b = F.regexp_extract(text, backup, idx)
    has_p = text.rlike(primary)
    return F.when(has_p, p).when(text.rlike(backup), b)


def parse_single_score(judgment) -> Column:
    """First [[x]], else first [x], else -1 (double)."""
    j = _c(judgment)
    return F.coalesce(_first_match(j, ONE_SCORE, ONE_SCORE_BACKUP).cast("double"), F.lit(-1.0))


def parse_pair_verdict(judgment) -> Column:
    """[[A]] -> A, [[B]] -> B, [[C]] -> tie, else error (that precedence)."""
    j = _c(judgment)
    return (F.when(j.contains("[[A]]"), "A").when(j.contains("[[B]]"), "B")
            .when(j.contains("[[C]]"), "tie").otherwise("error"))


def parse_pair_scores(judgment) -> Column:
    """[[a, b]] else [a, b]; |a-b| <= 0.1 -> tie, a > b -> A, else B; no match -> error."""
    j = _c(judgment)
    has_p = j.rlike(TWO_SCORE)
    a = F.when(has_p, F.regexp_extract(j, TWO_SCORE, 1)).otherwise(F.regexp_extract(j, TWO_SCORE_BACKUP, 1)).cast("double")
    b = F.when(has_p, F.regexp_extract(j, TWO_SCORE, 2)).otherwise(F.regexp_extract(j, TWO_SCORE_BACKUP, 2)).cast("double")
    matched = has_p | j.rlike(TWO_SCORE_BACKUP)
    return (F.when(~matched, "error").when(F.abs(a - b) <= TIE_DELTA, "tie")
            .when(a > b, "A").otherwise("B"))


def map_positions(g1_verdict, g2_verdict) -> tuple[Column, Column]:
    """Game 1 shows model_1 as A; game 2 swaps the positions."""
    g1, g2 = _c(g1_verdict), _c(g2_verdict)
    m1 = F.when(g1 == "A", "model_1").when(g1 == "B", "model_2").otherwise(g1)
    m2 = F.when(g2 == "A", "model_2").when(g2 == "B", "model_1").otherwise(g2)
    return m1, m2


def scores_to_winner(s1, s2) -> Column:
    """Two single scores -> tie / model_1 / model_2 with the 0.1 tie delta."""
    a, b = _c(s1), _c(s2)
    return F.when(F.abs(a - b) <= TIE_DELTA, "tie").when(a > b, "model_1").otherwise("model_2")


def parse_win_choice(df: DataFrame, reply: str, pred_pos: str) -> DataFrame:
    """Last char 'm' -> position 1, 'M' -> 2, else null; win = chosen == prediction position."""
    last = F.substring(F.col(reply), -1, 1)
    choice = F.when(last == "m", 1).when(last == "M", 2)
    return df.withColumn("choice", choice).withColumn("win", (F.col("choice") == F.col(pred_pos)).cast("int"))


def pair_winner(g1, g2) -> Column:
    """Both games agree -> that winner, else 'inconsistent'."""
    return F.when(_c(g1) == _c(g2), _c(g1)).otherwise(F.lit("inconsistent"))


def _reverse(w: Column) -> Column:
    return F.when(w == "model_1", "model_2").when(w == "model_2", "model_1").otherwise(w)


# ------------------------------------------------------------------ results
def single_scores(judgments: DataFrame, model_list: list[str] | None = None) -> DataFrame:
    """Drop score -1; mean score per (model, turn) and per model (turn null).

    One aggregation with GROUPING SETS ((model, turn), (model)).
    """
    df = judgments.filter(F.col("score") != -1)
    if model_list is not None:
        df = df.filter(F.col("model").isin(*model_list))
    return (df.groupingSets([["model", "turn"], ["model"]], "model", "turn")
            .agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")))


def pairwise_results(judgments: DataFrame, baseline: str | None = None,
                     model_list: list[str] | None = None) -> DataFrame:
    """Win / loss / tie per model with win, loss and adjusted rates.

    Errors are dropped; a disagreement between the two games, or a tie, is a tie
    for both models.  ``model_list`` filters on model_1 only (as the reference).
    """
    df = judgments.filter((F.col("g1_winner") != "error") & (F.col("g2_winner") != "error"))
    if model_list is not None:
        df = df.filter(F.col("model_1").isin(*model_list))
    if baseline is not None:
        df = df.filter((F.col("model_1") == baseline) | (F.col("model_2") == baseline))
    tie = (F.col("g1_winner") == "tie") | (F.col("g1_winner") != F.col("g2_winner"))
    w1 = F.col("g1_winner") == "model_1"
    rec = lambda m, w, l, t: F.struct(m.alias("model"), w.cast("int").alias("win"),
                                      l.cast("int").alias("loss"), t.cast("int").alias("tie"))
    two = F.array(
        rec(F.col("model_1"), ~tie & w1, ~tie & ~w1, tie),
        rec(F.col("model_2"), ~tie & ~w1, ~tie & w1, tie))
    out = (df.select(F.explode(two).alias("r"))
           .groupBy(F.col("r.model").alias("model"))
           .agg(F.sum("r.win").alias("win"), F.sum("r.loss").alias("loss"), F.sum("r.tie").alias("tie")))
    if baseline is not None:
        out = out.filter(F.col("model") != baseline)
    n = F.col("win") + F.col("loss") + F.col("tie")
    return out.select("model", "win", "loss", "tie", (F.col("win") / n).alias("win_rate"),
                      (F.col("loss") / n).alias("loss_rate"),
                      ((F.col("win") + 0.5 * F.col("tie")) / n).alias("win_rate_adjusted"))


# --------------------------------------------------------------------- dedup
def dedup_answers_last(answers: DataFrame, keys=("model", "question_id"), order: str = "ord") -> DataFrame:
    """Last line per question (per model file)."""
    return first_per_key(answers, list(keys), [order], last=True)


def dedup_judgments_first(judgments: DataFrame, keys=("model", "question_id", "judge_prompt"),
                          order: str = "ord", models: list[str] | None = None) -> DataFrame:
    """First judgment per (model, question, judge); the model filter applies after dedup."""
    d = first_per_key(judgments, list(keys), [order])
    if models is not None:
        d = d.filter(F.col("model").isin(*models))
    return d


def missing_models(expected: DataFrame, seen: DataFrame, col: str = "model") -> DataFrame:
    """Expected minus seen (anti-join)."""
    return expected.select(col).distinct().join(seen.select(col).distinct(), col, "left_anti")


def judgments_last_by_game(pair: DataFrame, judge_cols=("turn",), order: str = "ord") -> DataFrame:
    """Last row per (judge, question, model_1, model_2), then canonical model order.

    Game keys are normalised so model_1 < model_2, reversing the winner when
    swapped; the two games' judgment texts (columns g1_judgment, g2_judgment, when
    present) change places with them.  When both orientations of a game exist, the one whose raw key was
    first seen later wins -- the overwrite order of the reference's dict rebuild.
    """
    jc = list(judge_cols)
    raw_key = jc + ["question_id", "model_1", "model_2"]
    w = pair_winner("g1_winner", "g2_winner")
    texts = [c for c in ("g1_judgment", "g2_judgment") if c in pair.columns]
    r = (pair.withColumn("winner", w)
         .groupBy(*raw_key)
         .agg(F.min(order).alias("first_ord"),
              F.max_by(F.struct("winner", order, *texts), F.col(order)).alias("last")))
    swap = F.col("model_1") >= F.col("model_2")
    norm = r.select(*jc, "question_id",
                    F.when(swap, F.col("model_2")).otherwise(F.col("model_1")).alias("model_lo"),
                    F.when(swap, F.col("model_1")).otherwise(F.col("model_2")).alias("model_hi"),
                    F.when(swap, _reverse(F.col("last.winner"))).otherwise(F.col("last.winner")).alias("winner"),
                    "first_ord", F.col(f"last.{order}").alias("src_ord"),
                    *[F.when(swap, F.col(f"last.{o}")).otherwise(F.col(f"last.{c}")).alias(c)
                      for c, o in zip(texts, reversed(texts))])
    return (norm.groupBy(*jc, "question_id", "model_lo", "model_hi")
            .agg(F.max_by(F.struct("winner", "src_ord", *texts), F.col("first_ord")).alias("g"))
            .select(*jc, "question_id", "model_lo", "model_hi", "g.winner", "g.src_ord", *[f"g.{c}" for c in texts]))


# ------------------------------------------------------------- agreement
def judge_group(judge) -> Column:
    """gpt-4 with a pair prompt -> gpt4-pair, expert* -> human, author* -> author, anything else null (excluded).

    A model judge is written ``model:prompt name``.
    """
    j = _c(judge)
    return (F.when(j.startswith("gpt-4:pair"), "gpt4-pair").when(j.startswith("expert"), "human")
            .when(j.startswith("author"), "author"))


def votes_by_game(votes: DataFrame) -> DataFrame:
    """Canonical key (question, min model, max model, turn), winner flipped when swapped."""
    swap = F.col("model_a") >= F.col("model_b")
    w = F.col("winner")
    rev = F.when(w == "model_a", "model_b").when(w == "model_b", "model_a").otherwise(w)
    return votes.select(
        "question_id", "turn",
        F.least("model_a", "model_b").alias("model_lo"), F.greatest("model_a", "model_b").alias("model_hi"),
        F.when(swap, rev).otherwise(w).alias("winner"),
        judge_group("judge").alias("judge_group"), *[c for c in votes.columns if c == "ord"])


def judge_agreement(votes: DataFrame, judge: str = "gpt4-pair", other: str = "human") -> DataFrame:
    """Agreement counts per turn, with and without ties, without emitting vote pairs.

    Two votes agree when both are ties of any kind or they name the same winner.
    Per game and vote class c with n_c votes: judge-vs-human agree = sum_c
    nj_c * nh_c over total NJ * NH; human-vs-human agree = sum_c C(n_c, 2) over
    C(N, 2).  Counting per (game, class) keeps the work linear in the votes even
    when one game holds most of them.  A model judge votes once per game; a game
    with human votes and another number of judge votes fails the job.
    """
    g = votes_by_game(votes).filter(F.col("judge_group").isNotNull())
    cls = F.when(F.col("winner").contains("tie"), "tie").otherwise(F.col("winner"))
    key = ["turn", "question_id", "model_lo", "model_hi"]
    counts = (g.groupBy(*key, cls.alias("cls"))
              .agg(F.count(F.when(F.col("judge_group") == judge, 1)).alias("nj"),
                   F.count(F.when(F.col("judge_group") == other, 1)).alias("nh")))
    if judge.startswith("gpt4"):
        votes_here = F.sum("nj").over(Window.partitionBy(*key))
        humans_here = F.sum("nh").over(Window.partitionBy(*key))
        twice = (votes_here > 1) & (humans_here > 0)
        counts = counts.withColumn("nj", F.when(twice, F.raise_error(F.concat(
            F.lit("more than one judge vote on question "), F.col("question_id").cast("string"))).cast("long")).otherwise(F.col("nj")))
    nt = F.col("cls") != "tie"
    nj_nt, nh_nt = F.when(nt, F.col("nj")).otherwise(0), F.when(nt, F.col("nh")).otherwise(0)
    # both variants (ties kept / ties banned) in one pass of conditional sums
    per_game = counts.groupBy(*key).agg(
        F.sum(F.col("nj") * F.col("nh")).alias("ja_t"), (F.sum("nj") * F.sum("nh")).alias("jt_t"),
        F.sum(F.col("nh") * (F.col("nh") - 1) / 2).alias("ha_t"),
        (F.sum("nh") * (F.sum("nh") - 1) / 2).alias("ht_t"),
        F.sum(nj_nt * nh_nt).alias("ja_n"), (F.sum(nj_nt) * F.sum(nh_nt)).alias("jt_n"),
        F.sum(nh_nt * (nh_nt - 1) / 2).alias("ha_n"), (F.sum(nh_nt) * (F.sum(nh_nt) - 1) / 2).alias("ht_n"))
    sums = per_game.groupBy("turn").agg(*[F.sum(c).cast("long").alias(c) for c in
                                          ("ja_t", "jt_t", "ha_t", "ht_t", "ja_n", "jt_n", "ha_n", "ht_n")])
    rec = lambda wt, pair, a, t: F.struct(F.lit(wt).alias("with_tie"), F.lit(pair).alias("pair"),
                                           F.col(a).alias("agree"), F.col(t).alias("total"))
    res = sums.select("turn", F.explode(F.array(
        rec(True, f"{judge}_vs_{other}", "ja_t", "jt_t"), rec(True, f"{other}_vs_{other}", "ha_t", "ht_t"),
        rec(False, f"{judge}_vs_{other}", "ja_n", "jt_n"), rec(False, f"{other}_vs_{other}", "ha_n", "ht_n"))).alias("s"))
    return res.select("turn", "s.with_tie", "s.pair", "s.agree", "s.total",
                      F.when(F.col("s.total") > 0, F.col("s.agree") / F.col("s.total")).alias("ratio"))


# ------------------------------------------------------------------- matches
def resolve_judge(questions: DataFrame, pairwise: bool = True) -> DataFrame:
    """Judge prompt name per question turn: reference-needing category x multi-turn."""
    ref = F.col("category").isin(*NEED_REF_CATS)
    base = "pair" if pairwise else "single"
    ex = questions.select("question_id", "category", F.posexplode("turns").alias("t", "turn_text"))
    name = F.concat(F.lit(base), F.when(ref, F.lit("-math-v1")).otherwise(F.lit("-v1" if not pairwise else "-v2")),
                    F.when(F.col("t") >= 1, F.lit("-multi-turn")).otherwise(F.lit("")))
    return ex.select("question_id", "category", (F.col("t") + 1).alias("turn"), name.alias("judge_prompt"))


def match_single(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One match per (question, model answer) -- an equi-join."""
    return questions.join(answers, "question_id")


def match_baseline(questions: DataFrame, answers: DataFrame, baseline: str) -> DataFrame:
    """Question x model (!= baseline) with both answers, via two equi-joins."""
    base = answers.filter(F.col("model_id") == baseline).select(
        "question_id", F.col("choices").alias("baseline_choices"))
    others = answers.filter(F.col("model_id") != baseline)
    return questions.join(others, "question_id").join(base, "question_id").withColumn("baseline", F.lit(baseline))


def check_completeness(answers: DataFrame, questions: DataFrame, models: list[str]) -> DataFrame:
    """(model, question) pairs with no answer.

    ``models`` is the model list the user asks to judge (a parameter, bounded by
    its length); each question row is expanded over that literal list -- a
    generator, not a join -- and anti-joined against the answers.
    """
    expected = questions.select("question_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_id"))
    return expected.join(answers.select("question_id", "model_id"), ["question_id", "model_id"], "left_anti")


def match_all_pairs(questions: DataFrame, answers: DataFrame, models: list[str]) -> DataFrame:
    """Question x unordered model pairs (i < j in list order) with both answers.

    The pairs come from the user's model list (|models|^2 / 2 per question, a
    parameter bound); answers are attached by two equi-joins.
    """
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    arr = F.array(*[F.struct(F.lit(a).alias("model_1"), F.lit(b).alias("model_2")) for a, b in pairs])
    q = questions.select("*", F.inline(arr))
    a1 = answers.select("question_id", F.col("model_id").alias("model_1"), F.col("choices").alias("answer_1"))
    a2 = answers.select("question_id", F.col("model_id").alias("model_2"), F.col("choices").alias("answer_2"))
    return q.join(a1, ["question_id", "model_1"]).join(a2, ["question_id", "model_2"])


def question_preview(questions: DataFrame, width: int = 128) -> DataFrame:
    """P43: 'id: first 128 chars...' per question with its category."""
    first = F.col("turns")[0]
    text = F.concat(F.col("question_id").cast("string"), F.lit(": "), F.substring(first, 1, width), F.lit("..."))
    return questions.select("category", "question_id", text.alias("preview"))


# ---- fixed values: layout of an explanation -------------------------------
EXPLANATION_GAME = "**Game {n}**. **A**: {a}, **B**: {b}\n\n**Judgment**: "
EXPLANATION_RULE = "\n\n`--------------------------`\n\n"
NO_EXPLANATION = "N/A"
# ---------------------------------------------------------------------------


def explanation_view(games: DataFrame, judgments: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Both games' judgment texts for (question_id, turn) of ``games``, shown with ``model_a`` as A in game 1.

    ``judgments`` is D6's output with texts; a game without a judgment reads 'N/A'.
    """
    lo, hi = sorted([model_a, model_b])
    g1, g2 = ("g1_judgment", "g2_judgment") if model_a == lo else ("g2_judgment", "g1_judgment")
    own = judgments.filter((F.col("model_lo") == lo) & (F.col("model_hi") == hi)).select(
        "question_id", "turn", F.col(g1).alias("_g1"), F.col(g2).alias("_g2"))
    head = [F.lit(EXPLANATION_GAME.format(n=n, a=a, b=b)) for n, a, b in ((1, model_a, model_b), (2, model_b, model_a))]
    text = F.concat(head[0], F.col("_g1"), F.lit(EXPLANATION_RULE), head[1], F.col("_g2"))
    return (games.select("question_id", "turn").join(own, ["question_id", "turn"], "left")
            .select("question_id", "turn", F.lit(model_a).alias("model_a"), F.lit(model_b).alias("model_b"),
                    F.coalesce(text, F.lit(NO_EXPLANATION)).alias("explanation")))


def single_explanation_view(games: DataFrame, judgments: DataFrame, model: str) -> DataFrame:
    """P40 (single grading): score and judgment text of ``model`` per (question_id, turn); 'N/A' without one."""
    own = judgments.filter(F.col("model") == model).select("question_id", "turn", F.col("score").alias("_s"), F.col("judgment").alias("_j"))
    text = F.concat(F.lit(f"**Game 1**. **A**: {model}, **Score**: "), F.col("_s").cast("string"),
                    F.lit("\n\n**Judgment**: "), F.col("_j"))
    return (games.select("question_id", "turn").join(own, ["question_id", "turn"], "left")
            .select("question_id", "turn", F.lit(model).alias("model"), F.coalesce(text, F.lit(NO_EXPLANATION)).alias("explanation")))


# ------------------------------------------------------------- judge runs
def attach_references(matches: DataFrame, references: DataFrame) -> DataFrame:
    """Reference answers (question_id, turns array) for questions of the categories that need one, else null."""
    ref = references.select("question_id", F.col("turns").alias("reference_turns"))
    need = F.col("category").isin(*NEED_REF_CATS)
    return matches.join(ref, "question_id", "left").withColumn(
        "reference_turns", F.when(need, F.col("reference_turns")))


def missing_references(questions: DataFrame, references: DataFrame) -> DataFrame:
    """Questions that need a reference answer and have none."""
    need = questions.filter(F.col("category").isin(*NEED_REF_CATS)).select("question_id")
    return need.join(references.select("question_id"), "question_id", "left_anti")


def render_prompt(template: Column, values: dict[str, Column]) -> Column:
    """fill ``{name}`` placeholders of a template column in one pass (values are never searched again).

    Null if the template names a value that is null; names that aren't given stay as they are.
    """
    parts = F.split(template, r"(?=\{[a-z0-9_]+\})|(?<=\})", -1)
    filled = F.create_map(*[x for k, v in values.items() for x in (F.lit("{" + k + "}"), v)])
    lacking = F.exists(parts, lambda p: F.map_contains_key(filled, p) & F.element_at(filled, p).isNull())
    text = F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(filled, p), p)), "")
    return F.when(~lacking, text)


def _values(first: Column, second: Column | None, ref: Column, multi: bool) -> dict[str, Column]:
    """Placeholder values of a match: ``first`` / ``second`` are answer turn arrays, ``ref`` the reference's; turns that aren't there are null."""
    q, names = F.col("turns"), {}
    sides = [("answer", first)] if second is None else [("answer_a", first), ("answer_b", second)]
    if multi:
        names |= {"question_1": F.get(q, 0), "question_2": F.get(q, 1), "ref_answer_2": F.get(ref, 1)}
        for n, side in sides:
            names |= {f"{n}_1": F.get(side, 0), f"{n}_2": F.get(side, 1)}
    else:
        names |= {"question": F.get(q, 0)} | {n: F.get(side, 0) for n, side in sides}
    return names | {"ref_answer_1": F.get(ref, 0)}


def _match_prompt(first: Column, second: Column | None, multi: bool, missing: str) -> Column:
    """System prompt and filled template of a match whose prompt row is joined; ``missing`` as in ``judge_pairs``."""
    text = F.concat(F.col("system_prompt"), F.lit("\n\n"), render_prompt(
        F.col("prompt_template"), _values(first, second, F.col("reference_turns"), multi)))
    if missing == "skip":
        return text
    if missing != "fail":
        raise ValueError(missing)
    told = F.concat(F.lit("question "), F.col("question_id").cast("string"), F.lit(": a turn or reference answer that "),
                    F.col("judge_prompt"), F.lit(" names is missing"))
    return F.coalesce(text, F.raise_error(told).cast("string"))


def judge_pairs(matches: DataFrame, prompts: DataFrame, fn, multi_turn: bool = False, missing: str = "fail", **call) -> DataFrame:
    """Play both games of every match against a judge (the hook of ``llm_map``) and write the judgment rows.

    ``matches``: question_id, category, turns, model_1, model_2, answer_1, answer_2 (turn arrays),
    reference_turns.  ``prompts``: name, system_prompt, prompt_template (S5).  Game 1 shows model_1
    as A, game 2 model_2.  Output: question_id, model_1, model_2, turn, judge_prompt, both winners,
    prompts and judgments.  Where the template names a turn or reference answer that the match
    doesn't have, the run fails and says which question it is (``missing_references`` finds them before);
    ``missing="skip"`` asks no judge there: prompts and judgments are null, the winners 'error'.
    """
    from coheral.operators.external import llm_map

    need = F.col("category").isin(*NEED_REF_CATS)
    name = F.concat(F.when(need, F.lit("pair-math-v1")).otherwise(F.lit("pair-v2")), F.lit("-multi-turn" if multi_turn else ""))
    m = matches.withColumn("judge_prompt", name).join(
        prompts.select(F.col("name").alias("judge_prompt"), "system_prompt", "prompt_template"), "judge_prompt")
    game = lambda n, a, b: F.struct(F.lit(n).alias("game"), _match_prompt(F.col(a), F.col(b), multi_turn, missing).alias("prompt"))
    games = m.select("question_id", "model_1", "model_2", "judge_prompt",
                     F.explode(F.array(game(1, "answer_1", "answer_2"), game(2, "answer_2", "answer_1"))).alias("g")).select(
        "question_id", "model_1", "model_2", "judge_prompt", "g.*")
    played = llm_map(games, "prompt", fn, out_col="judgment", **call)
    one = lambda c, n: F.max(F.when(F.col("game") == n, F.col(c)))
    out = played.groupBy("question_id", "model_1", "model_2", "judge_prompt").agg(
        *[one(c, n).alias(f"g{n}_{o}") for n in (1, 2) for c, o in (("prompt", "user_prompt"), ("judgment", "judgment"))])
    g1, g2 = map_positions(parse_pair_verdict("g1_judgment"), parse_pair_verdict("g2_judgment"))
    return out.withColumns({"turn": F.lit(2 if multi_turn else 1), "g1_winner": g1, "g2_winner": g2})


def judge_singles(matches: DataFrame, prompts: DataFrame, fn, multi_turn: bool = False, missing: str = "fail", **call) -> DataFrame:
    """X4 (single grading): one call per (question, model answer); the score is parsed from the reply (-1: none).

    ``missing`` as in ``judge_pairs``: a skipped match has a null prompt and judgment and score -1.
    """
    from coheral.operators.external import llm_map

    need = F.col("category").isin(*NEED_REF_CATS)
    name = F.concat(F.when(need, F.lit("single-math-v1")).otherwise(F.lit("single-v1")), F.lit("-multi-turn" if multi_turn else ""))
    m = matches.withColumn("judge_prompt", name).join(
        prompts.select(F.col("name").alias("judge_prompt"), "system_prompt", "prompt_template"), "judge_prompt")
    text = _match_prompt(F.col("answer"), None, multi_turn, missing)
    played = llm_map(m.select("question_id", "model_id", "judge_prompt", text.alias("user_prompt")), "user_prompt", fn, out_col="judgment", **call)
    return played.withColumns({"turn": F.lit(2 if multi_turn else 1), "score": parse_single_score("judgment")})


def judge_stats(matches: DataFrame, model: str = "model_id") -> DataFrame:
    """Number of matches, distinct models and questions before running a judge."""
    return matches.agg(F.count(F.lit(1)).alias("n_matches"), F.countDistinct(model).alias("n_models"),
                       F.countDistinct("question_id").alias("n_questions"))
