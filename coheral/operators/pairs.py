"""Essay / story -> (context, sentence) pair builders and annotation aggregation.

SURVEY P1-P9, D8, J1, A16, A17.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coheral.functions.text import split_sentences


def with_topic(essays: DataFrame, topics: DataFrame | None, by: str = "essay_id") -> DataFrame:
    """The topic of each essay's prompt, joined at essay grain and spread by essay.

    What follows expands an essay to one row per sentence, so essays are dealt
    out by their id before it: long ones do not share the split they were read in.
    ``by`` names the id; a join by that id that follows does not move the texts again.
    """
    if topics is None:
        e = essays.withColumn("topic", F.lit(None).cast("string"))
    else:
        e = essays.join(topics.select("prompt_id", "topic"), "prompt_id")
    return e.repartition(by)


def incremental_pairs(essays: DataFrame, topics: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """P1 (+J1): one row per sentence i >= 1 with the running context 0..i-1.

    Output: essay_id, topic, sent_idx, context, sentence and the essay columns
    named in ``carry``.  Essays with fewer than two sentences emit nothing.
    Context size is O(i) per row by definition, so the output is quadratic in
    essay length; nothing is joined or shuffled after the expansion.
    """
    s = with_topic(essays, topics).select("essay_id", "topic", *carry, split_sentences("text").alias("sents"))
    ex = s.select("essay_id", "topic", *carry, "sents", F.posexplode("sents").alias("sent_idx", "sentence"))
    return (ex.filter(F.col("sent_idx") >= 1)
            .select("essay_id", "topic", *carry, "sent_idx",
                    F.array_join(F.slice("sents", 1, F.col("sent_idx")), " ").alias("context"),
                    "sentence"))


def incremental_pairs_window(essays: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """The same pairs via a running-prefix window (frame unboundedPreceding..-1).

    The window partition is one essay, whose size is bounded by the essay row.
    """
    s = with_topic(essays, topics).select("essay_id", "topic", F.posexplode(split_sentences("text")).alias("sent_idx", "sentence"))
    w = Window.partitionBy("essay_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    return (s.withColumn("context", F.array_join(F.collect_list("sentence").over(w), " "))
            .filter(F.col("sent_idx") >= 1)
            .select("essay_id", "topic", "sent_idx", "context", "sentence"))


def reason_group(reason) -> F.Column:
    """1-3 cohesion, 4-5 consistency, 6-7 relevance, anything else other."""
    r = F.col(reason) if isinstance(reason, str) else reason
    return (F.when(r.isin(1, 2, 3), "cohesion").when(r.isin(4, 5), "consistency")
            .when(r.isin(6, 7), "relevance").otherwise("other"))


def annotation_majority(annotations: DataFrame, last_annotator_only: bool = False) -> DataFrame:
    """Per (story, sentence) reason counts and majority flags.

    ``annotations``: story_id, sent_i, annot, reason, num_annotators (one row per
    reason given by one annotator).  Every reason counts toward incoherence; the
    grouped counts exclude 'other'.  A flag is set when count >= num_annotators/2.
    Default sums over annotators (intended); ``last_annotator_only`` keeps only
    the greatest annotator id per story, reproducing the reference's reset bug.
    """
    a = annotations
    if last_annotator_only:
        last = a.groupBy("story_id").agg(F.max("annot").alias("annot"))
        a = a.join(last, ["story_id", "annot"], "left_semi")
    g = reason_group("reason")
    agg = (a.groupBy("story_id", "sent_i")
           .agg(F.count(F.lit(1)).alias("n_reasons"),
                F.count(F.when(g == "cohesion", 1)).alias("n_cohesion"),
                F.count(F.when(g == "consistency", 1)).alias("n_consistency"),
                F.count(F.when(g == "relevance", 1)).alias("n_relevance"),
                F.max("num_annotators").alias("num_annotators")))
    half = F.col("num_annotators") / 2
    return agg.select(
        "story_id", "sent_i", "n_reasons", "n_cohesion", "n_consistency", "n_relevance",
        (F.col("n_reasons") >= half).alias("incoherent"),
        (F.col("n_cohesion") >= half).alias("cohesion_flag"),
        (F.col("n_consistency") >= half).alias("consistency_flag"),
        (F.col("n_relevance") >= half).alias("relevance_flag"))


def consensus_scores(stories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holistic and incremental consensus tables (title, text, consensus)."""
    hol = stories.select("title", "text", F.col("holistic_consensus").alias("consensus"))
    inc = stories.select("title", "text", F.col("incremental_consensus").alias("consensus"))
    return hol, inc


def story_pairs_long(stories: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """P2 core: every sentence i (including 0) with its prefix context.

    ``stories``: uid, title, sents.  Output: uid, title, guid 'uid-i', sent_i,
    sent1 (sentences 0..i-1 joined by ' '), sent2 (sentence i) and the story
    columns named in ``carry``.
    """
    ex = stories.select("uid", "title", *carry, "sents", F.posexplode("sents").alias("sent_i", "sent2"))
    return ex.select("uid", "title", *carry,
                     F.concat_ws("-", F.col("uid").cast("string"), F.col("sent_i").cast("string")).alias("guid"),
                     "sent_i", F.array_join(F.slice("sents", 1, F.col("sent_i")), " ").alias("sent1"), "sent2")


def story_to_pairs(stories: DataFrame, labels: DataFrame, multilabel: bool = False) -> DataFrame:
    """Story pairs labelled from a long (uid, sent_i, flags...) table.

    A story's labels (at most one per sentence) become one map, joined at story
    grain: no text is shuffled after the prefixes are built.  Labels of other
    stories or of no sentence (null) are left out before they are gathered.  Missing labels
    count as False (coherent).  ``multilabel`` returns label array<int>
    [coherence, cohesion, consistency, relevance].
    """
    flags = ("coherence", "cohesion", "consistency", "relevance")
    placed = labels.filter(F.col("sent_i").isNotNull())  # a null is no map key
    per_story = placed.join(stories.select("uid"), "uid", "left_semi").groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("sent_i").cast("int"), F.struct(*flags)))).alias("labels"))
    j = story_pairs_long(stories.join(per_story, "uid", "left"), ("labels",))
    own = F.element_at("labels", F.col("sent_i"))
    flag = lambda c: F.coalesce(own[c], F.lit(False)).cast("int")
    label = F.array(*[flag(c) for c in flags]) if multilabel else flag("coherence")
    return j.select("uid", "title", "guid", "sent_i", "sent1", "sent2", label.alias("label"))


def two_sentence_pairs(pairs: DataFrame) -> DataFrame:
    """Rows already hold [context, sentence]; label = 'sent1' entry, guid uid-0."""
    return pairs.select(F.concat(F.col("uid").cast("string"), F.lit("-0")).alias("guid"),
                        F.col("sents")[0].alias("sent1"), F.col("sents")[1].alias("sent2"),
                        F.element_at("labels", F.lit("sent1")).cast("int").alias("label"))


# ---- fixed values: prompt wording of the T5 / GPT story formats ------------
# task -> (T5 prefix, T5 question suffix)
T5_TASKS = {
    "sent_binary": ("coherent sentence: ", " is the new sentence coherent?"),
    "sent_cohesion": ("cohesive sentence: ", " is the new sentence coheisive?"),
    "sent_consistency": ("consistent sentence: ", " is the new sentence consistent?"),
    "sent_relevance": ("relevant sentence: ", " is the new sentence relevant?"),
}
T5_MULTILABEL_PREFIX = "multi label incoherence reasons: "
T5_TITLE_PREFIX = "title: "
T5_TEXT_PREFIX = ". text: "
T5_SCORE_PREFIX = "coherence score: "
T5_SCORE_QUESTION = " what is the coherence score (between 1 to 5)?"
# task -> GPT fine-tune question line
GPT_TASKS = {
    "sent_binary": "Task: Is the new sentence coherent in regards to the previous data? give a yes or no answer ",
    "sent_cohesion": "Task: Is the new sentence coheisive in regards to the previous data? give a yes or no answer ",
    "sent_consistency": "Task: Is the new sentence consistent in regards to the previous data? give a yes or no answer ",
    "sent_relevance": "Task: Is the new sentence relevant in regards to the previous data? give a yes or no answer ",
}
GPT_SCORE_QUESTION = "Task: Give just a discrete coherence score between 1 to 5 for the paragraph as number?"
GPT_TITLE_PREFIX = "Title: "
GPT_TEXT_PREFIX = "Text: "
GPT_PREV_PREFIX = "Previous Data: "
GPT_NEW_PREFIX = "New Sentence: "
GPT_END_PROMPT = "\n###\n\n"
GPT_END_COMPLETION = "\n"
# ---------------------------------------------------------------------------


def story_to_t5_text(pairs: DataFrame, task: str = "sent_binary") -> DataFrame:
    """P5: T5 input text per pair; label 1 (= incoherent) -> 'no' else 'yes'.

    ``pairs``: guid, title, sent1, sent2, label (int) -- the output of P2 with a title.
    Multi-label (``task='sent_reason'``) expects label array<int> of four flags.
    """
    if task == "sent_reason":
        words = [("not_coherent", "coherent"), ("not_cohesive", "cohesive"),
                 ("not_consistent", "consistent"), ("not_relevant", "relevant")]
        target = F.concat(F.concat_ws(" , ", *[F.when(F.col("label")[i] == 1, a).otherwise(b)
                                               for i, (a, b) in enumerate(words)]), F.lit(" </s>"))
        prefix, question = T5_MULTILABEL_PREFIX, ""
    else:
        prefix, question = T5_TASKS[task]
        target = F.when(F.col("label") == 1, "no").otherwise("yes")
    text = F.concat(F.lit(prefix + T5_TITLE_PREFIX), F.col("title"), F.lit("paragraph: "), F.col("sent1"),
                    F.lit("new sentence: "), F.col("sent2"), F.lit(question))
    return pairs.select("guid", "title", text.alias("text"), target.alias("label"))


def score_to_t5_text(stories: DataFrame) -> DataFrame:
    """Holistic score prompt; label = score + 1 followed by ' </s>'."""
    text = F.concat(F.lit(T5_SCORE_PREFIX + T5_TITLE_PREFIX), F.col("title"), F.lit(T5_TEXT_PREFIX),
                    F.col("text"), F.lit(T5_SCORE_QUESTION))
    return stories.select("uid", text.alias("text"),
                          F.concat((F.col("score") + 1).cast("string"), F.lit(" </s>")).alias("label"))


def story_to_prompt_completion(pairs: DataFrame, task: str = "sent_binary") -> DataFrame:
    """GPT fine-tune prompt/completion; completion ' no' if label else ' yes'."""
    prompt = F.concat(F.lit(GPT_TITLE_PREFIX), F.col("title"), F.lit("\n" + GPT_PREV_PREFIX), F.col("sent1"),
                      F.lit("\n" + GPT_NEW_PREFIX), F.col("sent2"),
                      F.lit("\n" + GPT_TASKS[task] + "\n" + GPT_END_PROMPT))
    return pairs.select("guid", prompt.alias("prompt"),
                        F.when(F.col("label") == 1, " no").otherwise(" yes").alias("completion"))


def score_to_prompt_completion(stories: DataFrame) -> DataFrame:
    """P7 (score variant): completion = score + 1 and a newline."""
    prompt = F.concat(F.lit(GPT_TITLE_PREFIX), F.col("title"), F.lit("\n" + GPT_TEXT_PREFIX), F.col("text"),
                      F.lit("\n" + GPT_SCORE_QUESTION + "\n" + GPT_END_PROMPT))
    return stories.select("uid", prompt.alias("prompt"),
                          F.concat((F.col("score") + 1).cast("string"), F.lit(GPT_END_COMPLETION)).alias("completion"))


def pairs_to_story_format(pairs: DataFrame) -> DataFrame:
    """Benchmark pair -> story format (label null -> 0, sents = [context, sentence])."""
    lab = F.coalesce(F.col("label"), F.lit(0)) == 1
    m = lambda v: F.create_map(F.lit("sent0"), F.lit(False), F.lit("sent1"), v)
    return pairs.select(
        F.col("topic").alias("title"),
        F.concat(F.col("context"), F.lit(" "), F.col("sentence")).alias("text"),
        F.array("context", "sentence").alias("sents"),
        m(lab).alias("coherence_per_sent"), m(lab).alias("cohesion_per_sent"),
        m(lab).alias("consistency_per_sent"), m(lab).alias("relevance_per_sent"))


def story_to_pairs_explode(stories: DataFrame) -> DataFrame:
    """Running context list ['', s0, s0+' '+s1, ...] exploded with the sentences."""
    ex = stories.select("uid", "sents", F.posexplode("sents").alias("sent_i", "sentence"))
    return ex.select("uid", "sent_i", F.array_join(F.slice("sents", 1, F.col("sent_i")), " ").alias("context"),
                     "sentence")


def split_by_title(stories: DataFrame, train_ratio: float = 0.85, seed: int = 42, title: str = "title") -> DataFrame:
    """Train / dev split on titles, so all stories of a title land together.

    A title goes to train when the 13-hex-digit MD5 prefix of (seed, title) is
    below ``train_ratio`` of the range; comparing fixed-width hex strings keeps
    the rule exact and restatable.  Adds ``split``.
    """
    from coheral.functions.hashing import hash_key
    cut = format(int(train_ratio * 16 ** 13), "013x")
    h = F.substring(hash_key(F.col(title), seed), 1, 13)
    return stories.withColumn("split", F.when(h < F.lit(cut), "train").otherwise("dev"))
