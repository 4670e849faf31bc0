"""Supervised fine-tuning example builders and prompt rendering.

Templates are split once on their placeholders and re-assembled with
``concat`` -- a single-pass substitution like ``str.format`` (a value that
itself contains '{sentence}' is not substituted again).  Token counts for
masks come from a pluggable Column function (default: whitespace words).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.functions.subword import lengths
from coheral.functions.text import word_count

# ---- fixed values: task wording ------------------------------------------------
DETECTION_TEMPLATE = (
    "You are about to perform the task of coherence detection for the sentences written by second-language English "
    "learners. In this task, given a sentence S and a context C, you need to output 1 if S is coherent with C based "
    "on the following instructions; otherwise, output 0. You should output 1 only if: \na) sentence S semantically "
    "connects to context C, and \nb) all entities discussed in the new sentence S have been introduced in C, and \n"
    "c) the relation between sentence S and previous ones in C makes sense due to proper use of discourse markers, "
    "and \nd) the new sentence S does not contradict or is not inconsistent with previously presented information "
    "in C, and \ne) the new sentence S introduces information that is relevant to the context C established by the "
    "writer. Now, please generate: \nC: {context} \nS: {sentence} \n")
COHESION_TEMPLATE = (
    "You are about to perform the task of cohesion detection for the sentences written by second-language English "
    "learners. In this task, given a sentence S that is incoherent with a context C, you need to output 1 if S is "
    "incoherent with C because of a lack of cohesion based on the following instructions; otherwise, output 0. You "
    "should output 1 only if: \na) sentence S does not connect semantically with context C, or \nb) sentence S "
    "discusses an entity that has not been introduced in C yet, or sentence S discusses an entity that is ambiguous "
    "in C, or \nc) the relation between sentence S and previous ones in C doesn't make sense due to a missing "
    "discourse marker. \nC: {context} \nS: {sentence} \nAnswer:")
CONSISTENCY_TEMPLATE = (
    "You are about to perform the task of consistency detection for the sentences written by second-language English "
    "learners. In this task, given a sentence S that is incoherent with a context C, you need to output 1 if S "
    "contradicts previously presented information in C; otherwise, output 0. \nC: {context} \nS: {sentence} \nAnswer:")
RELEVANCE_TEMPLATE = (
    "In this task, given a sentence S that is incoherent with a context C, you need to output 1 if S is incoherent "
    "with C because of a lack of relevance based on the following instructions; otherwise, output 0. You should "
    "output 1 only if: \na) sentence S introduces information that is completely irrelevant to context C, or \nb) "
    "sentence S introduces information that is either tangential or slightly irrelevant to context C. \n"
    "C: {context} \nS: {sentence} \nAnswer:")
OTHER_TEMPLATE = (
    "In this task, given a sentence S that is incoherent with a context C, you need to output 1 if S is incoherent "
    "with C because of the disagreement between the topic and the comment of sentence S; otherwise, output 0. "
    "Specifically, you should output 1 only if the comment of sentence S does not agree with the topic of the "
    "sentence itself. \nC: {context} \nS: {sentence} \nAnswer:")
REWRITING_TEMPLATE = (
    "You are about to perform the task of sentence rewriting for the sentences written by second-language English "
    "learners. In this task, given a sentence S and a context C, you need to rewrite sentence S to make it more "
    "coherent with C. \nC: {context} \nS: {sentence} \nAnswer:")
REWRITING_REASONS_TEMPLATE = (
    "You are about to perform the task of sentence rewriting for the sentences written by second-language English "
    "learners. In this task, given a sentence S and a context C, you need to rewrite sentence S to make it more "
    "coherent with C according to the following instructions: {reason_texts}  \nC: {context} \nS: {sentence} \nAnswer:")
TASK_TEMPLATES = {"detection": DETECTION_TEMPLATE, "cohesion": COHESION_TEMPLATE, "consistency": CONSISTENCY_TEMPLATE,
                  "relevance": RELEVANCE_TEMPLATE, "other": OTHER_TEMPLATE, "rewriting": REWRITING_TEMPLATE,
                  "rewriting_reasons": REWRITING_REASONS_TEMPLATE}
TARGET_TEMPLATE = "Answer: {label}</s>"
# Lexical substitution task (word SFT): prompt and target.
WORD_TEMPLATE = (
    "You are about to perform a lexical substitution task, considering the proficiency level of the substitute "
    "compared to the target word in a sentence. The task is to generate a set of candidate substitutes seperated by "
    "commas for a target word in a given sentence. The target word is highlighted in the sentence, encompassed by two "
    "double asterisks. The candidate substitutes should be: \n a) common collocations or expressions in actual English "
    "use, \n b) grammatically correct, \n c) have an equal or higher language proficiency level compared to the "
    "target word. Target word: {target_word} \n Sentence: {sentence}")
WORD_TARGET_TEMPLATE = "Substitutes: {substitutes}</s>"
# Instruction sentence appended for each active reason R1..R7 (rewriting with reasons).
REASON_SENTENCES = [
    "add reference words or repeated words/ideas or substitution that can semantically connect sentence S to "
    "context C. ",
    "link the newly introduced entity or ambiguous entity in sentence S to context C. ",
    "add or change a discourse marker that ties sentence S with context C. ",
    "align the newly introduced information in sentence S with previously introduced information in context C so "
    "that the new information does not contradict the context. ",
    "add information to sentence S that is relevant to the context C established by the writer. ",
    "[DELETE]. ",
    "rewrite sentence S so that the comment of sentence S agrees with the topic of the sentence itself. ",
]
CHAT_SYSTEM = ("A chat between a curious user and an artificial intelligence assistant. The assistant gives "
                 "helpful, detailed, and polite answers to the user's questions.")
# name -> (system, roles, style, sep, sep2)
CONV_TEMPLATES = {
    "colon_two": (CHAT_SYSTEM, ("USER", "ASSISTANT"), "ADD_COLON_TWO", " ", "</s>"),
    "one_shot_style": (CHAT_SYSTEM, ("Human", "Assistant"), "ADD_COLON_SINGLE", "\n### ", None),
    "no_colon": ("", ("<|user|>", "<|assistant|>"), "NO_COLON_SINGLE", "<|end|>", None),
    "new_line": ("", ("user", "assistant"), "ADD_NEW_LINE_SINGLE", "\n", None),
    "colon_space": (CHAT_SYSTEM, ("USER", "ASSISTANT"), "ADD_COLON_SPACE_SINGLE", "\n", None),
    "no_colon_two": ("", ("<human>:", "<bot>:"), "NO_COLON_TWO", " ", "</s>"),
    "llama-2": ("", ("[INST]", "[/INST]"), "LLAMA2", " ", " </s><s>"),
    "chatml": ("<|im_start|>system\nYou are a helpful assistant.", ("<|im_start|>user", "<|im_start|>assistant"), "CHATML", "<|im_end|>", None),
    "robin": (CHAT_SYSTEM, ("###Human", "###Assistant"), "ROBIN", "\n", None),
    "phoenix": (CHAT_SYSTEM, ("Human", "Assistant"), "PHOENIX", "", None),
    "dolly": ("", ("### Instruction", "### Response"), "DOLLY", "\n\n", "### End"),
}
# style -> (head: how the system text opens the prompt; between role and message; after a role without a message;
#           how a message ends: its separator, the separators in turn, or a fixed text)
STYLES = {
    "ADD_COLON_SINGLE": ("sep", ": ", ":", "{sep}"),
    "ADD_COLON_TWO": ("sep", ": ", ":", "{turn}"),
    "ADD_COLON_SPACE_SINGLE": ("sep", ": ", ": ", "{sep}"),
    "NO_COLON_SINGLE": ("bare", "", "", "{sep}"),
    "NO_COLON_TWO": ("bare", "", "", "{turn}"),
    "ADD_NEW_LINE_SINGLE": ("sep if any", "\n", "\n", "{sep}"),
    "LLAMA2": ("inst", " ", "", "{turn}"),
    "CHATML": ("line if any", "\n", "\n", "{sep}\n"),
    "ROBIN": ("sep", ":\n", ":\n", "{sep}"),
    "PHOENIX": ("bare", ": <s>", ": <s>", "</s>"),
    "DOLLY": ("bare", ":\n", ":\n", "{turn}"),
}
# ---------------------------------------------------------------------------

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill_template(template: str, **cols: Column) -> Column:
    """substitute ``{name}`` placeholders by columns in one pass."""
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if template[pos:m.start()]:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(cols[m.group(1)].cast("string"), F.lit("None")))
        pos = m.end()
    if template[pos:]:
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def _whitespace_delimited(template: str) -> bool:
    """True when every placeholder is bounded by whitespace or the template ends."""
    for m in _PLACEHOLDER.finditer(template):
        before = template[m.start() - 1] if m.start() > 0 else " "
        after = template[m.end()] if m.end() < len(template) else " "
        if not (before.isspace() and after.isspace()):
            return False
    return True


def reason_instructions(reasons: list[Column]) -> Column:
    """concatenation of the fixed sentence of every reason equal to 1."""
    return F.concat(*[F.when(r == 1, F.lit(s)).otherwise(F.lit("")) for r, s in zip(reasons, REASON_SENTENCES)])


def sft_examples(pairs: DataFrame, template: str = DETECTION_TEMPLATE, target_col: str = "label",
                 token_len=None, masked_target_tokens: int = 2, chat: bool = False, **extra: str) -> DataFrame:
    """Prompt, completion 'Answer: x</s>' and the number of masked tokens.

    The loss mask covers the prompt and the first ``masked_target_tokens``
    target tokens; chat variants are not masked (mask_len 0), as in the reference.
    """
    tl = token_len or word_count
    cols = {"context": F.col("context"), "sentence": F.col("sentence")}
    cols.update({k: F.col(v) for k, v in extra.items()})
    prompt = fill_template(template, **cols)
    target = fill_template(TARGET_TEMPLATE, label=F.col(target_col))
    if chat:
        mask = F.lit(0)
    elif token_len is None and _whitespace_delimited(template):
        # placeholders sit between whitespace, so word counts add up: count the
        # fixed text once here and only the inserted values per row
        fixed = len(_PLACEHOLDER.sub(" ", template).split())
        mask = F.lit(fixed + masked_target_tokens)
        for m in _PLACEHOLDER.finditer(template):
            mask = mask + F.coalesce(tl(cols[m.group(1)].cast("string")), F.lit(0))
    else:
        mask = tl(prompt) + masked_target_tokens
    return pairs.select("*", prompt.alias("prompt"), target.alias("completion"), mask.alias("mask_len"))


def render_conversation(conv: Column, template: str = "colon_two", system: str | None = None) -> Column:
    """render array<struct<from, value>> with a separator style.

    Roles alternate by position (even = user role, odd = assistant role); an
    empty message renders the role tag only, as for the generation slot.
    """
    sys_msg, roles, style, sep, sep2 = CONV_TEMPLATES[template]
    sys_msg = sys_msg if system is None else system
    opening, between, bare, ending = STYLES[style]
    head = {"sep": sys_msg + sep, "bare": sys_msg, "sep if any": sys_msg and sys_msg + sep,
            "line if any": sys_msg and sys_msg + sep + "\n", "inst": sys_msg or "[INST] "}[opening]
    by_turn = lambda i, even, odd: F.when(i % 2 == 0, F.lit(even)).otherwise(F.lit(odd))
    extra = "\n\n" if style == "DOLLY" else ""
    ends = [ending.format(sep=sep, turn=x) for x in (sep, (sep if sep2 is None else sep2) + extra)]

    def message(m: Column, i: Column) -> Column:
        role = by_turn(i, *roles)
        full = F.concat(role, F.lit(between), m["value"], by_turn(i, *ends))
        if style == "LLAMA2":  # the head has opened the first instruction already
            full = F.when(i == 0, F.concat(m["value"], F.lit(" "))).otherwise(full)
        has = m["value"].isNotNull() & (F.length(m["value"]) > 0)
        return F.when(has, full).otherwise(F.concat(role, F.lit(bare)))

    return F.concat(F.lit(head), F.array_join(F.transform(conv, message), ""))


def prompt_separators(template: str) -> tuple[str, str]:
    """(separator after which a user turn begins, end of the instruction part of a turn)."""
    _, roles, style, sep, sep2 = CONV_TEMPLATES[template]
    answer = {"LLAMA2": " ", "CHATML": "\n"}.get(style, ": ")
    user = sep2 if sep2 is not None else roles[0] + ": " if style == "ADD_COLON_SPACE_SINGLE" else sep
    return user, roles[1] + answer


# Tokens of the default counter: an end mark, a word, or one other visible character.  Cutting a text at
# an end mark cuts no token, so that the lengths of turns add up.
PIECE_PATTERN = r"</s>|\w+|[^\w\s]"


def piece_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECE_PATTERN))


def chat_sft_masks(chats: DataFrame, template: str = "colon_two", token_len=piece_count, max_length: int = 2048) -> DataFrame:
    """Rendered text and the (start, length) token spans of the assistant replies to train on.

    A leading assistant message is dropped first.  The text is cut into turns at the
    user separator; of each turn the part up to the first assistant mark is masked.
    Where the turns' lengths don't add up to the text's and it is not cut off by
    ``max_length``, nothing is trained on (no spans, ``matched`` false).
    """
    conv = F.col("conversations")
    conv = F.when((F.size(conv) > 0) & (F.get(conv, F.lit(0))["from"] != "human"),
                  F.slice(conv, 2, F.greatest(F.size(conv) - 1, F.lit(1)))).otherwise(conv)
    user_sep, answer_sep = prompt_separators(template)
    d = chats.select("id", conv.alias("_c")).select("id", render_conversation(F.col("_c"), template).alias("text"))
    cut = F.split("text", re.escape(user_sep), -1)
    stop = F.array_position(cut, "")  # the first empty turn ends the walk
    kept = F.when(stop > 0, F.slice(cut, F.lit(1), (stop - 1).cast("int"))).otherwise(cut)
    turns = F.transform(kept, lambda t, i: F.when(i == 0, t).otherwise(F.concat(F.lit(user_sep), t)))
    heads = F.transform("_turns", lambda t: F.when(
        F.instr(t, answer_sep) > 0, F.concat(F.substring_index(t, answer_sep, 1), F.lit(answer_sep))).otherwise(t))
    d = d.withColumn("_turns", turns)
    d = d.withColumns({"_n": lengths(F.col("_turns"), token_len), "_m": lengths(heads, token_len)})
    sizes = F.zip_with("_n", "_m", lambda n, m: F.struct(n.cast("int").alias("n"), m.cast("int").alias("masked")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walk = F.aggregate(sizes, zero, lambda a, t: F.struct(
        (a["at"] + t["n"]).alias("at"),
        F.when(t["masked"] < t["n"], F.concat(a["spans"], F.array(F.struct(
            (a["at"] + t["masked"]).alias("start"), (t["n"] - t["masked"]).alias("length"))))).otherwise(a["spans"]).alias("spans")))
    d = d.select("id", "text", token_len(F.col("text")).cast("int").alias("n_tokens"), walk.alias("_w"))
    matched = (F.col("_w.at") >= max_length) | (F.col("_w.at") == F.col("n_tokens"))
    return d.select("id", "text", "n_tokens", matched.alias("matched"),
                    F.when(matched, F.col("_w.spans")).otherwise(F.slice("_w.spans", 1, 0)).alias("train_spans"))


def task_prompts(pairs: DataFrame, task: Column, reasons: Column | None = None) -> DataFrame:
    """The prompt of each pair's task (a key of TASK_TEMPLATES); ``reasons`` fills rewriting with reasons."""
    cols = {"context": F.col("context"), "sentence": F.col("sentence"), "reason_texts": reasons if reasons is not None else F.lit("")}
    prompt = F.lit(None).cast("string")
    for name, template in TASK_TEMPLATES.items():
        prompt = F.when(task == name, fill_template(template, **cols)).otherwise(prompt)
    return pairs.select("*", task.alias("task"), prompt.alias("prompt"))


def qa_examples(chats: DataFrame, max_tokens: int, eos: str = "</s>") -> DataFrame:
    """For every assistant turn, question = last ``max_tokens`` words of the prefix, answer = first
    ``max_tokens`` words of the reply, both with EOS (word tokens)."""
    conv = F.col("conversations")
    ex = chats.select("id", conv.alias("c"), F.posexplode(conv).alias("i", "m")).filter(F.col("m.from") == "gpt")
    prefix = F.array_join(F.transform(F.slice("c", 1, F.col("i")), lambda x: F.concat(x["from"], F.lit(": "), x["value"])),
                          "\n")
    pw = F.split(prefix, r"\s+")
    q = F.array_join(F.slice(pw, F.greatest(F.size(pw) - max_tokens + 1, F.lit(1)), max_tokens), " ")
    aw = F.split(F.col("m.value"), r"\s+")
    a = F.array_join(F.slice(aw, 1, max_tokens), " ")
    return ex.select("id", "i", F.concat(q, F.lit(eos)).alias("question"), F.concat(a, F.lit(eos)).alias("answer"))


def match_word_sft(rows: DataFrame, token_len=None, masked_target_tokens: int = 5) -> DataFrame:
    """X11: lexical-substitution examples from (target_word, tagged sentence, substitutes array).

    Substitutes are joined by ', '; the loss mask covers the prompt and the first
    five target tokens.
    """
    tl = token_len or word_count
    cols = {"target_word": F.col("target_word"), "sentence": F.col("sentence")}
    prompt = fill_template(WORD_TEMPLATE, **cols)
    target = fill_template(WORD_TARGET_TEMPLATE, substitutes=F.array_join("substitutes", ", "))
    if token_len is None and _whitespace_delimited(WORD_TEMPLATE):
        fixed = len(_PLACEHOLDER.sub(" ", WORD_TEMPLATE).split())
        mask = F.lit(fixed + masked_target_tokens) + tl(cols["target_word"]) + tl(cols["sentence"])
    else:
        mask = tl(prompt) + masked_target_tokens
    return rows.select("*", prompt.alias("prompt"), target.alias("completion"), mask.alias("mask_len"))
