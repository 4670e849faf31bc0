"""ShareGPT-style conversation cleaning and preparation.

Conversations are ``array<struct<from:string, value:string>>``; every check is
a higher-order function over that array (``transform``/``filter``/``exists``/
``aggregate``) so it runs inside whole-stage code generation, one row at a time,
with no Python and no shuffle -- except the deduplication (D1), which needs
grouping by id and by first exchange.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.functions.markdown import markdown, markdown_each
from coheral.functions.subword import lengths
from coheral.functions.text import BLOCKED_WORDS, contains_any, py_strip, word_count
from coheral.operators.greedy import greedy_keep

# ---- fixed values -----------------------------------------------------------
ROLES = ["human", "gpt"]
# Stop words used by the built-in language detector (lower-case), per language.
STOPWORDS = {
    "English": ["the", "and", "of", "to", "is", "in", "that", "it", "with", "as", "for", "was", "on", "are", "by",
                "this", "be", "from", "at", "or"],
    "French": ["le", "la", "les", "des", "du", "de", "et", "un", "une", "qui", "que", "en", "dans", "pour", "par",
               "sur", "est", "au", "aux", "avec"],
    "German": ["der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "sich", "des", "auf", "für", "nicht",
               "ein", "eine", "dem", "im", "auch", "bei"],
    "Spanish": ["el", "los", "del", "las", "por", "con", "para", "una", "es", "se", "lo", "como", "más", "pero",
                "sus", "le", "ya", "o", "este", "y"],
}
LANG_CODES = {"English": "en", "French": "fr", "German": "de", "Spanish": "es"}
WRONG_FORMAT_PATTERN = r"\n1\. [^2]*\n1\. "
MAX_MESSAGE_CHARS = 12000
MAX_ROUNDS = 50
HIST_EDGES = [0, 1024, 2048, 4096, 8192, 16384, 32768]
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ language
def _trie_regex(words) -> str:
    """Alternation factored by common prefixes, so the regex engine tests one
    branch per leading character instead of every word."""
    import re as _re
    tree: dict = {}
    for w in sorted(set(words)):
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node) -> str:
        alts = []
        end = "" in node
        for ch in sorted(k for k in node if k):
            alts.append(_re.escape(ch) + emit(node[ch]))
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 and not end else "(?:" + "|".join(alts) + ")"
        return body + ("?" if end else "")

    return emit(tree)


def detect_language(text) -> Column:
    """P15 detector: the language whose stop words occur most often among the words.

    Words are maximal runs of letters, lower-cased; a stop word counts where it
    occurs as a whole word.  One JVM regex scan (a prefix-factored alternation
    of all stop words) extracts the stop-word occurrences; a single
    ``aggregate`` over that short array counts them per language and picks the
    winner, so the text is scanned once (the expression is referenced once and
    cannot be duplicated by projection collapsing).  Ties go to the earlier
    language in ``STOPWORDS``; no stop word at all -> 'unknown'.
    """
    allw = [w for sw in STOPWORDS.values() for w in sw]
    pat = r"(?<!\p{L})(" + _trie_regex(allw) + r")(?!\p{L})"
    hits = F.regexp_extract_all(F.lower(_c(text)), F.lit(pat), 1)
    langs = list(STOPWORDS)
    arrs = [F.array(*[F.lit(x) for x in STOPWORDS[n]]) for n in langs]
    zero = F.struct(*[F.lit(0).alias(f"c{i}") for i in range(len(langs))])

    def merge(acc, w):
        return F.struct(*[(acc[f"c{i}"] + F.when(F.array_contains(arrs[i], w), 1).otherwise(0)).alias(f"c{i}")
                          for i in range(len(langs))])

    def finish(acc):
        cs = [acc[f"c{i}"] for i in range(len(langs))]
        best = F.greatest(*cs)
        out = F.when(best <= 0, F.lit("unknown"))
        for name, c in zip(langs, cs):
            out = out.when(c == best, F.lit(name))
        return out

    return F.coalesce(F.aggregate(hits, zero, merge, finish), F.lit("unknown"))


def conversation_text(conv) -> Column:
    return F.array_join(F.transform(_c(conv), lambda m: m["value"]), "\n")


def filter_language(chats: DataFrame, keep_lang: str = "all", skip_lang: str | None = None) -> DataFrame:
    """Detect on all values joined by newline; keep one language or skip one."""
    lang = detect_language(conversation_text("conversations"))
    d = chats.withColumn("lang", lang)
    if keep_lang != "all":
        d = d.filter(F.col("lang") == keep_lang)
    if skip_lang is not None:
        d = d.filter(F.col("lang") != skip_lang)
    return d


# ------------------------------------------------------------------- filters
def first_round(chats: DataFrame) -> DataFrame:
    """Keep the first two messages."""
    return chats.withColumn("conversations", F.slice("conversations", 1, 2))


def gpt4_only(chats: DataFrame) -> DataFrame:
    """model == 'gpt4' or model missing."""
    return chats.filter(F.col("model").isNull() | (F.col("model") == "gpt4"))


def filter_wrong_format(chats: DataFrame) -> DataFrame:
    """Drop conversations where a value has two numbered lists restarting at '1. '."""
    return chats.filter(~F.exists("conversations", lambda m: m["value"].rlike(WRONG_FORMAT_PATTERN)))


def filter_repeated_digits(chats: DataFrame) -> DataFrame:
    """Drop conversations where a value repeats one digit nine times."""
    return chats.filter(~F.exists("conversations", lambda m: m["value"].rlike(r"(\d)\1{8}")))


def valid_roles(conv) -> Column:
    """P16 predicate: non-empty and strictly human, gpt, human, ... from index 0."""
    c = _c(conv)
    return (F.size(c) > 0) & F.forall(F.transform(c, lambda m, i: m["from"] == F.when(i % 2 == 0, "human")
                                                  .otherwise("gpt")), lambda x: x)


def filter_invalid_roles(chats: DataFrame) -> DataFrame:
    return chats.filter(valid_roles("conversations"))


def enforce_limits(chats: DataFrame, max_chars: int = MAX_MESSAGE_CHARS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Cut each message to 12,000 characters; reject conversations with >= 50 rounds."""
    return (chats.filter(F.floor(F.size("conversations") / 2) < max_rounds)
            .withColumn("conversations", F.transform("conversations", lambda m: F.struct(
                m["from"].alias("from"), F.substring(m["value"], 1, max_chars).alias("value")))))


def _barred(token: str) -> str:
    """The token with a bar after its first and before its last character; a blank for one character."""
    ends = re.fullmatch(r"(.)(.*)(.)", token, re.DOTALL)
    return "|".join(filter(None, ends.groups())) if ends else " "


def escape_special_tokens(chats: DataFrame, tokens: list[str]) -> DataFrame:
    """Replace each special token (bos, eos, pad, unk order) by itself with '|' inserted."""
    def esc(v: Column) -> Column:
        for t in tokens:
            if t:
                v = F.replace(v, F.lit(t), F.lit(_barred(t)))
        return v
    return chats.withColumn("conversations", F.transform("conversations", lambda m: F.struct(
        m["from"].alias("from"), esc(m["value"]).alias("value"))))


def alpaca_to_chat(rows: DataFrame, ord_col: str = "ord") -> DataFrame:
    """P10: instruction (+ '\\nInput:\\n' + input when stripped input is longer than 1) -> 2-message chat."""
    prompt = F.when(F.length(py_strip("input")) > 1,
                    F.concat(F.col("instruction"), F.lit("\nInput:\n"), F.col("input"))).otherwise(F.col("instruction"))
    return rows.select(F.concat(F.lit("alpaca_"), F.col(ord_col).cast("string")).alias("id"),
                       F.array(F.struct(F.lit("human").alias("from"), prompt.alias("value")),
                               F.struct(F.lit("gpt").alias("from"), F.col("output").alias("value"))).alias("conversations"))


# ------------------------------------------------------------- html cleaning
# ---- fixed values: noise patterns of exported chats ---------------------------
_CODE_LANG = r"(?s)```\s*(.*?)(?:Copy code)+(.+?)\s*?```"
_REGENERATE_AT_START = r"^\d+ / \d+"
_COPY_CHARS = r"Copy\d+ chars / \d+ words"
_COPY_CODE = r"(?d)```(.*?)Copy code\s*```"
# -------------------------------------------------------------------------------


def _without_wrappers(html: Column) -> Column:
    """``<div ...>`` and ``<span ...>`` start tags removed, which would break code blocks."""
    return F.regexp_replace(F.regexp_replace(html, r"(?d)<div.*?>", ""), r"(?d)<span.*?>", "")


def _without_noise(v: Column) -> Column:
    """The clean-up after conversion: code blocks reformatted, counters and copy buttons removed."""
    v = F.regexp_replace(py_strip(v), _CODE_LANG, "```$1\n$2\n```")
    v = F.regexp_replace(v, _REGENERATE_AT_START, "")
    v = F.regexp_replace(v, _COPY_CHARS, "")
    v = F.regexp_replace(v, _COPY_CODE, "")
    return py_strip(F.replace(v, F.lit("\n\n\n"), F.lit("\n")))


def html_to_markdown(val) -> Column:
    """HTML -> Markdown (``functions.markdown``) between the reference's clean-up steps."""
    return _without_noise(markdown(_without_wrappers(_c(val))))


def _printable_start(v: Column) -> Column:
    """Python ``v[0].isprintable()``: not a control/format/separator char (ASCII space allowed)."""
    return ~F.substring(v, 1, 1).rlike(r"^[\p{C}\p{Z}&&[^ ]]")


def clean_html_conversation(chats: DataFrame, convert=None) -> DataFrame:
    """Ordered checks giving ``error_code`` (0 keep, 1 too short, 2 wrong format, 3 blocked word).

    Adds ``error_code`` and replaces ``conversations`` with the cleaned messages.
    (Code 4, a parser error, cannot occur: the converter is total.)  ``convert`` may
    replace P18 by another expression of a message's text.
    """
    c1 = F.col("conversations")
    c2 = F.when(F.size(c1) > 0, F.when(c1[0]["from"] != "human", F.slice(c1, 2, F.greatest(F.size(c1) - 1, F.lit(1))))
                .otherwise(c1)).otherwise(c1)
    d = chats.withColumn("_c2", c2)
    c2 = F.col("_c2")
    c3 = F.when(F.size(c2) > 0, F.when(F.try_element_at(c2, F.lit(-1))["from"] == "human",
                                       F.slice(c2, 1, F.greatest(F.size(c2) - 1, F.lit(1)))).otherwise(c2)).otherwise(c2)
    d = d.withColumn("_c3", c3)
    if convert is not None:
        md = F.transform("_c3", lambda m: F.struct(m["from"].alias("from"), convert(m["value"]).alias("value")))
    else:
        d = d.withColumn("_text", markdown_each(F.transform("_c3", lambda m: _without_wrappers(m["value"]))))
        md = F.transform("_c3", lambda m, i: F.struct(m["from"].alias("from"), _without_noise(F.get("_text", i)).alias("value")))
    d = d.withColumn("_md", md).drop("_text")
    bad = F.transform("_md", lambda m: (F.length(m["value"]) == 0) | ~_printable_start(m["value"]))
    pos = F.array_position(bad, True)
    d = d.withColumn("_cut", F.when(pos > 0, pos - 1).otherwise(F.size("_md")).cast("int"))
    flags = F.transform("_c3", lambda m, i: F.when(i <= F.col("_cut"), F.when(
        m["from"] != F.when(i % 2 == 0, "human").otherwise("gpt"), F.lit(2))
        .when(contains_any(m["value"], BLOCKED_WORDS), F.lit(3))))
    first_err = F.try_element_at(F.filter(flags, lambda x: x.isNotNull()), F.lit(1))
    kept = F.slice("_md", 1, F.col("_cut"))
    chars = F.aggregate(kept, F.lit(0).cast("long"), lambda acc, m: acc + F.length(m["value"]))
    even = F.slice("_md", 1, (F.floor(F.col("_cut") / 2) * 2).cast("int"))
    code = (F.when(F.size(c1) <= 1, 1).when(F.size("_c2") <= 1, 1).when(F.size("_c3") <= 1, 1)
            .when(first_err.isNotNull(), first_err)
            .when((chars < 16) | (F.size(even) <= 0), 1).otherwise(0))
    return (d.withColumn("error_code", code.cast("int"))
            .withColumn("conversations", F.when(F.col("error_code") == 0, even).otherwise(F.col("conversations")))
            .drop("_c2", "_c3", "_md", "_cut"))


# ---------------------------------------------------------------------- dedup
def _dedup_keys(chats: DataFrame, order: str) -> DataFrame:
    """Narrow rows (o, a, b, plugin): hashes of the id and of the first exchange; a null one is like no other."""
    conv = F.col("conversations")
    v0, v1 = F.get(conv, 0)["value"], F.get(conv, 1)["value"]
    own = F.concat(F.lit("row "), F.col(order).cast("string"))
    return chats.select(F.col(order).alias("o"), F.sha2(F.coalesce(F.concat(F.lit("id "), F.col("id").cast("string")), own), 256).alias("a"),
                        F.sha2(F.coalesce(F.concat(F.length(v0).cast("string"), F.lit(":"), v0, v1), own), 256).alias("b"),
                        F.col("plugins").isNotNull().alias("plugin"))


def dedup_conversations(chats: DataFrame, order: str = "ord") -> DataFrame:
    """Greedy, order-dependent dedup: the kept rows.

    A row is kept iff no earlier *kept* row has the same id or the same
    (first, second) message values; rows with plugins are never kept
    (``operators.greedy`` says how it is settled without walking the rows in order).
    Input rows must have error_code 0 (P17) if cleaning ran; ``order`` is unique.  Rows without an id, or
    without a first exchange, have no duplicates by it.
    """
    kept, _ = greedy_keep(_dedup_keys(chats, order).filter(~F.col("plugin")))
    return chats.join(kept.withColumnRenamed("o", order), order, "left_semi")


def dedup_reasons(chats: DataFrame, order: str = "ord") -> DataFrame:
    """(order, reason) of every row: 'kept', or why it went.

    Checked in this order: the error code of P17 (if there is a column ``error_code``: 'too_short',
    'wrong_format', 'blocked_words', 'parser_error'), 'id_duplication', 'plugin', 'value_duplication'.
    """
    code = F.col("error_code") if "error_code" in chats.columns else F.lit(0)
    error = F.when(code != 0, F.element_at(F.array(*[F.lit(x) for x in ("too_short", "wrong_format", "blocked_words", "parser_error")]), code))
    checked = chats.withColumn("_error", error)
    rows = _dedup_keys(checked.filter("_error IS NULL"), order)
    kept, _ = greedy_keep(rows.filter(~F.col("plugin")))
    chosen = rows.join(kept, "o", "left_semi")
    # every id and every first exchange has one kept row at most
    of = lambda c: chosen.select(c, F.col("o").alias(f"kept_{c}"))
    found = rows.join(of("a"), "a", "left").join(of("b"), "b", "left")
    reason = (F.when((F.col("kept_a") == F.col("o")) & ~F.col("plugin"), "kept").when(F.col("kept_a") < F.col("o"), "id_duplication")
              .when(F.col("plugin"), "plugin").otherwise("value_duplication"))
    return (found.select(F.col("o").alias(order), reason.alias("reason"))
            .unionByName(checked.filter("_error IS NOT NULL").select(order, F.col("_error").alias("reason"))))


# --------------------------------------------------------------- splitting
def split_long_conversation(chats: DataFrame, max_length: int, token_len=None, keep_tail: bool = False) -> DataFrame:
    """Greedy packing of (human, gpt) rounds into chunks of at most ``max_length`` tokens.

    Per round length = tokens(human) + tokens(gpt) + 12 (6 per message).  If the
    running length plus the round exceeds ``max_length`` the chunk [start, i)
    is emitted (possibly empty) and a new one starts at i; otherwise the last
    round closes [start, i + 2).  As in the reference an overflowing final round
    is dropped, unless ``keep_tail`` makes it a chunk of its own.  A row-local ``aggregate`` fold -- no shuffle.  New id is
    ``<id>_<start>``.
    """
    tl = token_len or word_count
    conv = F.slice("conversations", 1, (F.floor(F.size("conversations") / 2) * 2).cast("int"))
    d = chats.withColumn("_conv", conv)
    counts = lengths(F.transform("_conv", lambda m: m["value"]), tl)
    d = d.withColumn("_len", F.transform(counts, lambda n: (n + 6).cast("long"))).withColumn("_n", F.size("_conv"))
    rounds = F.sequence(F.lit(0), F.greatest(F.col("_n") / 2 - 1, F.lit(-1)).cast("int"))
    rounds = F.when(F.col("_n") >= 2, rounds).otherwise(F.array().cast("array<int>"))
    init = F.struct(F.lit(0).alias("start"), F.lit(0).cast("long").alias("cur"),
                    F.array().cast("array<struct<s:int,e:int>>").alias("chunks"))

    def step(acc, r):
        i = r * 2
        tmp = F.element_at(F.col("_len"), i + 1) + F.element_at(F.col("_len"), i + 2)
        over = acc["cur"] + tmp > max_length
        last = i == F.col("_n") - 2
        chunk_over = F.array(F.struct(acc["start"].alias("s"), i.alias("e")))
        chunk_last = F.array(F.struct(acc["start"].alias("s"), (i + 2).alias("e")))
        return F.struct(
            F.when(over, i).otherwise(acc["start"]).alias("start"),
            F.when(over, tmp).otherwise(acc["cur"] + tmp).alias("cur"),
            F.when(over & last & F.lit(keep_tail), F.concat(acc["chunks"], chunk_over, F.array(F.struct(i.alias("s"), (i + 2).alias("e")))))
             .when(over, F.concat(acc["chunks"], chunk_over))
             .when(last, F.concat(acc["chunks"], chunk_last)).otherwise(acc["chunks"]).alias("chunks"))

    folded = F.aggregate(rounds, init, step)["chunks"]
    out = d.select("*", F.explode(folded).alias("_ch"))
    return out.select(F.concat(F.col("id"), F.lit("_"), F.col("_ch.s").cast("string")).alias("id"),
                      F.coalesce(F.col("model"), F.lit("")).alias("model"),
                      F.slice("_conv", F.col("_ch.s") + 1, F.col("_ch.e") - F.col("_ch.s")).alias("conversations"),
                      F.col("_ch.s").alias("start"))


# ------------------------------------------------------------------ stats
def corpus_stats(chats: DataFrame, token_len=None) -> tuple[DataFrame, DataFrame]:
    """(summary row, histogram) over conversations.

    Per conversation: turns = len // 2, length = sum over turns of prompt +
    response tokens.  Summary: n, total tokens, mean turns, mean prompt and
    response length (per turn).  Histogram: edges 0, 1024, ..., 32768, last bin
    closed, values outside dropped.
    """
    tl = token_len or word_count
    conv = F.col("conversations")
    turns = F.floor(F.size(conv) / 2).cast("int")
    counted = chats.select("conversations", lengths(F.transform(conv, lambda m: m["value"]), tl).alias("_n"))
    pairs = F.transform(F.sequence(F.lit(0), turns - 1), lambda i: F.struct(
        F.get("_n", i * 2).alias("p"), F.get("_n", i * 2 + 1).alias("r")))
    pairs = F.when(turns > 0, pairs)
    d = counted.select(turns.alias("turns"), F.coalesce(pairs, F.array().cast("array<struct<p:int,r:int>>")).alias("pr"))
    d = d.select("turns", "pr", F.aggregate("pr", F.lit(0).cast("long"), lambda a, x: a + x["p"] + x["r"]).alias("len"))
    # the means over turns from sums of each conversation: the texts are tokenized once
    for c in ("p", "r"):
        known = F.filter("pr", lambda x: x[c].isNotNull())
        d = d.withColumns({f"_n_{c}": F.size(known),
                           f"_{c}": F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + x[c])})
    mean = lambda c: F.when(F.sum(f"_n_{c}") > 0, F.sum(f"_{c}") / F.sum(f"_n_{c}"))
    summary = d.agg(F.count(F.lit(1)).alias("n_conversations"), F.sum("len").alias("n_tokens"),
                    F.avg("turns").alias("avg_turns"), mean("p").alias("avg_prompt_len"), mean("r").alias("avg_response_len"))
    e = HIST_EDGES
    b = F.lit(None).cast("int")
    for k in range(len(e) - 1):
        cond = (F.col("len") >= e[k]) & ((F.col("len") < e[k + 1]) if k < len(e) - 2 else (F.col("len") <= e[k + 1]))
        b = F.when(cond, F.lit(k)).otherwise(b)
    hist = (d.select(b.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    hist = hist.select(F.element_at(F.array(*[F.lit(x) for x in e]), F.col("bin") + 1).alias("lo"),
                       F.element_at(F.array(*[F.lit(x) for x in e]), F.col("bin") + 2).alias("hi"), "n")
    return summary, hist


def merge_files(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name (missing columns null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def sample_short(chats: DataFrame, begin: int, end: int, max_length: int, seed: int | None = 42,
                 key: str = "id", order: str = "ord") -> DataFrame:
    """(seeded shuffle unless seed is None) -> rows [begin, end) -> total chars <= max_length."""
    from coheral.functions.hashing import hash_key
    from coheral.operators.ordering import slice_rows
    d = chats.withColumn("_h", hash_key(F.col(key), seed) if seed is not None else F.col(order).cast("string"))
    if seed is None:
        d = d.withColumn("_h", F.col(order))
    s = slice_rows(d, "_h", begin, end).drop("_h")
    return s.filter(F.length(conversation_text("conversations").cast("string")) - (F.size("conversations") - 1) <= max_length)
