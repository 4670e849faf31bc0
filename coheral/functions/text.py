"""String functions.

Python's ``str.strip()`` removes Unicode whitespace; Spark ``trim`` removes only
spaces, so ``py_strip`` is a regex.  Python regex ``.`` only excludes ``\\n`` while
Java's also excludes ``\\r``/``\\u2028``..., hence ``(?d)`` (UNIX_LINES) where a
pattern relies on ``.``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's behaviour ----------------
# Python's string.punctuation, removed before prompt dedup keys are built.
PUNCTUATION = string.punctuation
# Words whose (case-insensitive) presence blocks a conversation in cleaning.
BLOCKED_WORDS = ["openai", "chatgpt"]
# Sentence-complete end symbols.
SENTENCE_END_SYMBOLS = [".", "?", "!", "...", "。", "？", "！", "…", '"', "'", "”"]
# ---------------------------------------------------------------------------


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Python str.isspace(): Unicode White_Space plus the four ASCII separators 0x1c-0x1f.
_PY_WS = r"[\s\x1c-\x1f]"


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing (Unicode) whitespace."""
    return F.regexp_replace(col_(c), rf"(?U)^{_PY_WS}+|{_PY_WS}+$", "")


def split_sentences(text) -> Column:
    """split on every '.', strip, drop empties, re-append '.'."""
    parts = F.split(col_(text), r"\.", -1)
    stripped = F.transform(parts, lambda s: py_strip(s))
    kept = F.filter(stripped, lambda s: s != F.lit(""))
    return F.transform(kept, lambda s: F.concat(s, F.lit(".")))


def remove_html(c) -> Column:
    """names rendered as '<h3>Model A: name</h3>\\n' -> 'name'."""
    c = col_(c)
    start = F.instr(c, ": ") + 2
    return F.when(c.startswith("<h3>"),
                  c.substr(start, F.length(c) - F.lit(6) - start + 1)).otherwise(c)


def remove_punctuation(c) -> Column:
    """delete every ASCII punctuation character."""
    return F.translate(col_(c), PUNCTUATION, "")


def truncate_middle(c, max_len: int) -> Column:
    """keep head half and tail half when longer than ``max_len``."""
    c = col_(c)
    half = max_len // 2
    tail = F.substring(c, -half, half) if half > 0 else c
    return F.when(F.length(c) > max_len, F.concat(F.substring(c, 1, half), tail)).otherwise(c)


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and apply ``fn`` to the bound value.

    Catalyst inlines a column that is referenced several times (projection
    collapsing), so an expensive expression used in k places is computed k
    times; binding it to a lambda variable computes it once.
    """
    return F.element_at(F.transform(F.array(expr), fn), 1)


def contains_any(c, words, lower: bool = True) -> Column:
    """any of ``words`` occurs as a substring (case-insensitive by default)."""
    c = F.lower(col_(c)) if lower else col_(c)
    ws = [w.lower() if lower else w for w in words]

    def any_of(t):
        out = F.lit(False)
        for w in ws:
            out = out | t.contains(w)
        return out

    return let(c, any_of)


def is_sentence_complete(c) -> Column:
    """ends with one of the end symbols."""
    c = col_(c)
    out = F.lit(False)
    for s in SENTENCE_END_SYMBOLS:
        out = out | c.endswith(s)
    return out


def word_count(c) -> Column:
    """Whitespace-delimited token count (default tokenizer for X7/A15)."""
    return F.regexp_count(col_(c), F.lit(r"[^ \t\n\r]+")).cast("int")


def last_char(c) -> Column:
    return F.substring(col_(c), -1, 1)


def post_process_answer(c) -> Column:
    """bullets '•' -> '- ', and no blank line before numbered / dashed list items."""
    v = F.replace(col_(c), F.lit("•"), F.lit("- "))
    v = F.regexp_replace(v, r"\n\n(\d+\. )", "\n$1")
    return F.regexp_replace(v, r"\n\n(- )", "\n$1")


def is_partial_stop(output, stop: str) -> Column:
    """the stop string starts with a suffix of the output (i = 0 compares the whole output)."""
    o = col_(output)
    n = F.least(F.length(o), F.lit(len(stop)))
    suffix = lambda i: F.when(i == 0, o).otherwise(F.substring(o, -i, i))
    return F.exists(F.sequence(F.lit(0), n - 1), lambda i: F.startswith(F.lit(stop), suffix(i))) & (n > 0)


def trim_at_stop(output, stops: list[str], special_tokens: list[str] = ()) -> Column:
    """F8: cut at the earliest stop string found after position 0, drop special tokens, strip."""
    o = col_(output)
    pos = [F.when(F.instr(o, s) > 1, F.instr(o, s)) for s in stops]
    first = F.least(*pos) if len(pos) > 1 else (pos[0] if pos else F.lit(None))
    cut = F.when(first.isNotNull(), F.substring(o, F.lit(1), first - 1)).otherwise(o) if stops else o
    for t in special_tokens:
        cut = F.replace(cut, F.lit(t), F.lit(""))
    return py_strip(cut)


# ---- fixed values: model family names of the baseline reports --------------------
MODEL_FAMILIES = [("deberta", "deberta"), ("bert", "bert"), ("flan", "flan_t5"), ("t5", "t5"), ("gpt", "chatgpt"),
                  ("davinci", "gpt_davinci")]
MODEL_SIZES = [("base", "_base"), ("large", "_large")]
# Sampling temperature per bench category.
TEMPERATURE_CONFIG = {"writing": 0.7, "roleplay": 0.7, "extraction": 0.0, "math": 0.0, "coding": 0.0,
                      "reasoning": 0.0, "stem": 0.1, "humanities": 0.1, "arena-hard-200": 0.0}
# -----------------------------------------------------------------------------


def model_to_name(c) -> Column:
    """family (first matching substring, in order) plus size suffix."""
    m = col_(c)
    fam = F.lit(None).cast("string")
    for sub, name in reversed(MODEL_FAMILIES):
        fam = F.when(m.contains(sub), F.lit(name)).otherwise(fam)
    size = F.lit("")
    for sub, suf in reversed(MODEL_SIZES):
        size = F.when(m.contains(sub), F.lit(suf)).otherwise(size)
    return F.concat(fam, size)


def temperature(category, force=None, required=None, default: float = 0.7) -> Column:
    """forced temperature, else a required one, else the per-category value, else the default."""
    cfg = F.create_map(*[x for k, v in TEMPERATURE_CONFIG.items() for x in (F.lit(k), F.lit(float(v)))])
    parts = [p for p in (force, required) if p is not None]
    return F.coalesce(*[F.lit(float(p)) if not isinstance(p, Column) else p for p in parts],
                      F.try_element_at(cfg, col_(category)), F.lit(float(default)))


def parse_flag_map(text: Column) -> Column:
    """a map of flags written as text ("{'sent0': True, 'sent1': False}") -> map<string, boolean>; null if malformed."""
    json = F.replace(F.replace(F.replace(text, F.lit("'"), F.lit('"')), F.lit("True"), F.lit("true")), F.lit("False"), F.lit("false"))
    return F.from_json(json, "map<string,boolean>")


def parse_list(text: Column, element: str = "int") -> Column:
    """a list written as text ("[1, 2]" or "['a']") -> array; null if malformed."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), f"array<{element}>")
