"""Parsing of model replies into labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.functions.text import py_strip

# ---- fixed values ------------------------------------------------------------
SCORE_LABELS = ["1", "2", "3", "4", "5"]
BINARY_LABELS = {"yes": 1, "no": 0}
REASON_FIELDS = ["r1", "r2", "r3", "r4", "r5", "r6", "r7"]
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _field(lines: Column, k: int, full_text: bool = False) -> Column:
    """Value of line k: the second piece between ': ' marks, or all after the first mark; null without one."""
    line = F.try_element_at(lines, F.lit(k + 1))
    piece = F.try_element_at(F.split(line, ": ", 2 if full_text else -1), F.lit(2))
    return py_strip(piece)


def parse_annotation_reply(df: DataFrame, reply: str = "reply", rewrite_only: bool = False,
                           full_text: bool = False) -> DataFrame:
    """Label, R1..R7, rewrite from a line-per-field reply.

    Line k holds ``name: value``; the value is the second piece of
    ``split(': ')``, stripped.  Only label '0' carries reasons and a rewrite
    (lines 1..8).  ``rewrite_only`` parses R1..R7 and rewrite from lines 0..7.
    ``full_text`` keeps a value's own ': ' marks instead of ending there.
    A failed line keeps the fields parsed before it and leaves the rest ''.
    """
    lines = F.split(_c(reply), "\n", -1)
    if rewrite_only:
        names, offs = REASON_FIELDS + ["rewrite"], list(range(8))
        vals = [_field(lines, k, full_text) for k in offs]
        gate = F.lit(True)
        out = [F.lit(None).cast("string").alias("label")]
    else:
        label = _field(lines, 0, full_text)
        names, offs = REASON_FIELDS + ["rewrite"], list(range(1, 9))
        vals = [_field(lines, k, full_text) for k in offs]
        gate = label.isNotNull() & (label == "0")
        out = [F.coalesce(label, F.lit("")).alias("label")]
    ok = gate
    for n, v in zip(names, vals):
        ok = ok & v.isNotNull()
        out.append(F.when(ok, v).otherwise(F.lit("")).alias(n))
    return df.select("*", *out)


def parse_detection_reply_api(reply) -> Column:
    """P30 (API): int(first line) else -1."""
    first = py_strip(F.split(_c(reply), "\n", 2)[0])
    return F.coalesce(first.try_cast("int"), F.lit(-1))


def parse_detection_reply_local(reply) -> Column:
    """P30 (local model): int(text after the first 'Answer: ') else null."""
    piece = F.try_element_at(F.split(_c(reply), "Answer: ", -1), F.lit(2))
    return py_strip(piece).try_cast("int")


def normalise_label_text(label) -> Column:
    """Drop spaces and newlines, empty -> 'none', lower-case."""
    s = F.regexp_replace(_c(label), "[ \n]", "")
    return F.lower(F.when(F.length(s) == 0, F.lit("None")).otherwise(s))


def coerce_score_prediction(pred, gold) -> Column:
    """P38 (scores): 'co'/'coherence' -> 5; 'x', 'x.*', 'x/*' with x in 1..5 -> x; else 5 - gold."""
    p = _c(pred)
    labels = F.array(*[F.lit(x) for x in SCORE_LABELS])
    dot = F.split(p, r"\.", 2)[0]
    slash = F.split(p, "/", 2)[0]
    return (F.when(F.lower(p).isin("coherence", "co"), F.lit(5))
            .when(F.array_contains(labels, p), p.cast("int"))
            .when(F.array_contains(labels, dot), dot.cast("int"))
            .when(F.array_contains(labels, slash), slash.cast("int"))
            .otherwise(F.lit(5) - _c(gold)))


def coerce_binary_prediction(pred, gold_word) -> tuple[Column, Column]:
    """P38 (binary): gold yes/no -> 1/0; last space token yes/no/n -> 1/0/0, else 1 - gold."""
    g = F.when(F.lower(_c(gold_word)) == "yes", 1).when(F.lower(_c(gold_word)) == "no", 0)
    last = F.lower(F.element_at(F.split(_c(pred), " ", -1), -1))
    p = F.when(last == "yes", 1).when(last.isin("no", "n"), 0).otherwise(F.lit(1) - g)
    return g, p


def argmax(scores) -> Column:
    """0-based index of the largest score (first on ties)."""
    s = _c(scores)
    return F.array_position(s, F.array_max(s)) - 1


def sigmoid_labels(logits, threshold: float = 0.5) -> Column:
    """multi-label decision sigmoid(x) > threshold per element."""
    return F.transform(_c(logits), lambda x: (F.lit(1.0) / (F.lit(1.0) + F.exp(-x)) > threshold).cast("int"))


def best_allowed_label(scores, allowed_idx: list[int], labels: list[str]) -> Column:
    """the label with the highest score among the allowed class indexes."""
    sub = F.transform(F.array(*[F.lit(i) for i in allowed_idx]), lambda i: F.element_at(_c(scores), i + 1))
    pos = F.array_position(sub, F.array_max(sub))
    return F.element_at(F.array(*[F.lit(labels[i]) for i in allowed_idx]), pos.cast("int"))


def label_to_index(word, mapping: dict) -> Column:
    """Label word -> index via a literal map; ints pass through."""
    w = _c(word)
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(w.try_cast("int"), F.try_element_at(m, w))
