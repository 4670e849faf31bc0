"""Operator 6, chat formatting: budgeted, turn-aligned windows.

Native: DataFrame and SQL functions only.  The turns of a conversation get token
counts (words plus the markers) and their prefix sums choose turn-aligned windows: a
window holds the leading system turn, up to ``history`` tokens of whole turns
repeated from before, and new turns while the budget lasts (one new turn at least,
as turns are never cut).  Only new assistant turns are loss targets; repeated ones
are masked, so every target is trained on once.

Template: ``<s>role\\ntext </s>`` per turn.  Control strings inside texts and roles
are escaped by doubling the backslashes before them and adding one; a marker of the
template never follows a backslash, so reading back is exact.  Newlines and
backslashes in roles are written as ``\\n`` and ``\\\\``.

Edge cases: null role or text is an empty one; turns are ordered by (turn, role, text)
with nulls first, repeated rows are turns like any other; rows with a null conv_id are
one conversation; no rows give no conversations.  A conversation is one document: its
turns meet in one row because its digest is defined over the whole of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.llm.common import SPACE_WORD

CONTROL = r"(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*+)" + CONTROL, r"$1$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*)\1\\" + CONTROL, "$1$2")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # a pair of backslashes is one backslash, backslash-n is a newline
    marked = F.replace(unescape(role), F.lit("\\\\"), F.lit("\x00"))
    return F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))


def windows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = 1024, history: int = 256, marker_tokens: int = 4) -> DataFrame:
    """(conv_id, windows): an array of struct(text, n_repeated, loss array<struct<start, length>>).

    n_repeated counts the turns at the window's head that earlier windows hold already; loss
    spans are code points from 1 of the assistant texts (escaped) to train on.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    conv_rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # a turn as written, its share of the budget, and its loss span inside the written form
    written = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("<s>"), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("target"), (t["role"] == "system").alias("system"),
        (F.regexp_count(t["text"], F.lit(SPACE_WORD)) + marker_tokens).cast("long").alias("cost")))
    conv_rows = conv_rows.select("conv_id", written.alias("turns"))
    zero = F.array(F.lit(0).cast("long"))
    prefix = F.aggregate("turns", zero, lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t["cost"])))
    conv_rows = conv_rows.withColumn("prefix", prefix)
    # turns before the first one that is not a system turn lead every window
    lead = F.when(F.element_at("turns", 1)["system"], 1).otherwise(0).cast("long")
    conv_rows = conv_rows.withColumn("lead", lead)

    def used(first: Column, start: Column, end: Column) -> Column:
        """Cost of the lead, the history from ``first`` and the turns up to ``end``."""
        head = F.when(start > 0, F.get("prefix", F.col("lead").cast("int"))).otherwise(F.lit(0))
        return head + F.get("prefix", end.cast("int")) - F.get("prefix", first.cast("int"))

    def back(start: Column) -> Column:
        """First repeated turn of a window whose new turns begin at ``start``: as much history as the limit and the budget leave."""
        lowest = F.greatest(F.col("lead"), F.lit(0))
        fits = F.filter(F.sequence(F.least(lowest, start), start), lambda j: (j == start) | (
            (F.get("prefix", start.cast("int")) - F.get("prefix", j.cast("int")) <= history) & (used(j, start, start + 1) <= budget)))
        return F.element_at(fits, 1)

    def walk(acc, i):
        """Add turn i to the open window or, where the budget ends, open the next one."""
        last = F.element_at(acc, -1)
        fits = (last["start"] == i) | (used(last["first"], last["start"], i + 1) <= budget)
        fresh = F.transform(F.array(back(i)), lambda f: F.struct(f.alias("first"), i.alias("start"), (i + 1).alias("end")))
        longer = F.struct(last["first"].alias("first"), last["start"].alias("start"), (i + 1).alias("end"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, fresh))

    n = F.size("turns").cast("long")
    nought = F.lit(0).cast("long")
    seed = F.array(F.struct(nought.alias("first"), nought.alias("start"), nought.alias("end")))
    plan = F.aggregate(F.sequence(nought, n - 1), seed, walk)
    conv_rows = conv_rows.withColumn("plan", plan)

    def render(w):
        lead_turns = F.when(w["start"] > 0, F.col("lead")).otherwise(0)
        shown = F.concat(F.slice("turns", 1, lead_turns.cast("int")),
                         F.slice("turns", (w["first"] + 1).cast("int"), (w["end"] - w["first"]).cast("int")))
        repeated = lead_turns + w["start"] - w["first"]
        return F.struct(shown.alias("turns"), repeated.cast("long").alias("n_repeated"))

    def finish(w):
        full = F.transform(w["turns"], lambda t: F.concat(t["head"], t["body"], F.lit(" </s>")))
        sizes = F.transform(w["turns"], lambda t: F.struct(
            F.char_length(t["head"]).alias("head"), F.char_length(t["body"]).alias("body"), t["target"].alias("target")))
        empty = F.struct(F.lit(1).cast("long").alias("at"), F.lit(0).cast("long").alias("k"),
                         F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
        spans = F.aggregate(sizes, empty, lambda a, t: F.struct(
            (a["at"] + t["head"] + t["body"] + 5).alias("at"), (a["k"] + 1).alias("k"),
            F.when(t["target"] & (a["k"] >= w["n_repeated"]), F.concat(a["spans"], F.array(F.struct(
                (a["at"] + t["head"]).alias("start"), t["body"].cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans")),
            lambda a: a["spans"])
        return F.struct(F.array_join(full, "").alias("text"), w["n_repeated"].alias("n_repeated"), spans.alias("loss"))

    return conv_rows.select("conv_id", F.transform(F.transform("plan", render), finish).alias("windows"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted_chars), read from the windows' text and mask."""

    def new_turns(w):
        # turns are what stands between the markers that no backslash precedes
        parts = F.split(w["text"], r"(?<!\\)</s>")
        own = F.slice(parts, (w["n_repeated"] + 1).cast("int"), F.size(parts) - 1 - w["n_repeated"].cast("int"))
        return F.transform(own, lambda p: F.struct(
            _unescape_role(F.substring_index(F.substr(p, F.lit(4)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1, F.char_length(p) - F.instr(p, "\n") - 1)).alias("text")))

    def under_mask(w):
        return F.array_join(F.transform(w["loss"], lambda s: unescape(
            F.substr(w["text"], s["start"].cast("int"), s["length"].cast("int")))), "")

    return formatted.select(
        "conv_id", F.flatten(F.transform("windows", new_turns)).alias("turns"),
        F.array_join(F.transform("windows", under_mask), "").alias("loss_text"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w["text"])).alias("formatted_chars"),
        F.size("windows").cast("long").alias("n_windows"))


def digests(turns: DataFrame) -> DataFrame:
    """The contract's columns from read_back's."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_windows")
