"""Operator 4, personal data: weak-supervision aggregation.

Native: DataFrame and SQL functions only.  Base spans come from fixed patterns.
Further candidates (national numbers, account handles, long secrets, local phone
numbers) come from looser patterns.  Labelers vote on every candidate: its shape
(regex), the word before it (gazetteer) and its surroundings (context); a labeler may
abstain.  Expectation-maximisation over the counted vote patterns estimates each
labeler's reliability without labels; the posteriors then train a naive-Bayes span
classifier on features of the span, which decides the further candidates (base spans
always stay).

What reaches the driver is bounded by the patterns of votes and feature values, not
by the rows: ``len(KINDS) * 3**4 * 4 * 4 * 3`` rows at most.

Edge cases: null text is an empty text; a text without candidates has no spans;
overlapping further candidates yield to base spans, then to the earlier, longer one; with
no candidates at all the classifier accepts none.  Positions are code points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coheral.llm.common import cut

# Base kinds in order, then the kinds only the method adds.
KINDS = ("email", "ip", "card", "phone", "ssn", "handle", "secret", "local_phone")
N_BASE = 4

# The contract's patterns.  Possessive quantifiers and the look-behinds change no match;
# they keep the search linear on long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "handle": r"(?<![A-Za-z0-9._%+@/-])@[A-Za-z][A-Za-z0-9_]{2,30}(?![A-Za-z0-9_.@-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_+/=@.-])",
    "local_phone": r"(?<![0-9+().-])(?<![0-9+] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}

# Gazetteer: words that announce personal data, and words that announce other figures.
ANNOUNCES = ("email mail e-mail contact phone tel telephone call fax mobile cell card visa mastercard ssn social "
             "token key secret password passwd pwd apikey api_key auth user username handle address ip host id account").split()
DENIES = "version page isbn order total price sum chapter section figure table build release commit".split()


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind, start, value, before>>: leftmost non-overlapping matches, code points from 0."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(
        "array<struct<kind:int,start:int,value:string,before:string,after:string>>").alias("spans"))
    each = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    # what follows a match matters up to one character; it is the head of the next gap
    each = F.zip_with(each, F.slice(gaps, 2, F.size(found)), lambda e, nxt: F.struct(
        e["gap"].alias("gap"), e["value"].alias("value"), F.substring(nxt, 1, 1).alias("after")))
    walk = F.aggregate(each, empty, lambda a, e: F.struct(
        (a["at"] + F.char_length(e["gap"]) + F.char_length(e["value"])).alias("at"),
        F.concat(a["spans"], F.array(F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), (a["at"] + F.char_length(e["gap"])).alias("start"), e["value"].alias("value"),
            F.right(e["gap"], F.lit(24)).alias("before"), e["after"].alias("after")))).alias("spans")), lambda a: a["spans"])
    return F.when(text.rlike(PATTERNS[kind]), walk).otherwise(empty["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn check of a string of 13 to 19 digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    value = m["value"]
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.char_length(p) <= 3) & (p.try_cast("int") <= 255))
    if kind == "card":
        d = _digits(value)
        return F.when(F.char_length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def _end(m: Column) -> Column:
    return m["start"] + F.char_length(m["value"])


def with_candidates(df: DataFrame, text: str) -> DataFrame:
    """``df`` plus __base and __more: arrays of struct(kind, start, value, before, after)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("__base", _concat_valid(t, KINDS[:N_BASE])).withColumn("__loose", _concat_valid(t, KINDS[N_BASE:]))
    # further candidates must not touch a base span or an earlier, longer candidate
    ordered = F.array_sort("__loose", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(_end(b) - _end(a)))
    none = F.slice("__loose", 1, 0)
    kept = F.aggregate(ordered, none, lambda acc, m: F.when(
        F.exists(F.concat(acc, F.col("__base")), lambda o: (o["start"] < _end(m)) & (m["start"] < _end(o))), acc)
        .otherwise(F.concat(acc, F.array(m))))
    return out.withColumn("__more", F.when(F.size("__loose") > 0, kept).otherwise(none)).drop("__loose")


def _concat_valid(text: Column, kinds: tuple[str, ...]) -> Column:
    return F.concat(*[F.filter(_matches(text, kind), _checker(kind)) for kind in kinds])


def _checker(kind: str):
    return lambda m: _valid(kind, m)


def _last_word(before: Column) -> Column:
    return F.lower(F.regexp_extract(before, r"([A-Za-z_-]+)[^A-Za-z]*$", 1))


def votes(m: Column) -> Column:
    """struct of four votes (1 personal, 0 not, -1 abstain) on a candidate."""
    digits = F.char_length(_digits(m["value"]))
    size = F.char_length(m["value"])
    repeated = m["value"].rlike(r"([0-9])\1{5}|^[^0-9]*0+[^1-9]*$|example\.(?:com|org|net)$|^(?:10|127|192\.168)\.")
    word = _last_word(m["before"])
    shape = F.when(repeated, 0).when(m["kind"] == KINDS.index("secret"), F.when((digits >= 4) & (size >= 24), 1).otherwise(0)).otherwise(1)
    gazetteer = F.when(word.isin(ANNOUNCES), 1).when(word.isin(DENIES), 0).otherwise(-1)
    context = F.when(m["before"].rlike(r"[:=]\s*[\"']?$"), 1).when(m["before"].rlike(r"[0-9/#]\s?$"), 0).otherwise(-1)
    edges = (F.when(F.coalesce(m["after"], F.lit("")).rlike(r"^$|[\s.,;:!?)\"'\]]"), 1).otherwise(0))
    return F.struct(shape.alias("shape"), gazetteer.alias("gazetteer"), context.alias("context"), edges.alias("edges"))


LABELERS = ("shape", "gazetteer", "context", "edges")


def features(m: Column) -> Column:
    """Span features of the final classifier, as text values."""
    digits, size = F.char_length(_digits(m["value"])), F.char_length(m["value"])
    word = _last_word(m["before"])
    return F.struct(
        F.when(size < 10, "short").when(size < 20, "middle").when(size < 40, "long").otherwise("longest").alias("size"),
        F.when(digits == 0, "none").when(digits * 2 < size, "few").when(digits < size, "most").otherwise("all").alias("digits"),
        F.when(word.isin(ANNOUNCES), "announced").when(word.isin(DENIES), "denied").otherwise("plain").alias("word"),
        F.when(m["before"].rlike(r"[:=]\s*[\"']?$"), "assigned").when(m["before"].rlike(r"[\"'(<\[]$"), "quoted").otherwise("free").alias("left"))


FEATURES = ("size", "digits", "word", "left")


@dataclass
class SpanClassifier:
    """Naive-Bayes log odds: per kind, and per (feature, value)."""

    prior: dict[int, float] = field(default_factory=dict)
    weight: dict[tuple[str, str], float] = field(default_factory=dict)

    def log_odds(self, m: Column) -> Column:
        f = features(m)
        out = F.lit(-math.inf)
        for k, w in sorted(self.prior.items()):
            out = F.when(m["kind"] == k, F.lit(w)).otherwise(out)
        for name in FEATURES:
            part = F.lit(0.0)
            for (g, value), w in sorted(self.weight.items()):
                if g == name:
                    part = F.when(f[name] == value, F.lit(w)).otherwise(part)
            out = out + part
        return out


def count_patterns(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, four votes, four features, n) over all candidates of all texts."""
    each = (with_candidates(df.select(F.col(text).alias("text")), "text")
            .select(F.explode(F.concat("__base", "__more")).alias("m")))
    return (each.select(F.col("m.kind").alias("kind"), votes(F.col("m")).alias("v"), features(F.col("m")).alias("f"))
            .select("kind", "v.*", "f.*").groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n")))


def estimate(patterns: DataFrame, rounds: int = 30, prior: float = 0.7) -> DataFrame:
    """Expectation-maximisation over vote patterns: (kind, votes..., p) with p the posterior of 'personal'.

    One fold over ``rounds`` steps in SQL; its input is the table of vote patterns.
    """
    counts = patterns.groupBy("kind", *LABELERS).agg(F.sum("n").cast("double").alias("n"))
    one = counts.agg(F.collect_list(F.struct("kind", F.array(*[F.col(x) for x in LABELERS]).alias("v"), "n")).alias("rows"))
    n = len(LABELERS)
    start = F.struct(F.array(*[F.lit(prior)] * len(KINDS)).alias("pi"), F.array(*[F.lit(0.8)] * n).alias("a"),
                     F.array(*[F.lit(0.3)] * n).alias("b"))

    def log_odds(par: Column, r: Column) -> Column:
        base = F.log(F.get(par["pi"], r["kind"]) / (1 - F.get(par["pi"], r["kind"])))
        for k in range(n):
            a, b, v = F.get(par["a"], F.lit(k)), F.get(par["b"], F.lit(k)), F.get(r["v"], F.lit(k))
            base = base + F.when(v == 1, F.log(a / b)).when(v == 0, F.log((1 - a) / (1 - b))).otherwise(0.0)
        return base

    def posterior(par: Column, r: Column) -> Column:
        return 1 / (1 + F.exp(-log_odds(par, r)))

    def total(rows: Column, of) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, r: s + of(r))

    def rate(rows: Column, k: int, weight) -> Column:
        """Smoothed share of votes 1 among the votes of labeler k."""
        yes = total(rows, lambda r: F.when(F.get(r["v"], F.lit(k)) == 1, weight(r)).otherwise(0.0))
        all_ = total(rows, lambda r: F.when(F.get(r["v"], F.lit(k)) >= 0, weight(r)).otherwise(0.0))
        return (yes + 1) / (all_ + 2)

    def step(par: Column, _: Column) -> Column:
        soft = F.transform(F.col("rows"), lambda r: F.struct(r["kind"].alias("kind"), r["v"].alias("v"), r["n"].alias("n"),
                                                      (r["n"] * posterior(par, r)).alias("yes")))
        new = F.transform(F.array(soft), lambda rows: F.struct(
            F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k:
                        (total(rows, lambda r: F.when(r["kind"] == k, r["yes"]).otherwise(0.0)) + prior)
                        / (total(rows, lambda r: F.when(r["kind"] == k, r["n"]).otherwise(0.0)) + 1)).alias("pi"),
            F.array(*[rate(rows, k, lambda r: r["yes"]) for k in range(n)]).alias("a"),
            F.array(*[rate(rows, k, lambda r: r["n"] - r["yes"]) for k in range(n)]).alias("b")))
        return F.element_at(new, 1)

    fitted = one.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("par"))
    return (fitted.select(F.explode(F.transform("rows", lambda r: F.struct(
        r["kind"].alias("kind"), r["v"].alias("v"), posterior(F.col("par"), r).alias("p")))).alias("r"))
        .select("r.kind", *[F.get("r.v", F.lit(k)).alias(x) for k, x in enumerate(LABELERS)], "r.p"))


def fit(df: DataFrame, text: str = "text") -> SpanClassifier:
    """Count votes over all texts, estimate reliabilities, train the span classifier on the posteriors."""
    patterns = cut(count_patterns(df, text))
    soft = cut(patterns.join(estimate(patterns), ["kind", *LABELERS]))  # as small as the patterns; later plans stay short
    yes, no = F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")
    sets = [["kind"], *[[f] for f in FEATURES]]
    rows = [(names[0], r) for names in sets for r in soft.groupBy(*names).agg(yes, no).collect()]
    model = SpanClassifier()
    all_yes = sum(r["yes"] for g, r in rows if g == "kind")
    all_no = sum(r["no"] for g, r in rows if g == "kind")
    for g, r in rows:
        odds = math.log((r["yes"] + 1) / (r["no"] + 1))
        if g == "kind":
            model.prior[r["kind"]] = odds
        else:
            model.weight[g, r[g]] = odds - math.log((all_yes + 1) / (all_no + 1))
    return model


def find(df: DataFrame, model: SpanClassifier, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` plus base_spans and spans: arrays of struct(kind name, start, end), by kind then start."""
    out = with_candidates(df, text)
    cut_off = math.log(threshold / (1 - threshold))
    more = F.filter("__more", lambda m: model.log_odds(m) >= cut_off)
    names = F.array(*[F.lit(k) for k in KINDS])

    def named(spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(F.get(names, m["kind"]).alias("kind"), m["start"].alias("start"), _end(m).alias("end")))
    return (out.withColumn("base_spans", named(F.col("__base"))).withColumn("spans", F.concat("base_spans", named(more)))
            .drop("__base", "__more"))


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace every span of ``text`` by its kind in brackets; overlapping spans become one, named by the first."""
    by_place = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    t = F.col(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walked = F.aggregate(by_place, zero, lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        s["end"].alias("at"), F.concat(a["out"], F.substr(t, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))
        .otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substr(t, a["at"] + 1, F.greatest(F.char_length(t) - a["at"], F.lit(0)))))
    return df.withColumn(text, F.when(t.isNull() | (F.size(spans) == 0), t).otherwise(walked))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
