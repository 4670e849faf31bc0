"""Operator 5, benchmark decontamination: template canonicalisation.

Native: DataFrame and SQL functions only.  Texts become template tokens: numbers turn
into ``<num>``, a unit after a number into ``<unit>``, a capitalised word inside a
sentence into ``<name>``, other words are lower-cased.  Windows of ``width`` template
tokens of documents and benchmark items are hash-joined, so questions whose
parameters were changed still meet.  For the pairs that share enough windows the
matched places are aligned (document place minus item place) and the slots compared:
within one alignment every value of the item must stand for one value of the document
throughout.  Windows of inconsistent alignments don't count.

A pair is contaminated when the remaining windows make up ``min_cover`` of the item's.
Items of ``min_tokens`` to ``width - 1`` template tokens are one window of their own
length.  An item's first window is there in two forms, its first word a name or not, for
what stands before it in a document decides that.  Items of up to ``width`` tokens, at any
length, are also found word by word (lower-cased words, compared in full).

Windows that an item holds more than once: each place of a document meets one place of
the item at most to propose an alignment (the first one; equal values; for a run of equal
windows begin with begin and end with end), and the proposed alignments are then looked up
for all of the item's windows.  So no place pairs are listed, and a text of one repeated
word stays linear.  Where such a window is nothing but slots (rows of numbers), it
must have the item's own values, for any other row of numbers has its template.

Edge cases: null texts have no windows; documents are told apart by doc_id and text, so
rows with one id, or none, are judged one by one, and exact copies under one id give one
row per item; repeated items are items of their own; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from coheral.llm.common import cut

# Units of measurement and money.
UNITS = ("mm cm m km inch inches feet foot miles mile mg g kg tons ml l litre litres liter liters "
         "seconds second minutes minute hours hour days day weeks week months month years year "
         "percent dollars dollar euros euro cents degrees mph kmh usd eur").split()

_NAME = "\ue000"  # private-use mark put before names
_TOKEN = _NAME + r"?(?:[0-9]++(?:[.,:/][0-9]++)*+|[\p{L}\p{M}\p{N}]++)"


def tokens(text: Column) -> Column:
    """Words and numbers of a text in order; names carry the private mark."""
    marked = F.regexp_replace(text, r"(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}++)(?![\p{L}\p{N}])", _NAME + "$1")
    return F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))


def templates(words: Column) -> Column:
    """Template token of each word; a unit is one only after a number (tokens that begin with 0-9 are numbers)."""
    units = F.array(*[F.lit(u) for u in UNITS])

    def one(w: Column, i: Column) -> Column:
        before = F.get(words, i - 1)
        return (F.when((w >= "0") & (w < ":"), "<num>").when(w >= _NAME, F.when(w.startswith(_NAME), "<name>").otherwise(F.lower(w)))
                .when((before >= "0") & (before < ":"), F.when(F.array_contains(units, F.lower(w)), "<unit>").otherwise(F.lower(w)))
                .otherwise(F.lower(w)))
    return F.transform(words, one)


def token_codes(template: Column) -> Column:
    return F.transform(template, lambda t: F.xxhash64(t))


def window_hashes(codes: Column, width: int | Column) -> Column:
    """Hash of every run of ``width`` template tokens, given by their codes (array, by place)."""
    return F.when(F.size(codes) >= width, F.transform(
        F.sequence(F.lit(1), F.size(codes) - width + 1),
        lambda i: F.xxhash64(F.slice(codes, i, width)))).otherwise(F.array().cast("array<bigint>"))


def _numbered(hashes: Column, words: Column, template: Column, width: int | Column) -> Column:
    """Windows with their place and slot values, inside the text's row (exploded, each would carry the whole text).

    ``first`` and ``last`` tell whether a run of equal windows begins or ends here.
    """
    width = F.lit(width) if isinstance(width, int) else width
    plain = F.transform(hashes, lambda h, i: F.struct(
        (i + 1).alias("at"), h.alias("hash"), _slots(words, template, i + 1, width).alias("values")))

    def differs(a: Column, b: Column) -> Column:
        return ~F.coalesce((a["hash"] == b["hash"]) & (a["values"] == b["values"]), F.lit(False))

    def flagged(ws: Column) -> Column:
        return F.transform(ws, lambda w, i: F.struct(
            w["at"].alias("at"), w["hash"].alias("hash"), w["values"].alias("values"), (F.size(w["values"]) == width).alias("bare"),
            differs(w, F.get(ws, i - 1)).alias("first"), differs(w, F.get(ws, i + 1)).alias("last")))
    return F.element_at(F.transform(F.array(plain), flagged), 1)  # bound once: written out, each window would number them all again


def _slots(words: Column, template: Column, at: Column, width: Column) -> Column:
    """Values in the placeholders of the window at ``at`` (from 1), in order."""
    return F.transform(F.filter(F.sequence(at, at + width - 1), lambda j: F.get(template, (j - 1).cast("int")).startswith("<")),
                       lambda j: F.lower(F.get(words, (j - 1).cast("int"))))


def text_key(text: Column) -> Column:
    """Tells the texts of rows with one id apart."""
    return F.unhex(F.md5(text.cast("binary")))


def item_windows(items: DataFrame, width: int, min_tokens: int) -> DataFrame:
    """(item, item_id, width, n_windows, at, hash, slots, bare, first, last, named, n_hash, key, n_key) for every window.

    ``items`` has (item, item_id, words).  ``named`` marks the second form of a first window.  ``key`` is the
    hash, for a repeated window of nothing but slots with its values; n_hash and n_key count an item's equal ones.
    """
    rows = (items.withColumn("template", templates(F.col("words")))
            .filter(F.size("words") >= min_tokens)
            .withColumn("width", F.least(F.size("words"), F.lit(width))))
    own = _numbered(window_hashes(token_codes(F.col("template")), F.col("width")), F.col("words"), F.col("template"), F.col("width"))
    as_name = F.concat(F.array(F.lit("<name>")), F.slice("template", 2, width - 1))
    marked = F.concat(F.array(F.concat(F.lit(_NAME), F.get("words", F.lit(0)))), F.slice("words", 2, width - 1))
    start = _numbered(window_hashes(token_codes(as_name), F.col("width")), marked, as_name, F.col("width"))
    name = F.get("words", F.lit(0)).rlike(r"^\p{Lu}\p{Ll}+$")
    each = rows.select("item", "item_id", "width", own.alias("own"), F.when(name, start).otherwise(F.slice(start, 1, 0)).alias("start"))
    every = each.select("item", "item_id", "width", F.size("own").alias("n_windows"), F.explode(F.concat(
        F.transform("own", lambda w: F.struct(F.lit(False).alias("named"), w.alias("w"))),
        F.transform("start", lambda w: F.struct(F.lit(True).alias("named"), w.alias("w"))))).alias("e"))
    flat = every.select("item", "item_id", "width", "n_windows", "e.named", "e.w.*").withColumnRenamed("values", "slots")
    flat = flat.withColumn("n_hash", F.count("*").over(W.Window.partitionBy("item", "named", "hash")))
    flat = flat.withColumn("valued", F.col("bare") & (F.col("n_hash") > 1))
    flat = flat.withColumn("key", F.when(F.col("valued"), F.xxhash64("hash", "slots")).otherwise(F.col("hash")))
    return flat.withColumn("n_key", F.count("*").over(W.Window.partitionBy("item", "named", "key")))


def _proposals(windows: DataFrame) -> DataFrame:
    """Which places of a repeated window propose alignments: (item, key, item_at, slots, rule)."""
    many = windows.filter("n_key > 1")
    fixed = F.col("valued") | (F.size("slots") == 0)
    places = W.Window.partitionBy("item", "key")
    many = (many.withColumn("least", F.min("at").over(places)).withColumn("end", F.min(F.when(F.col("last"), F.col("at"))).over(places))
            .withColumn("n_value", F.count("*").over(W.Window.partitionBy("item", "key", "slots"))))
    rules = [(fixed & (F.col("at") == F.col("least")), "first"), (fixed & (F.col("at") == F.col("end")), "last"),
             (~fixed & (F.col("at") == F.col("least")), "any"), (~fixed & (F.col("n_value") == 1), "equal")]
    rule = F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in rules]))
    return many.select("item", "key", F.col("at").alias("item_at"), "slots", F.explode(rule).alias("rule"))


def _word_copies(rows: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Documents that hold an item of up to ``width`` words word by word: (doc_id, text_key, item, item_id)."""
    def plain(words: Column) -> Column:
        return F.transform(words, lambda w: F.lower(F.ltrim(w, F.lit(_NAME))))

    short = items.select("item", "item_id", plain(F.col("words")).alias("wanted")).filter(F.size("wanted").between(1, width))
    short = cut(short.withColumn("hash", F.xxhash64("wanted")))
    sizes = sorted(r[0] for r in short.select(F.size("wanted")).distinct().collect())  # 1..width
    if not sizes:
        return short.select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("binary").alias("text_key"), "item", "item_id")
    each = rows.withColumn("plain", plain(tokens(F.col("text"))))
    runs = [window_hashes(F.col("plain"), k) for k in sizes]
    hashes = F.array_distinct(F.concat(*runs))
    met = cut(each.select("doc_id", "text_key", F.explode(hashes).alias("hash")).join(short, "hash").drop("hash").distinct())
    met = met.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    line = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    return (each.join(met, same).filter(line("plain").contains(line("wanted")))
            .select("doc_id", "text_key", "item", "item_id").distinct())


def find_leak_rows(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", width: int = 8, min_tokens: int = 5, min_cover: float = 0.3) -> DataFrame:
    """Contaminated pairs: (doc_id, text_key, item_id, n_windows, cover, n_slots, n_changed).

    n_slots counts the distinct slot values compared, n_changed those that differ from the item's.
    """
    known = cut(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("item_id"),
                             tokens(F.col(item_text)).alias("words")))
    windows = cut(item_windows(known, width, min_tokens))
    widths = sorted({width, *(r[0] for r in windows.select("width").distinct().collect())})  # min_tokens..width
    rows = (docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL")
            .withColumn("text_key", text_key(F.col("text"))))
    doc = ["doc_id", "text_key"]

    def keyed(codes: Column) -> Column:
        each = [window_hashes(codes, w) for w in widths]
        return F.array_distinct(F.concat(*each))

    # 1. which items does a document share windows with, and how many of the item's places have them
    wanted = windows.groupBy("item", "hash").agg(F.count("*").alias("places"), F.max("n_windows").alias("n_windows"))
    per_doc = (rows.withColumn("words", tokens(F.col("text"))).withColumn("codes", token_codes(templates(F.col("words"))))
               .select(*doc, F.explode(keyed(F.col("codes"))).alias("hash")))
    shared = (per_doc.join(wanted, "hash").groupBy(*doc, "item", "hash").agg(F.max("places").alias("places"), F.max("n_windows").alias("n_windows"))
              .groupBy(*doc, "item").agg(F.sum("places").alias("n"), F.max("n_windows").alias("n_windows"))
              .filter(F.col("n") >= F.col("n_windows") * min_cover).select(*doc, "item"))
    shared = cut(shared)

    # 2. the places of those pairs' windows
    same_row = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    partners = shared.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    again = rows.join(partners.select("d", "k").distinct(), same_row, "left_semi")
    w = [_numbered(window_hashes(F.col("codes"), k), F.col("words"), F.col("template"), k) for k in widths]
    places = (again.withColumn("words", tokens(F.col("text"))).withColumn("template", templates(F.col("words")))
              .withColumn("codes", token_codes(F.col("template")))
              .select(*doc, F.explode(F.concat(*w)).alias("w")).select(*doc, "w.*"))
    kinds = windows.select("item", "hash", "valued").distinct()
    met = (places.join(kinds, "hash").join(partners.withColumnRenamed("item", "i"), same_row & (F.col("item") == F.col("i")), "left_semi")
           .withColumn("key", F.when(F.col("valued"), F.xxhash64("hash", "values")).otherwise(F.col("hash"))))
    met = cut(met.select(*doc, "item", "at", "key", "values", "first", "last").distinct())

    # 3. alignments: by windows an item holds once, and as its repeated windows propose; these are looked up in them
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    single = met.join(windows.filter("n_key = 1").select("item", "key", F.col("at").alias("item_at"), "slots", "named"), ["item", "key"])
    rule = ((F.col("rule") == "any") | ((F.col("rule") == "first") & F.col("first")) | ((F.col("rule") == "last") & F.col("last"))
            | ((F.col("rule") == "equal") & (F.col("slots") == F.col("values"))))
    single = single.select(*doc, "item", shift, "item_at", "slots", "values", "named")
    proposed = met.join(_proposals(windows), ["item", "key"]).filter(rule).select(*doc, "item", shift)
    repeated = windows.filter("n_key > 1").select("item", "key", F.col("at").alias("item_at"), "slots")
    shifts = single.select(*doc, "item", "shift").unionByName(proposed).distinct().join(repeated, "item")
    looked_up = (shifts.withColumn("at", F.col("shift") + F.col("item_at")).withColumnsRenamed({"doc_id": "d", "text_key": "k", "item": "i", "key": "x", "at": "a"})
                 .join(met, same_row & (F.col("item") == F.col("i")) & (F.col("key") == F.col("x")) & (F.col("at") == F.col("a")))
                 .select(*doc, "item", "shift", "item_at", "slots", "values", F.lit(False).alias("named")))
    pairs = F.zip_with("slots", "values", lambda a, b: F.struct(a.alias("item_value"), b.alias("value")))
    # an item's first word that is the same in the document is no slot
    counted = F.when(F.col("named") & (F.get("slots", F.lit(0)) == F.get("values", F.lit(0))), F.slice(pairs, 2, width)).otherwise(pairs)
    aligned = (single.unionByName(looked_up).groupBy(*doc, "item", "shift")
               .agg(F.collect_set("item_at").alias("found"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
                    F.array_distinct(F.flatten(F.collect_set(counted))).alias("counted")))
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_value"]))) == F.size("pairs")
    changed = F.size(F.filter("counted", lambda p: p["item_value"] != p["value"]))
    best = (aligned.filter(consistent).groupBy(*doc, "item")
            .agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long").alias("found"),
                 F.max(F.size("counted")).cast("long").alias("n_slots"), F.max(changed).cast("long").alias("n_changed"))
            .join(windows.select("item", "item_id", "n_windows").distinct(), "item")
            .filter(F.col("found") >= F.col("n_windows") * min_cover)
            .select(*doc, "item", "item_id", F.col("found").alias("n_windows"), (F.col("found") / F.col("n_windows")).alias("cover"),
                    "n_slots", "n_changed"))

    # 4. short items word by word; a pair found both ways keeps its alignment's figures
    exact = _word_copies(rows, known, width).select(*doc, "item", "item_id", F.lit(1).cast("long").alias("n_windows"), F.lit(1.0).alias("cover"),
                                                    F.lit(0).cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_changed"))
    figures = ["n_windows", "cover", "n_slots", "n_changed"]
    both = best.unionByName(exact).groupBy(*doc, "item", "item_id").agg(F.max(F.struct("n_slots", "n_windows", "cover", "n_changed")).alias("f"))
    return both.select(*doc, "item_id", *[F.col(f"f.{c}").alias(c) for c in figures])


def find_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """find_leak_rows without the texts' keys: (doc_id, item_id, n_windows, cover, n_slots, n_changed)."""
    return find_leak_rows(docs, items, **options).drop("text_key")
