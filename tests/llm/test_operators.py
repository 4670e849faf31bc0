"""Every operator against a brute-force version, and on edge cases: nulls in any column, empty and
long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from coheral.llm import (chat_windows, chosen_path, decontaminate, language_id, licence_scan, maxent, mixing, pii,
                         repeats, rp_forest)
from coheral.llm.common import id_remainder
from coheral.llm.lyndon import suffix_ranks
from coheral.llm.words import shingle_sets
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, score double, hash string"
EN = "the quick brown fox jumps over the lazy dog and then it runs to the river where the water is cold"
FR = "le renard brun saute par dessus le chien paresseux et puis il court vers la rivière où l'eau est froide"


def _text(rng, n):
    return " ".join(rng.choice(EN.split()) + str(rng.randint(0, 40)) for _ in range(n))


def _rows():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base, lang = (EN, "en") if i % 2 else (FR, "fr")
        words = base.split()
        rng.shuffle(words)
        rows.append((i, " ".join(words * 2) + " " + _text(rng, 20), lang, f"s{i % 3}"))
    long_text = _text(rng, 5000)
    near = long_text.split()
    near[100] = "changed"
    rows += [(100, long_text, "en", "s0"), (101, " ".join(near), "en", "s1"), (102, long_text, "en", None), (102, long_text, "en", None),
             (103, None, "en", "s0"), (104, "", None, "s1"), (105, "?! 123", "fr", "s9"), (None, "no id here at all today", "en", "s0"),
             (None, None, None, None), (106, "a " * 300, "en", "s2"), (107, "one two", "en", "s2"), (108, "one two", "en", "s2"),
             (109, "x" * 30000, "en", "s2"), (110, "mail bob.smith@mail.example.org or +1 (454) 555-9913, host 10.2.3.4", "en", "s1")]
    return [(a, b, c, d, None if b is None else len(b), 1, 0.5, "h") for a, b, c, d in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x20\x09-\x0d]+", low)


# -- 10: language ID

def test_language_id(docs, nothing):
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    out = language_id.identify(docs, held).collect()
    assert len(out) == docs.count()
    full = [r for r in out if r.doc_id is not None and r.doc_id < 60]
    assert all(r.lang_pred == r.lang for r in full) and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (103, 104, 105)} == {"und"}
    assert language_id.identify(nothing, held).count() == 0
    untaught = language_id.predict(docs, language_id.fit(nothing)).select("lang_pred").distinct().collect()
    assert [r[0] for r in untaught] == ["und"]


def test_language_filter_finds_every_learned_gram():
    rng = np.random.default_rng(0)
    profile = {f"l{k}": np.unique(rng.integers(0, 2**40, 500)) for k in range(70)}  # more than one 64-bit slice
    f = language_id.LanguageFilter(profile)
    for k, name in enumerate(f.langs):
        masks = f.languages(profile[name])
        assert ((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
    fresh = rng.integers(2**41, 2**42, 20000)
    wrong = ((f.languages(fresh)[0] >> np.uint64(3)) & np.uint64(1)).mean()
    assert wrong < 0.01


# -- 7: licence scan

def _phrases(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = []
    for phrase, label in licence_scan.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), places


def test_licence_phrases_match_brute_force():
    rng = random.Random(1)
    vocabulary = "mit license apache general public the gnu of permission is hereby version 2 0 Über licensed under".split()
    index = licence_scan.LicenceIndex()
    for _ in range(400):
        text = rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))
        n, places, _ = index.scan(text)
        want_n, want = _phrases(text)
        assert n == want_n and sorted(places) == sorted(want)


def test_licence_matching_statistics_are_longest_factors():
    rng = random.Random(2)
    seqs = [[rng.randint(0, 3) for _ in range(rng.randint(1, 30))] for _ in range(5)]
    factors = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    sam = licence_scan.SuffixAutomaton(seqs)
    text = [rng.randint(0, 3) for _ in range(300)]
    state = size = 0
    for i, c in enumerate(text):
        while state and c not in sam.next[state]:
            state = sam.link[state]
            size = sam.length[state]
        if c in sam.next[state]:
            state, size = sam.next[state][c], size + 1
        longest = next((k for k in range(i + 1, 0, -1) if tuple(text[i + 1 - k:i + 1]) in factors), 0)
        assert size == longest


def test_licence_spans_and_edges(spark, docs, nothing):
    notice = dict(licence_scan.TEMPLATES)["mit"]
    rows = spark.createDataFrame([(1, "Intro. " + notice.upper() + " end"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, "")],
                                 "doc_id bigint, text string")
    got = {r.doc_id: r for r in licence_scan.scan(rows).collect()}
    assert {s.label for s in got[1].spans} == {"mit"} and [s.label for s in got[2].spans] == ["cc-by-nc"]
    assert got[3].n_words == got[4].n_words == 0 and got[3].spans == []
    assert licence_scan.scan(docs).count() == docs.count() and licence_scan.scan(nothing).count() == 0


# -- 3: mixing

def test_mix_targets_and_quotas(docs, nothing):
    got = mixing.taken_words(docs, shards=8, block_words=16).collect()
    assert len(got) == docs.count()
    total, by = sum(r["size"] for r in got), collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"] and r["size"] == len(_words(next(x[1] for x in _rows() if x[0] == r.doc_id))) or r.doc_id is None
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r["size"] for r in by[s]) for s in names}
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = total
    while True:  # cap and reshare until nothing is above
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s], left = 3.0 * sizes[s], left - 3 * sizes[s]
            open_.remove(s)
    for s in names:
        assert by[s][0].target == pytest.approx(target[s]) and abs(sum(r.taken for r in by[s]) - target[s]) <= 1
    again = mixing.taken_words(docs.repartition(5), shards=8, block_words=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.taken_words(nothing).count() == 0


def test_mix_shards_are_disjoint_and_even(docs):
    sizes = mixing.document_sizes(docs)
    rows = mixing.mix(sizes, mixing.source_targets(sizes), shards=8, block_words=16).collect()
    assert len({(r.doc_id, r["copy"], r.block, r.pass_no) for r in rows if r.doc_id is not None}) == len([r for r in rows if r.doc_id is not None])
    per = collections.Counter(r.shard for r in rows)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1


def test_hypergeometric_draws(spark):
    n = 4000
    u = (F.col("id") + 0.5) / n
    got = spark.range(n).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), u).alias("x")).groupBy("x").count().collect()
    for r in got:
        want = math.comb(20, r.x) * math.comb(30, 10 - r.x) / math.comb(50, 10)
        assert abs(r["count"] / n - want) < 2 / n
    edges = spark.range(1).select(*[mixing.hypergeometric(F.lit(a), F.lit(b), F.lit(c), F.lit(0.5)).alias(f"c{k}") for k, (a, b, c) in enumerate(
        [(0, 0, 0), (5, 0, 3), (5, 5, 3), (5, 2, 5), (5, 2, 0)])]).first()
    assert tuple(edges) == (0, 0, 3, 2, 0)


# -- 6: chat windows

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\\\", "a", " ", "\n", "é", "<<SYS>>"]


def _conversations():
    rng = random.Random(5)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 12)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "tool\n\\n", None, "assistant"])
            text = rng.choice([None, "", "".join(rng.choice(CONTROL) for _ in range(rng.randint(1, 30))), "word " * rng.randint(1, 60)])
            rows.append((c, t, role, text, 7))
    rows += [(50, 1, "assistant", "same", 1), (50, 1, "assistant", "same", 1), (None, None, None, None, None), (51, None, "user", "x", 0)]
    return rows


@pytest.mark.parametrize("budget,history", [(1024, 256), (40, 12), (1, 0), (40, 0)])
def test_chat_windows_round_trip(spark, budget, history):
    rows = _conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, windows int").repartition(4)
    made = chat_windows.windows(df, budget=budget, history=history)
    got = {r.conv_id: r for r in chat_windows.digests(chat_windows.read_back(made)).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in made.collect():
        for k, w in enumerate(r.windows):
            turns = re.split(r"(?<!\\)</s>", w.text)[:-1]
            cost = [len(_words(t.split("\n", 1)[1])) + 4 for t in turns]
            assert len(turns) - w.n_repeated >= 1 and (k == 0) == (w.n_repeated == 0) or history == 0 or k > 0
            lead = int(turns[0].startswith("<s>system"))
            # over the budget only where the lead and one turn alone are
            assert sum(cost) <= budget or (len(turns) - w.n_repeated == 1 and w.n_repeated <= lead)


def test_chat_windows_shed_history_for_a_long_turn(spark):
    say = lambda n: " ".join(["w"] * n)
    rows = [(1, 0, "system", say(6)), (1, 1, "user", say(700)), (1, 2, "assistant", say(120)), (1, 3, "user", say(117)),
            (1, 4, "assistant", say(1000)), (1, 5, "user", say(2000)), (1, 6, "assistant", say(3))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat_windows.windows(df, budget=1024, history=256).first().windows
    sizes = [[len(_words(t.split("\n", 1)[1])) + 4 for t in w.text.split("</s>")[:-1]] for w in windows]
    assert [(len(s), w.n_repeated) for s, w in zip(sizes, windows)] == [(4, 0), (2, 1), (2, 1), (2, 1)]
    assert [sum(s) for s in sizes] == [959, 1014, 2014, 17]


def test_chat_windows_empty(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_windows.windows(none).count() == 0


# -- 5: decontamination

def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([
        (1, "Anna bought 12 apples and 7 pears at the market for 30 dollars how much did each cost"),
        (2, "Which of the following rivers is the longest river that flows through the continent of Africa"),
        (3, "two words"), (4, None), (5, "only five words stand here")], "item_id bigint, text string")
    texts = [
        (1, "xx yy Anna bought 45 apples and 9 pears at the market for 80 dollars how much did each cost zz"),        # new parameters, same unit
        (2, "some text before. which of the following rivers is the longest river that flows through the continent of africa and more"),
        (3, "which of the following rivers is the nicest of them all and nothing else in this text matters"),          # a short overlap only
        (4, "clean text about apples and pears"), (5, None), (6, ""), (7, "x. only five words stand here"), (None, "Which of the following rivers is the longest river that flows through the continent of Africa")]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(rows, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (7, 5), (None, 2)}
    assert got[1, 1].n_slots == 4 and got[1, 1].n_changed == 3 and got[2, 2].n_changed == 0
    assert decontaminate.find_leaks(nothing, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs, items).count() == 0


def test_decontamination_wants_consistent_slots(spark):
    item = "there are 5 red balls and 8 blue balls so we add 5 and 8 and then 5 more to get the sum"
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    good = item.replace("5", "31").replace("8", "44")
    parts = item.split("5")
    bad = parts[0] + "1" + parts[1] + "2" + parts[2] + "3" + parts[3]  # one value of the item, three of the document
    rows = spark.createDataFrame([(1, good), (2, bad), (3, item)], "doc_id bigint, text string")
    assert {r.doc_id for r in decontaminate.find_leaks(rows, items).collect()} == {1, 3}


def test_decontamination_repeated_words_stay_linear(spark):
    items = spark.createDataFrame([(1, "la " * 30)], "item_id bigint, text string")
    seconds = []
    for n in (2_000, 20_000, 160_000):  # the first run compiles
        rows = spark.createDataFrame([(1, "la " * n)], "doc_id bigint, text string")
        start = time.time()
        assert [(r.doc_id, r.item_id, r.n_windows) for r in decontaminate.find_leaks(rows, items).collect()] == [(1, 1, 23)]
        seconds.append(time.time() - start)
    assert seconds[2] < 8 * seconds[1] + 10  # eight times the words; all pairs of places would be 64 times the work


def test_decontamination_repeated_words_are_found(spark):
    items = spark.createDataFrame([(1, "la " * 30)], "item_id bigint, text string")
    rows = spark.createDataFrame([(1, "la " * 20000), (2, "la " * 9), (3, "x. " + "la " * 30 + "and so on")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(rows, items).collect()}
    assert set(got) == {1, 3} and got[1].n_windows == got[3].n_windows == 23 and got[3].cover == 1


def test_decontamination_aligns_repeated_windows(spark):
    rng = random.Random(8)
    series = " ".join(str(rng.randint(0, 999)) for _ in range(40))
    shape = lambda k: "; ".join(f"in round {i} team x got {i * k + 3} points and lost" for i in range(1, 7))
    thrice = " ".join(["tell me the name of the tallest tree in the old park please"] * 3)
    items = spark.createDataFrame([(1, series), (2, shape(7)), (3, thrice)], "item_id bigint, text string")
    other = " ".join(str(rng.randint(0, 999)) for _ in range(40))
    rows = spark.createDataFrame([(1, f"1 2 3 {series} 4 5 6"), (2, other), (3, "so. " + shape(7)), (4, "so. " + shape(11)),
                                  (5, f"some text {thrice} more"), (6, "in round 3 team x got 4 points and lost")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(rows, items).collect()}
    assert set(got) == {(1, 1), (3, 2), (4, 2), (5, 3)} and got[1, 1].cover == got[5, 3].cover == 1 and got[4, 2].n_changed > 0


def test_decontamination_first_words_and_short_items(spark):
    items = spark.createDataFrame([(1, "What is the capital of France"), (2, "Paris, France"), (3, "who is it"), (4, "What is the capital of Spain and of Peru")],
                                  "item_id bigint, text string")
    texts = [(1, "then he wrote What is the capital of France"), (2, "so. What is the capital of France"), (3, "they met in Paris, France again"),
             (4, "Who is it? nobody"), (5, "then he wrote What is the capital of Spain and of Peru"), (6, "who it is"), (7, "whois it")]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(rows, items).collect()}
    assert got >= {(1, 1), (2, 1), (3, 2), (4, 3), (5, 4)} and not {d for d, _ in got} & {6, 7}


def test_decontamination_tells_rows_with_one_id_apart(spark):
    item = "Which of the following rivers is the longest river that flows through the continent of Africa"
    words = item.lower().split()
    halves = [" ".join(words[:9]), " ".join(words[2:11])]  # two windows of nine each
    rows = spark.createDataFrame([(None, item), (None, "nothing of it in here"), (1, halves[0]), (1, halves[1]), (None, halves[0]), (None, halves[1]), (2, item), (2, item)],
                                 "doc_id bigint, text string")
    got = decontaminate.find_leak_rows(rows, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.text_key == hashlib.md5(item.encode()).digest()) for r in got) == [(0, True), (2, True)]


# -- 4: personal data

def _base_spans(t):
    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            c = int(c) * (2 if i % 2 else 1)
            s += c - 9 if c > 9 else c
        return s % 10 == 0
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_pii_base_spans_match_brute_force(spark):
    rng = random.Random(4)
    pieces = ["a@b.co", "1.2.3.4", ".5.6", "+1 555 123 4567", "4111 1111 1111 1111", "4111111111111111", "@", ".", "+", "-", " ", "é😀", "x_y", "256.1.1.1",
              "007.0.0.1", "(", ")", "%", "12", "a@b.com_x@y.org", "123-45-6789", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + ["9" * 20000, "1 " * 20000, "a." * 20000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = pii.find(rows, pii.SpanClassifier()).select("doc_id", pii.span_text(F.col("base_spans")).alias("b"), pii.span_text(F.col("spans")).alias("s"))
    for r in got.collect():
        assert r.b == r.s == ",".join(f"{k}:{a}:{b}" for k, a, b in _base_spans(texts[r.doc_id]))


def test_pii_learns_and_redacts(spark, docs, nothing):
    rng = random.Random(6)
    filler = EN.split()
    made = []
    for i in range(200):
        kind = ["phone {} ", "token = \"{}\" ", "release {} "][i % 3]
        value = [f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", "%040x" % rng.getrandbits(160), "000-00-0000"][i % 3]
        made.append((i, " ".join(rng.sample(filler, 5)) + " " + kind.format(value) + rng.choice(filler)))
    rows = spark.createDataFrame(made, "doc_id bigint, text string")
    model = pii.fit(rows)
    out = pii.redact(pii.find(rows, model)).collect()
    assert all("[SECRET]" in r.text for r in out if r.doc_id % 3 == 1) and all("[LOCAL_PHONE]" in r.text for r in out if r.doc_id % 3 == 0)
    assert all("[" not in r.text for r in out if r.doc_id % 3 == 2)
    assert pii.find(docs, pii.fit(docs)).count() == docs.count()
    assert pii.fit(nothing).prior == {} and pii.find(nothing, pii.fit(nothing)).count() == 0
    mine = {r.doc_id: r.text for r in pii.redact(pii.find(docs.filter("doc_id IN (103, 104, 110)"), model)).collect()}
    assert mine[103] is None and mine[104] == "" and mine[110] == "mail [EMAIL] or [PHONE], host [IP]"


# -- 8: n-gram Jaccard join

def _brute_join(texts):
    sets = [set(s.tolist()) for s in shingle_sets([t or "" for t in texts])]
    links, parent = [0] * len(sets), list(range(len(sets)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return links, [root(i) for i in range(len(sets))]


def test_jaccard_join_matches_brute_force(spark):
    rng = random.Random(8)
    texts = [_text(rng, rng.randint(1, 120)) for _ in range(60)]
    for i in range(60):  # near copies, chains of them, and one large group
        w = texts[i].split()
        for k in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{k}{i}"
            texts.append(" ".join(w))
    big = _text(rng, 100).split()
    for k in range(150):
        w = list(big)
        w[rng.randrange(100)] = f"v{k % 40}"
        texts.append(" ".join(w))
    texts += texts[:10] + [None, "", "one", "one", "two three", "ONE"]
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, size int, digest string").repartition(5)
    links, root = _brute_join(texts)
    for options in ({}, {"split_above": 20, "block": 16, "recall": 0.99999}):  # splits and block pairs forced
        got = {r.doc_id: r for r in chosen_path.jaccard_join(rows, **options).collect()}
        assert [got[i].n_links for i in range(len(texts))] == links
        assert [got[i].class_id for i in range(len(texts))] == root


def test_jaccard_join_edges(docs, nothing):
    out = chosen_path.jaccard_join(docs).collect()
    assert len(out) == docs.count() and chosen_path.jaccard_join(nothing).count() == 0
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert {r.class_id for k in (100, 101, 102) for r in by[k]} == {100} and by[100][0].n_links == 3 and by[100][0].n_copies == 3
    assert by[103][0].class_id == 103 and by[103][0].n_links == 0 and all(r.class_id is None for r in by[None])


# -- 2: nearest neighbours

def test_projection_forest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    x[500:900] = x[500]  # many copies of one vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5020, [0.0] * 24, 1), (5040, [None] + [1.0] * 23, 1), (5060, [float("nan")] * 24, 1), (5080, [], 1), (None, [1.0] * 24, 1), (5100, [1.0], 1)]
    df = spark.createDataFrame(rows + odd + rows[:2], "vec_id bigint, embedding array<double>, rank int").repartition(4)
    got = collections.defaultdict(list)
    for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0, block=256).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, rows_ in got.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -np.round(s, 9))) if i != q][:20]
        hits += len(set(order) & {r.vec_id for r in rows_})
        assert [r["rank"] for r in rows_] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rows_)
        assert [(-r.score, r.vec_id) for r in rows_] == sorted((-r.score, r.vec_id) for r in rows_)
    assert hits / (20 * len(got)) >= 0.9


def test_projection_forest_small_tables(spark):
    kind = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0])], kind)
    got = rp_forest.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 0.5), (2, 0.5), (3, -1.0)]
    assert rp_forest.nearest(spark.createDataFrame([], kind), F.col("vec_id") == 0).count() == 0


# -- 1: LM scoring

def test_maxent_base_scores_and_gain(spark):
    rng = random.Random(9)
    langs = [[f"{a}{b}{c}" for a in "abc" for b in s for c in s] for s in ("xyzw", "mnop", "rstu")]
    rows = [(i, " ".join(rng.choice(langs[i % 3]) for _ in range(rng.randint(0, 80)))) for i in range(600)]
    rows += [(600, None), (601, ""), (602, "UPPER upper\tUpper\x0bnew"), (603, "word " * 20000), (None, "axx ayy")]
    df = spark.createDataFrame([(a, b, 1, 0.5) for a, b in rows], "doc_id bigint, text string, shard int, score double").repartition(4)
    held = F.coalesce(id_remainder("doc_id", 10) == 0, F.lit(False))
    got = {r.doc_id: r for r in maxent.score(df, held, shards=3, table_share=1e-3).collect()}
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 if d is not None else False for d, _ in rows}
    counts = collections.Counter()
    for d, t in rows:
        if d is not None and not out[d]:
            counts.update(_words(t) + ["\x00end"])
    n, v = sum(counts.values()), len(counts)
    for d, t in rows:
        tok = _words(t) + ["\x00end"]
        r = got[d]
        assert r.held_out == out[d] and r.n_tokens == len(tok) and r.n_known == sum(counts[w] > 0 for w in tok) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok))
    held_rows = [got[d] for d, _ in rows if out.get(d) and d < 600]
    assert sum(r.score for r in held_rows) > 0.95 * sum(r.base_score for r in held_rows)  # contexts tell the language


def test_maxent_is_a_distribution():
    rng = np.random.default_rng(1)
    model = maxent.Model(100, 10, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                         np.ones(maxent.CLASSES, np.int64), np.ones(maxent.CLASSES, np.int64),
                         rng.standard_normal((maxent.BUCKETS + 1, maxent.CLASSES)).astype(np.float32))
    rows = rng.integers(0, maxent.BUCKETS, (5, 4)).astype(np.int32)
    total = sum(10 ** model.class_log10(rows, np.full(5, c)) for c in range(maxent.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)


def test_maxent_three_back_and_one_step_per_weight():
    model = maxent.Model(100, 10, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                         np.ones(maxent.CLASSES, np.int64), np.ones(maxent.CLASSES, np.int64),
                         np.zeros((maxent.BUCKETS + 1, maxent.CLASSES), np.float32))
    assert maxent.SPELLING == 64
    h, sizes = maxent.tokens(["one two three four", "six two three four"])
    _, cls, rows = model.features(h, sizes)
    a, b = rows[3], rows[8]  # "four" in both texts: only the word three back differs
    assert rows.shape[1] == 4 and (a[:3] == b[:3]).all() and a[3] != b[3]
    memory = np.zeros_like(model.weights)
    maxent.gradient_steps(model, rows, cls, memory, 0.15)
    p = np.full((len(cls), maxent.CLASSES), 1 / maxent.CLASSES)
    p[np.arange(len(cls)), cls] -= 1
    want = np.zeros(memory.shape)
    for r, g in zip(rows, p):
        for f in r:
            want[f] += g
    want[maxent.BUCKETS] = p.sum(0)
    assert np.allclose(memory, want ** 2, atol=1e-5)  # every weight has a memory of its own
    assert np.allclose(model.weights, -0.15 * want / np.sqrt(want ** 2 + 1e-6), atol=1e-3)


def test_maxent_edges(docs, nothing):
    held = F.coalesce(id_remainder("doc_id", 10) == 0, F.lit(False))
    assert maxent.score(docs, held).count() == docs.count()
    assert maxent.score(nothing, held).count() == 0
    unlearned = maxent.score(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in unlearned} == {0} and all(r.base_score == 0 for r in unlearned)


# -- 9: repeated byte strings

def test_lyndon_suffix_ranks():
    rng = np.random.default_rng(1)
    for _ in range(300):
        texts = [[*rng.integers(1, rng.integers(2, 5), rng.integers(0, 40)), 0] for _ in range(rng.integers(1, 8))]
        bounds = np.cumsum([0] + [len(t) for t in texts])
        ranks = suffix_ranks(np.concatenate(texts).astype(np.int64), bounds)
        for t, lo in zip(texts, bounds):
            order = sorted(range(len(t)), key=lambda i: t[i:])
            assert [int(ranks[lo + i]) - lo for i in order] == list(range(len(t)))


def _brute_repeats(rows):
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i:i + 100]
            if w in seen:
                gone[i:i + 100] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot_share", [0.0005, 0.0])
def test_repeats_match_brute_force(spark, hot_share):
    rng = random.Random(11)
    passages = [_text(rng, n) for n in (12, 20, 40, 80, 17)]
    rows = []
    for i in range(150):
        parts = [_text(rng, rng.randint(1, 40)) for _ in range(3)] + [rng.choice(passages)[rng.randint(0, 30):] for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(200, None), (201, ""), (202, "ab" * 900), (203, "é" * 400), (204, rows[3][1]), (205, rows[3][1]), (206, "z" * 99), (207, "z" * 100), (208, "z" * 101)]
    df = spark.createDataFrame([(a, b, 3, "c") for a, b in rows], "doc_id bigint, text string, n_bytes int, chunk string").repartition(5).cache()
    df.count()
    got = {r.doc_id: tuple(r) for r in repeats.remove_repeats(df, hot_share=hot_share).collect()}
    for want in _brute_repeats(rows):
        assert got[want[0]] == want


def test_repeats_large_buckets_use_the_same_classes():
    rng = np.random.default_rng(3)
    n = 400
    left, right = rng.integers(0, 3, (n, 7)), rng.integers(0, 3, (n, 7))
    pack = lambda m: sum(m[:, j].astype(np.uint64) << np.uint64(8 * j) for j in range(7))
    core = np.sort(rng.integers(0, 20, n)).astype(np.uint64)
    t_max = np.full(n, 7, np.uint64) << np.uint64(56)
    args = core, pack(left) | t_max, pack(right)
    a, b = repeats.window_classes(*args), repeats.window_classes(*args, most=1)
    for x in (a, b):
        keys = {}
        for v, t, c in zip(*x):
            key = (int(core[v]), int(t), tuple(left[v][:t]), tuple(right[v][:7 - t]))
            assert keys.setdefault(key, c) == c
        assert len(set(keys.values())) == len(keys)


def test_repeats_edges(docs, nothing):
    assert repeats.remove_repeats(docs).count() == docs.count() and repeats.remove_repeats(nothing).count() == 0
    again = [r for r in repeats.remove_repeats(docs).collect() if r.doc_id == 102]
    assert [r.n_removed for r in again] == [r.n_bytes for r in again]  # whole copies of document 100
