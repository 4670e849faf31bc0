"""Operator 13 against a brute-force version."""

import random
import re

import numpy as np

from coheral.llm import hyper_minhash as hm

SCHEMA = "doc_id bigint, text string, digest binary, size string, component_id int, kept string"


def _set(text, width=4):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def _brute(rows, percent=80, width=4):
    """(doc_id, n_shingles, component_id, kept) by comparing every pair of rows."""
    sets, parent = [_set(t, width) for _, t in rows], list(range(len(rows)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for v, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(v)] = min(doc_id, least.get(find(v), doc_id))
    return sorted(((d, len(sets[v]), least.get(find(v)), d == least.get(find(v))) for v, (d, _) in enumerate(rows)), key=repr)


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, b"x", "y", 7, "z") for d, t in rows], SCHEMA).repartition(4)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _variants(seed, bases=14, copies=7):
    """Texts of 1 to 120 words with copies of which some words are changed, so that many are near the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = []
    for _ in range(bases):
        words = [word() for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 13, 30, 60, 120]))]
        for _ in range(copies):
            changed = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(changed))
                changed[at: at + rng.choice([0, 1])] = [word()]
            texts.append(" ".join(changed))
            words = changed if rng.random() < 0.3 else words
    return texts


def test_equals_brute_force(spark):
    texts = _variants(1) + _variants(2)
    long_text = " ".join(f"w{i * i % 977}" for i in range(4000))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One TWO"), (904, "one two"), (905, "one two three"),
                                     (None, texts[0]), (None, texts[0]), (None, None), (None, "only a null id here today"), (-5, texts[3]),
                                     (906, long_text), (907, long_text + " more words at the end"), (908, "x" * 40000), (908, "another text under one id")]
    got = hm.near_duplicates(_frame(spark, rows))
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert _rows(got) == _brute(rows)


def test_small_blocks_give_the_same(spark):
    rows = list(enumerate(_variants(3, 6, 12)))
    assert _rows(hm.near_duplicates(_frame(spark, rows), group=1, block=4)) == _brute(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"v{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(250):
        words = list(base)
        words[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:100]) + " " + " ".join(f"u{i}x{k}" for k in range(100))) for i in range(40)]  # half the text in common
    assert _rows(hm.near_duplicates(_frame(spark, rows))) == _brute(rows)


def test_empty_tables(spark):
    assert hm.near_duplicates(_frame(spark, [])).count() == 0
    assert _rows(hm.near_duplicates(_frame(spark, [(1, None), (2, "")]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_registers_are_leading_zeros_and_mantissa():
    least = np.array([[0b1011 << 60, 0b00101 << 59, 1, 2**64 - 1]], np.uint64)
    got = hm._compress(least)[0]
    assert got[0] >> hm.MANTISSA == 1 and got[0] & 1023 == 0b0110000000
    assert got[1] >> hm.MANTISSA == 3 and got[1] & 1023 == 0b0100000000
    assert got[2] >> hm.MANTISSA == hm.LEVELS


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(5)
    for size, share in ((3000, 0.9), (3000, 0.6), (200, 0.8), (40, 0.75)):
        found = []
        for _ in range(40):
            grams = rng.integers(0, 2**63, 2 * size).astype(np.uint64)
            both = int(round(2 * size * share / (1 + share)))  # of two sets of ``size``
            a, b = grams[:size], np.concatenate((grams[:both], grams[size: 2 * size - both]))
            dense, occupied = hm.registers([a, b])
            s = hm.Sketches([d.tobytes() for d in dense], [np.packbits(o).tobytes() for o in occupied], np.array([size, size]))
            found.append(s.similarity(np.array([0]), np.array([1]))[0])
            assert abs(s.similarities(np.array([0]), np.array([1]))[0, 0] - found[-1]) < 1e-9
        assert abs(np.mean(found) - share) < 0.04


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.default_rng(6)
    missed = 0
    for size in (4, 8, 20, 100, 1000):
        for _ in range(200):
            grams = rng.integers(0, 2**63, size * 5 // 4).astype(np.uint64)
            dense, _ = hm.registers([grams[:size], grams])  # similarity 0.8
            bands = dense[:, : hm.BANDS * hm.BAND].reshape(2, hm.BANDS, hm.BAND)
            missed += not (bands[0] == bands[1]).all(1).any()
    assert missed == 0


def test_query_over_the_whole_table(spark):
    from coheral.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert _rows(QUERIES["op13_hyper_minhash"].fn(spark, folder)) == _brute(docs)
