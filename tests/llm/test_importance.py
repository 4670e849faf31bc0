"""Operator 12 against a brute-force version."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from coheral.llm import importance

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _brute(docs, target, percent=25, min_words=20, buckets=10000, seed=7):
    """(doc_id, n_features, weight, score, rank) of every row, the plain way."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, text in docs for f in _features(text)[1])
    t = collections.Counter(bucket(f) for text in target for f in _features(text)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        n, features = _features(text)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([n, doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[0] >= min_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    for i, r in enumerate(able[:len(able) * percent // 100]):
        r[5] = i + 1
    return [tuple(r[1:]) for r in out]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


SCHEMA = "doc_id bigint, text string, score double, rank int, weight string, place long"


def _texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeXYZ01é漢") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["w" * 40, "É" * 50]
    separators = [" ", ", ", "\n\n", "-", " ", "\x00", "_", "'"]
    texts = []
    for _ in range(80):
        texts.append("".join(rng.choice(vocabulary) + rng.choice(separators) for _ in range(rng.randint(0, 70))))
    return texts


def test_hash_equals_the_reference_values():
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(3000)), np.uint8)
    length = np.array([rng.choice([0, 1, 3, 4, 7, 8, 12, 31, 32, 33, 63, 64, 95, 700]) for _ in range(400)])
    start = np.array([rng.randrange(2200) for _ in length])
    got = importance.Spans(data).xxh64(start, length)
    assert [int(g) for g in got] == [xxhash.xxh64_intdigest(data[a:a + n].tobytes()) for a, n in zip(start, length)]


def test_equal_keys_of_other_bytes_get_slots_of_their_own():
    data = np.frombuffer(b"abcdefgh ijabcdefgh ikabcdefgh ij", np.uint8)
    start, length = np.array([0, 11, 22]), np.array([11, 11, 11])
    table = importance.Table(importance.Spans(data), start, length, 10000, np.zeros(3, np.uint64))
    assert table.slot[0] == table.slot[2] != table.slot[1]
    assert sorted(table.count[table.used]) == [1, 2]


@pytest.mark.parametrize("block_words", [1, 2, 7, 1 << 15])
def test_blocks_hold_every_feature_once(block_words):
    texts = _texts()
    expected = collections.Counter(zlib.crc32(f.encode()) % 97 for t in texts for f in _features(t)[1])
    got, words = collections.Counter(), np.zeros(len(texts), int)
    for table, text_of, word_of in importance.blocks(texts, 97, block_words):
        assert len(text_of) == len(table.slot) == table.count.sum()
        for u in table.used:
            got[int(table.bucket[u])] += int(table.count[u])
        words += np.bincount(word_of, minlength=len(texts))
    assert got == expected and list(words) == [_features(t)[0] for t in texts]


def test_resampling_equals_brute_force(spark):
    docs = list(enumerate(_texts())) + [(500, None), (501, ""), (502, "?! --"), (None, "a b c " * 10), (None, "a b c " * 10), (None, None),
                                        (503, "long " * 60000), (503, "long " * 60000), (504, "x" * 50000), (-4, "other words " * 12)]
    target = ["a b c d e", None, "", "long other words " * 3]
    rows = spark.createDataFrame([(d, t, 0.5, 1, "w", 3) for d, t in docs], SCHEMA).repartition(5)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = importance.resample(rows, goal)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert _rows(got) == sorted(_brute(docs, target), key=repr)
    assert _rows(importance.resample(rows, goal, percent=100)) == sorted(_brute(docs, target, percent=100), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    assert importance.resample(none, one).count() == 0
    assert _rows(importance.resample(one, none)) == _brute([(1, "a b " * 20)], [])


def test_query_over_the_whole_table(spark):
    from coheral.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = QUERIES["op12_importance_resampling"].fn(spark, folder)
    assert _rows(got) == sorted(_brute(docs, target), key=repr)
