"""Semantic vectors (X6) against a dense decomposition, Ward clustering (M6) against the plain rule."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coheral.operators import semantic as SE
from coheral.operators import ward as W
from tests.conftest import SMALL


def _dense(texts, min_df=2):
    rows = [Counter(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    df = Counter(w for r in rows for w in r)
    terms = sorted(w for w, n in df.items() if n >= min_df)
    idf = {w: math.log((1 + len(rows)) / (1 + df[w])) + 1 for w in terms}
    m = np.array([[r[w] * idf[w] for w in terms] for r in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def test_singular_values_equal_a_dense_decomposition(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(120).collect()
    texts = [r.text for r in docs] + [None, "", "?!", "onlyonceword"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    model = SE.fit_semantic(df, rank=12, oversample=20, iterations=6)
    u, s, vt = np.linalg.svd(_dense(texts), full_matrices=False)
    assert np.abs(model.singular / s[:12] - 1).max() < 0.01
    got = {r.i: np.array(r.embedding) for r in SE.semantic_embedding(df, model).collect()}
    exact = u[:, :12] * s[:12]
    seen = np.linalg.norm(exact, axis=1) > 1e-6
    exact = exact / np.maximum(np.linalg.norm(exact, axis=1, keepdims=True), 1e-300)
    assert seen[:120].sum() > 100
    for i in range(120):
        assert abs(np.linalg.norm(got[i]) - seen[i]) < 1e-6
    cosines = np.array([[got[i] @ got[j] for j in range(40)] for i in range(40)])
    assert np.abs(cosines - exact[:40] @ exact[:40].T).max() < 0.05
    for i in range(120, 124):
        assert not got[i].any()


def test_empty_corpus(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "i int, text string")
    model = SE.fit_semantic(none)
    assert [r.embedding for r in SE.semantic_embedding(none, model).collect()] == [[], []]


def _plain_ward(x, k):
    """Merge the pair of least cost until k clusters are left."""
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > k:
        def cost(a, b):
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        a, b = min(((i, j) for i in range(len(clusters)) for j in range(i)), key=lambda p: cost(clusters[p[0]], clusters[p[1]]))
        clusters[b] += clusters.pop(a)
    return {frozenset(c) for c in clusters}


@pytest.mark.parametrize("seed, k", [(1, 4), (2, 7), (3, 1)])
def test_small_inputs_equal_plain_ward(spark, seed, k):
    x = np.random.default_rng(seed).standard_normal((45, 3))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, embedding array<double>").repartition(4)
    rows, centres = W.hierarchical_topics(df, k)
    got = {}
    for r in rows.collect():
        got.setdefault(r.cluster, set()).add(r.i)
    assert {frozenset(g) for g in got.values()} == _plain_ward(x, k)
    sizes = {r.cluster: r["size"] for r in centres.collect()}
    assert sizes == {c: len(g) for c, g in got.items()} and list(sizes.values()) == sorted(sizes.values(), reverse=True)


def _spread(x, label):
    return sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in set(label))


def test_few_leaves_stay_near_exact_ward(spark):
    e = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/embeddings.parquet").select("vec_id", "embedding").repartition(6)
    rows = W.hierarchical_topics(e, 12, leaves=96)[0].orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows])
    exact = W.cut_tree(len(x), W.ward_merges(np.ones(len(x)), x), 12)
    ours = np.array([r.cluster for r in rows])
    print("spread against exact Ward:", _spread(x, ours) / _spread(x, exact))
    assert _spread(x, ours) < 1.15 * _spread(x, exact) and len(set(ours)) == 12


def test_nulls_copies_and_empty(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [5.0, 5.0])] + [(i, [1.0, 0.0]) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "i int, embedding array<float>").repartition(3)
    got = {r.i: r.cluster for r in W.hierarchical_topics(df, 2, leaves=8)[0].collect()}
    assert got[1] is None and got[3] == 1 and {got[i] for i in range(10, 60)} == {0} and got[2] == 0
    assert W.hierarchical_topics(df.limit(0), 3)[0].count() == 0
    assert W.hierarchical_topics(df.filter("i = 1"), 3)[1].count() == 0


def test_topics_of_texts(spark):
    rng = random.Random(3)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(4)]
    rows = [(i, " ".join(rng.choices(topics[i % 4], k=15) + rng.choices(["the", "and", "of"], k=5))) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, text string").repartition(3)
    vectors = SE.semantic_embedding(df, SE.fit_semantic(df, rank=6))
    got = {r.i: r.cluster for r in W.hierarchical_topics(vectors, 4)[0].select("i", "cluster").collect()}
    assert all(len({got[i] for i in range(k, 120, 4)}) == 1 for k in range(4)) and len(set(got.values())) == 4


def test_sparse_rows_from_arrow_tokens():
    import pyarrow as pa

    rows = pa.array([["b", "a", "b", "x"], None, [], ["x"], ["a"]], pa.list_(pa.string()))
    at, w = SE._sparse(["a", "b"], np.array([1.0, 2.0]), rows.slice(0))
    assert [np.frombuffer(x, np.int32).tolist() for x in at] == [[0, 1], [], [], [], [0]]
    assert np.allclose(np.frombuffer(w[0]), np.array([1.0, 4.0]) / np.sqrt(17)) and np.frombuffer(w[4]).tolist() == [1.0]
    assert SE._sparse(["a", "b"], np.array([1.0, 2.0]), rows.slice(4))[0] == at[4:]
