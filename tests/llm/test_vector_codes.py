"""Operator 11 against a brute-force version and its SQL form."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coheral.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error double, row int, position string"


def _brute(rows, parts=4, entries=256, rounds=4):
    """Rows (vec_id, code, error, label_error, sha), in plain Python integers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if kept:
        kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    ints = [[math.floor(float(np.float32(x)) * 1024) for x in r[1]] for r in kept]
    width = -(-len(ints[0]) // parts) if ints else 1
    cut = [[(v + [0] * (width * parts - len(v)))[p * width:(p + 1) * width] for v in ints] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for x in cut[p]:
                members.setdefault(near(p, x)[1], []).append(x)
            for k, xs in members.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[near(p, cut[p][i]) for p in range(parts)] for i in range(len(kept))]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], sha) for r, f, e in zip(kept, found, errors)), key=repr)


def _frame(spark, rows):
    return spark.createDataFrame([(a, b, c, "x", 0.5, 1, "p") for a, b, c in rows], SCHEMA).repartition(3)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _vectors(n, size, seed=0, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(size)] for _ in range(9)]
    return [(i * 3, [float(np.float32(c + rng.gauss(0, scale / 5))) for c in rng.choice(centres)], rng.choice([0, 1, 2, None])) for i in range(n)]


def test_equals_brute_force_on_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = _vectors(90, 8) + [(1, None, 1), (2, [], 1), (4, [1.0, None] * 4, 1), (5, [nan] * 8, 2), (7, [inf] + [0.0] * 7, 2), (8, [-inf] * 8, None),
                              (10, [0.0] * 8, None), (10, [0.5] * 8, 1), (10, [0.5] * 8, 1), (None, [0.25] * 8, 3), (11, [1.0] * 9, 3), (13, [-0.0001] * 8, 3)]
    got = vc.compress(_frame(spark, rows), entries=16)
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert _rows(got) == _brute(rows, entries=16)


@pytest.mark.parametrize("size, entries, scale", [(6, 256, 1.0), (3, 4, 1.0), (8, 8, 9000.0)])
def test_short_tables_odd_lengths_large_values(spark, size, entries, scale):
    rows = _vectors(40, size, 4, scale)
    assert _rows(vc.compress(_frame(spark, rows), entries=entries)) == _brute(rows, entries=entries)


def test_one_vector_holds_most_rows(spark):
    rows = [(i, [0.5, -0.5, 0.25, 0.75], 1) for i in range(300)] + _vectors(30, 4, 2)
    assert _rows(vc.compress(_frame(spark, rows), entries=8)) == _brute(rows, entries=8)


def test_extreme_values_saturate(spark):
    rows = [(1, [3e38, -3e38, 0.0, 1.0] * 2, 1), (2, [0.0] * 8, 1), (3, [1e30] * 8, 1)]
    got = vc.compress(_frame(spark, rows), entries=2).collect()
    assert len(got) == 3 and all(r.error >= 0 for r in got)


def test_empty_tables(spark):
    assert vc.compress(_frame(spark, [])).count() == 0
    assert vc.compress(_frame(spark, [(1, None, 2)])).count() == 0


def test_ties_go_to_the_lower_entry():
    best, error = vc.nearest(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [-1, 0]]))
    assert list(best) == [0, 0] and list(error) == [1, 41]


def test_only_members_that_change_entry_move(spark):
    rows, width = vc.integers(_frame(spark, _vectors(200, 8, 3)), "vec_id", "embedding", "label", 4, 1024)
    books = vc.first_codebooks(rows, 4, width, 16)
    residents, books = vc.fit(rows, books, 1)
    place = residents.withColumn("task", F.spark_partition_id())
    before = {(r.row, r.position): (r.entry, r.task) for r in place.collect()}
    after = {(r.row, r.position): (r.entry, r.task) for r in vc.migrate(residents, books).withColumn("task", F.spark_partition_id()).collect()}
    assert set(before) == set(after)
    moved = [k for k in before if before[k][0] != after[k][0]]
    assert 0 < len(moved) < len(before) // 2
    assert all(before[k][1] == after[k][1] for k in before if k not in set(moved))  # the others stay in their tasks


def test_query_equals_sql(spark):
    from coheral.llm.queries import QUERIES

    query, folder = QUERIES["op11_vector_codes"], "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    result = con.execute(query.oracle)
    names = [d[0] for d in result.description]
    got = query.fn(spark, folder)
    assert got.columns == names and _rows(got) == sorted((tuple(r) for r in result.fetchall()), key=repr)
