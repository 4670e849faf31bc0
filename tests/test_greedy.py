"""Greedy dedup over two keys (D1) against the rule, with chains, cliques and hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from coheral.operators import conversations as C
from coheral.operators.greedy import greedy_keep


def _rule(rows):
    """Kept order values: the first row left is kept, and what shares a key with it goes."""
    left, kept = sorted(rows), []
    taken_a, taken_b = set(), set()
    for o, a, b in left:
        if not (a in taken_a or b in taken_b):
            kept.append(o)
            taken_a.add(a)
            taken_b.add(b)
    return kept


def _run(spark, rows):
    kept, rounds = greedy_keep(spark.createDataFrame(rows, "o long, a string, b string"))
    return sorted(r.o for r in kept.collect()), rounds


@pytest.mark.parametrize("seed, n, groups", [(1, 80, 12), (2, 200, 150)])
def test_random_graphs(spark, seed, n, groups):
    rng = random.Random(seed)
    rows = [(o, f"a{rng.randrange(groups)}", f"b{rng.randrange(groups)}") for o in rng.sample(range(10 * n), n)]
    assert _run(spark, rows)[0] == _rule(rows)


def test_a_chain_of_ten_thousand_rows(spark):
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(10_000)]
    got, rounds = _run(spark, rows)
    assert got == _rule(rows) and len(got) == 5_000 and rounds <= 3


def test_chains_of_cliques(spark):
    twice = [(i, f"a{i // 4}", f"b{(i + 2) // 4}") for i in range(1_000)]  # every pair of keys twice
    got, rounds = _run(spark, twice)
    assert got == _rule(twice) and rounds <= 3
    threes = [(i, f"a{i // 3}", f"b{(i + 1) // 3}" if i % 3 != 1 else f"own{i}") for i in range(999)]
    got, rounds = _run(spark, threes)
    assert got == _rule(threes) and rounds <= 3


def test_a_zigzag_and_a_hot_group(spark):
    rng = random.Random(9)
    order = rng.sample(range(3_000), 600)
    rows = [(order[i], f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(600)]
    rows += [(10_000 + i, "hot", f"h{i % 50}") for i in range(400)] + [(20_000, "a0", "h7")]
    assert _run(spark, rows)[0] == _rule(rows)


def test_empty(spark):
    assert _run(spark, [])[0] == []


CHATS = "id string, ord long, plugins string, error_code int, conversations array<struct<from:string,value:string>>"


def test_reasons_and_nulls(spark):
    talk = lambda *v: [("human" if i % 2 == 0 else "gpt", x) for i, x in enumerate(v)]
    rows = [("x", 0, None, 0, talk("q", "a")), ("y", 1, None, 0, talk("q", "a")), ("y", 2, None, 0, talk("r", "b")), ("x", 3, "p", 0, talk("s", "c")),
            ("z", 4, "p", 0, talk("t", "d")), ("z", 5, None, 0, talk("t", "d")), ("x", 6, None, 1, talk("u", "e")), ("w", 7, None, 3, talk("v")),
            (None, 8, None, 0, talk("only one")), (None, 9, None, 0, talk("only one")), ("v", 10, None, 0, talk("q", None)), ("u", 11, None, 0, [])]
    df = spark.createDataFrame(rows, CHATS)
    got = {r.ord: r.reason for r in C.dedup_reasons(df).collect()}
    assert got == {0: "kept", 1: "value_duplication", 2: "kept", 3: "id_duplication", 4: "plugin", 5: "kept", 6: "too_short", 7: "blocked_words",
                   8: "kept", 9: "kept", 10: "kept", 11: "kept"}
    assert sorted(r.ord for r in C.dedup_conversations(df.filter("error_code = 0")).collect()) == [0, 2, 5, 8, 9, 10, 11]
    assert C.dedup_reasons(df.drop("error_code")).filter(F.col("ord") == 6).first().reason == "id_duplication"
