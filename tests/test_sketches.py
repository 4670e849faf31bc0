"""Certified top lists equal the exact ones; sketches of days unite within their error."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from coheral.operators import sketches as SK


def _top(keys, top):
    return sorted(Counter(keys).items(), key=lambda x: (-x[1], x[0]))[:top]


@pytest.mark.parametrize("kind", ["heavy", "flat", "short"])
def test_top_lists_are_exact(spark, kind):
    rng = random.Random(4)
    if kind == "heavy":  # a few hot keys over a long tail
        keys = [f"k{int(rng.paretovariate(0.6)) % 5000}" for _ in range(20_000)]
    elif kind == "flat":  # ties everywhere: every bucket has to be counted
        keys = [f"k{i % 3000}" for i in range(6000)]
    else:
        keys = ["a", "b", "a"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, o int").repartition(4)
    got, buckets = SK.certified_top(df, "k", 10, buckets=16)
    assert [(r.k, r.n) for r in got.collect()] == _top(keys, 10)
    everything = df.select(F.pmod(F.xxhash64("k"), F.lit(1 << SK.BITS))).distinct().count()
    assert buckets < everything if kind == "heavy" else buckets == everything


def test_ties_by_first_place_and_nulls(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), (None, 4), ("c", 0)], "k string, o int")
    got, _ = SK.certified_top(df, "k", 3, F.min("o").alias("first"), ("first",))
    assert [(r.k, r.n, r["first"]) for r in got.collect()] == [(None, 2, 3), ("c", 1, 0), ("b", 1, 1)]
    assert SK.certified_top(df.limit(0), "k", 3)[0].count() == 0


def test_days_are_added_without_a_rescan(spark, scratch):
    path = os.path.join(scratch, "sketches")
    rows = spark.range(30_000).select(F.concat(F.lit("2024-01-0"), (F.col("id") % 5 + 1).cast("string")).alias("d"),
                                      (F.col("id") * 7 % 9000).alias("ip"), (F.col("id") % 20).alias("model"))
    SK.add_days(rows.filter("d < '2024-01-05'"), path, F.col("d"), ["ip", "model"])
    before = {f for f in spark.read.parquet(path).inputFiles()}
    SK.add_days(rows.filter("d = '2024-01-05'"), path, F.col("d"), ["ip", "model"])
    after = {f for f in spark.read.parquet(path).inputFiles()}
    assert before < after
    read = spark.read.schema("n bigint, ip_sketch binary, model_sketch binary, day string").parquet(path)
    for first, last in ((None, None), ("2024-01-02", "2024-01-03"), ("2024-01-05", None)):
        some = rows.filter((F.col("d") >= (first or "0")) & (F.col("d") <= (last or "9")))
        exact = some.agg(F.count("*"), F.countDistinct("ip"), F.countDistinct("model")).first()
        got = SK.distinct_over(read, ["ip", "model"], first, last).first()
        assert got.n == exact[0] and abs(got.n_ip / exact[1] - 1) < 0.05 and got.n_model == exact[2]
    assert tuple(SK.distinct_over(read, ["ip"], "2030-01-01").first()) == (0, 0)
