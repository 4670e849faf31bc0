"""Operators on inputs where one key holds a third of all rows (checked against pandas)."""

import pandas as pd
from pyspark.sql import functions as F

from coheral.operators import judge as J
from coheral.operators import ordering as O
from coheral.operators.joins import first_per_key
from coheral.operators.topics import dedup_prompts

N = 30000


def _skewed(spark):
    return spark.range(N).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
        .alias("key"),
        (F.col("id") * 7919 % 1000).alias("v"))


def test_first_and_last_per_hot_key(spark):
    df = _skewed(spark)
    pdf = df.toPandas()
    first = {r["key"]: r["ord"] for r in first_per_key(df, ["key"], ["ord"]).collect()}
    last = {r["key"]: r["ord"] for r in first_per_key(df, ["key"], ["ord"], last=True).collect()}
    assert first == pdf.groupby("key")["ord"].min().to_dict()
    assert last == pdf.groupby("key")["ord"].max().to_dict()


def test_topk_on_hot_group(spark):
    df = _skewed(spark)
    got = sorted((r["key"], r["ord"]) for r in O.topk_per_group(df, ["key"], [F.desc("v"), "ord"], 3).collect())
    pdf = df.toPandas().sort_values(["key", "v", "ord"], ascending=[True, False, True])
    exp = sorted((k, o) for k, g in pdf.groupby("key") for o in g["ord"].head(3))
    assert got == exp


def test_global_rank_with_hot_key(spark):
    df = _skewed(spark)
    r = O.global_rank(df, ["key", "ord"], "pos", num_partitions=8)
    pdf = df.toPandas().sort_values(["key", "ord"]).reset_index(drop=True)
    got = {row["ord"]: row["pos"] for row in r.collect()}
    assert got == {o: i for i, o in enumerate(pdf["ord"])}


def test_dedup_prompts_with_hot_duplicate(spark):
    df = _skewed(spark).select("ord", F.when(F.col("key") == "hot", F.lit("Same, prompt!"))
                               .otherwise(F.concat(F.lit("p "), F.col("ord").cast("string"))).alias("text"))
    kept = {r["ord"] for r in dedup_prompts(df, "text", "ord").collect()}
    assert 0 in kept and 3 not in kept and len(kept) == N - (N // 3 - 1)


def test_agreement_with_hot_game(spark):
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        rows.append((i, 1 if hot else i % 50 + 2, "m0", "m1", ["model_a", "model_b", "tie"][i % 3 if not hot else i % 2],
                     "author_0" if i % 10 == 0 else f"expert_{i % 5 + 1}", 1))
    df = spark.createDataFrame(rows, "ord long, question_id long, model_a string, model_b string, winner string, "
                                     "judge string, turn int")
    got = {(r["with_tie"], r["pair"]): (r["agree"], r["total"]) for r in J.judge_agreement(df).collect()}
    pdf = pd.DataFrame(rows, columns=["ord", "q", "a", "b", "w", "judge", "turn"])
    pdf["cls"] = pdf["w"].where(~pdf["w"].str.contains("tie"), "tie")
    pdf["grp"] = pdf["judge"].str.startswith("expert").map({True: "human", False: "author"})
    hh_agree = hh_total = 0
    for _, g in pdf[pdf["grp"] == "human"].groupby("q"):
        n = len(g)
        hh_total += n * (n - 1) // 2
        hh_agree += sum(c * (c - 1) // 2 for c in g["cls"].value_counts())
    assert got[(True, "human_vs_human")] == (hh_agree, hh_total)


def test_first_per_key_ties_give_one_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), (None, 5, "n"), (None, 5, "n")], "key string, ord int, v string")
    got = first_per_key(df, ["key"], ["ord"]).collect()
    assert sorted((r["key"] or "", r["ord"]) for r in got) == [("", 5), ("a", 1)]
