"""Remaining readers/writers and the external-call policies."""

import os

import pytest
from pyspark.sql import functions as F

from coheral.operators import external as X
from coheral.sources import files as FI
from coheral.sources import sinks as SK


def test_prediction_tsv_and_writer(spark, scratch):
    df = spark.createDataFrame([("g1", 1, 0, [0.1, 0.9]), ("g2", 0, 0, [0.8, 0.2])],
                               "guid string, pred int, gold int, logits array<double>")
    p = os.path.join(scratch, "preds")
    SK.write_predictions(df, p, logits="logits", n_classes=2)
    back = FI.read_prediction_tsv(spark, p)
    assert sorted((r["pred"], r["gold"]) for r in back.collect()) == [(0, 0), (1, 0)]
    words = spark.createDataFrame([("yes", "no")], "`prediction-idx` string, `real-label` string")
    SK.write_csv(words, os.path.join(scratch, "w"), sep="\t")
    got = FI.read_prediction_tsv(spark, os.path.join(scratch, "w"), label2idx={"yes": 1, "no": 0}).first()
    assert (got["pred"], got["gold"]) == (1, 0)


def test_leaderboard_csv_typing(spark, scratch):
    p = os.path.join(scratch, "lb.csv")
    with open(p, "w") as f:
        f.write("key,Model,MT-bench (score),MMLU,Link,Arena Elo rating\n")
        f.write("a,Alpha,8.987,0.864,http://a,1200\n")
        f.write("b,Beta,-,-,http://b,-\n")
    rows = {r["key"]: r for r in FI.read_leaderboard_csv(spark, p).collect()}
    assert rows["a"]["MT-bench (score)"] == pytest.approx(8.99) and rows["a"]["MMLU"] == pytest.approx(86.4)
    assert rows["a"]["Arena Elo rating"] == 1200 and rows["b"]["MMLU"] is None
    assert rows["a"]["Model"].startswith('<a target="_blank" href="http://a"')


def test_split_cache_and_pair_csv(spark, scratch):
    p = os.path.join(scratch, "cache")
    built = SK.cache_dataset(lambda: spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train")
                                                                     .otherwise("test")), p, spark)
    assert built.count() == 10
    assert FI.read_split_cache(spark, p, "test").count() == 3
    again = SK.cache_dataset(lambda: 1 / 0, p, spark)  # not rebuilt
    assert again.count() == 10
    pairs = spark.createDataFrame([("e1", "T", "ctx.", "s.", "1", "1", "", "0", "", "", "", "", "re")],
                                  "essay_id string, topic string, context string, sentence string, label string, "
                                  "R1 string, R2 string, R3 string, R4 string, R5 string, R6 string, R7 string, "
                                  "Rewrite string")
    SK.write_csv(pairs, os.path.join(scratch, "pairs"))
    det = FI.read_pair_csv(spark, os.path.join(scratch, "pairs"), "detection").first()
    assert det["label"] == 1
    rr = FI.read_pair_csv(spark, os.path.join(scratch, "pairs"), "rewriting-r").first()
    assert (rr["R1"], rr["R2"], rr["rewrite"]) == (1, None, "re")


def test_text_report(spark, scratch):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    SK.write_text_report(df, os.path.join(scratch, "rep"), "row %d: %s", "i", "s")
    assert spark.read.text(os.path.join(scratch, "rep")).first()[0] == "row 1: a"


def test_retry_policies():
    calls = {"n": 0}

    def flaky(p):
        calls["n"] += 1
        if calls["n"] < 3:
            raise RuntimeError("busy")
        return p.upper()

    assert X.RetryFixed(tries=5, sleep=0).call(flaky, "x") == "X"
    assert X.RetryFixed(tries=2, sleep=0).call(lambda p: 1 / 0, "x") == X.API_ERROR_OUTPUT
    calls["n"] = 0
    assert X.RetryBackoff(max_retries=4, initial_delay=0.0).call(flaky, "y") == "Y"
    with pytest.raises(ZeroDivisionError):
        X.RetryBackoff(max_retries=1, initial_delay=0.0).call(lambda p: 1 / 0, "y")


def test_llm_map_resume_and_errors(spark):
    df = spark.createDataFrame([(i, f"prompt {i}") for i in range(20)], "k int, p string")
    done = spark.createDataFrame([(i,) for i in range(5)], "k int")
    out = X.llm_map(df, "p", key="k", resume_from=done)
    assert out.count() == 15
    failing = X.llm_map(df, "p", fn=lambda s: 1 / 0)
    assert set(r["reply"] for r in failing.collect()) == {""}
    stub = {r["k"]: r["reply"] for r in X.llm_map(df, "p").collect()}
    assert stub[3] == X.stub_model("prompt 3")


def test_log_files_by_date_and_server(spark, scratch):
    import os
    from coheral.sources import files as FI
    for day, server in (("2024-01-02", "server1"), ("2024-01-01", "server2"), ("2024-01-02", "server0"), ("2024-01-03", "server0")):
        os.makedirs(os.path.join(scratch, server), exist_ok=True)
        open(os.path.join(scratch, server, f"{day}-conv.json"), "w").write("{}")
    names = lambda **k: ["/".join(p.split("/")[-2:]) for p in FI.list_log_files_by_date(spark, scratch, **k)]
    assert names() == ["server2/2024-01-01-conv.json", "server0/2024-01-02-conv.json", "server1/2024-01-02-conv.json", "server0/2024-01-03-conv.json"]
    assert names(max_files=2) == ["server1/2024-01-02-conv.json", "server0/2024-01-03-conv.json"]
    assert names(first="2024-01-02", last="2024-01-02") == ["server0/2024-01-02-conv.json", "server1/2024-01-02-conv.json"]


def test_log_files_are_all_read_without_a_limit(spark, scratch):
    import os
    from coheral.sources import files as FI
    n = 10_050
    for k in range(n):
        folder = os.path.join(scratch, f"server{k % 3}")
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"2024-01-{k % 28 + 1:02d}-{k}-conv.json"), "w") as f:
            f.write('{"type": "chat"}' if k < 60 else "{}")
    assert len(FI.list_log_files(spark, scratch)) == len(FI.list_log_files_by_date(spark, scratch)) == n
    assert len(FI.list_log_files(spark, scratch, max_files=7)) == len(FI.list_log_files_by_date(spark, scratch, max_files=7)) == 7
    assert FI.read_logs(spark, scratch).filter("type = 'chat'").count() == 60
    days = [k % 28 + 1 for k in range(60)]
    assert FI.read_logs(spark, scratch, first="2024-01-03", last="2024-01-04").filter("type = 'chat'").count() == sum(d in (3, 4) for d in days)


def test_split_cache_one_row_per_class(spark, scratch):
    import os
    from coheral.sources import files as FI
    path = os.path.join(scratch, "cache")
    spark.range(20).selectExpr("id AS ord", "id % 3 AS label", "IF(id < 10, 'train', 'dev') AS split").write.partitionBy("split").parquet(path)
    got = FI.read_split_cache(spark, path, "dev", one_per_class="label").collect()
    assert sorted((r.label, r.ord) for r in got) == [(0, 12), (1, 10), (2, 11)]


def test_llm_map_sends_prompts_only(spark):
    df = spark.createDataFrame([(1, "a", "p1"), (None, None, None), (3, "c", "p3")], "k int, other string, p string")
    out = X.llm_map(df, "p", fn=lambda s: s + "!")
    plan = out.select("k", "reply")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan and "other" not in plan.split("ArrowEvalPython")[0]
    assert sorted(out.collect(), key=str) == sorted([(1, "a", "p1", "p1!"), (None, None, None, None), (3, "c", "p3", "p3!")], key=str)
    many = X.llm_map(spark.range(5000).selectExpr("id", "cast(id as string) p"), "p", fn=lambda s: s, concurrency=8)
    assert all(r["reply"] == r["p"] for r in many.collect())
