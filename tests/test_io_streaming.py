"""Readers, writers and the streaming monitor (availableNow runs compared with the batch operators)."""

import json
import os

from pyspark.sql import functions as F

from coheral.operators import arena as A
from coheral.operators import ratings as R
from coheral.sources import files as FI
from coheral.sources import fixtures as fx
from coheral.sources import sinks as SK
from coheral.sources.tables import Tables
from coheral.streaming import monitor as SM
from tests.conftest import SMALL


def _write_log_days(spark, out_dir):
    """The arena_log fixture as JSONL files, one per day (the reference's log layout)."""
    log = fx.arena_log(Tables(spark, SMALL))
    day = F.date_format(F.timestamp_seconds("tstamp"), "yyyy-MM-dd")
    (log.withColumn("day", day).repartition(1, "day").write.partitionBy("day").mode("overwrite").json(out_dir))
    return log


def test_csv_and_jsonl_roundtrip(spark, scratch):
    df = spark.createDataFrame([("e1", "P1", "A. B, \"quoted\".\nNew line."), ("e2", "P2", "C.")],
                               "Filename string, Prompt string, corrected_essay string")
    SK.write_csv(df, os.path.join(scratch, "essays"))
    back = FI.read_essay_csv(spark, os.path.join(scratch, "essays"))
    assert sorted(r["text"] for r in back.collect()) == sorted(r["corrected_essay"] for r in df.collect())

    lines = [{"question_id": i, "category": "math" if i % 2 else "writing", "turns": [f"q{i}"]} for i in range(25)]
    p = os.path.join(scratch, "q.jsonl")
    with open(p, "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    sl = FI.read_jsonl(spark, p, begin=5, end=12).orderBy("ord").collect()
    assert [r["question_id"] for r in sl] == list(range(5, 12))


def test_answers_dir_last_line_wins(spark, scratch):
    d = os.path.join(scratch, "answers")
    os.makedirs(d)
    for model in ("alpha", "beta"):
        with open(os.path.join(d, f"{model}.jsonl"), "w") as f:
            for k in range(3):
                f.write(json.dumps({"question_id": 1, "answer_id": f"{model}{k}", "model_id": model,
                                    "choices": [{"index": 0, "turns": [f"v{k}"]}], "tstamp": 1.0}) + "\n")
    got = {r["model"]: r["answer_id"] for r in FI.read_answers_dir(spark, d).collect()}
    assert got == {"alpha": "alpha2", "beta": "beta2"}


def test_checkpointed_sink_resumes(spark, scratch):
    path = os.path.join(scratch, "sink")
    a = spark.range(0, 10).withColumn("batch", F.lit(0))
    SK.checkpointed_sink(a, path, "id")
    b = spark.range(5, 15).withColumn("batch", F.lit(1))
    written = SK.checkpointed_sink(b, path, "id")
    assert sorted(r["id"] for r in written.collect()) == list(range(10, 15))
    assert spark.read.parquet(path).count() == 15
    again = spark.range(0, 20).withColumn("batch", F.lit(1))   # resumed under the same batch number
    SK.checkpointed_sink(again, path, "id")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(20))


def test_render_table_and_metric_report(spark, scratch):
    df = spark.createDataFrame([(0.5, 0.25)], "precision_macro double, recall_macro double")
    SK.write_table(df, os.path.join(scratch, "md"))
    lines = [r["value"] for r in spark.read.text(os.path.join(scratch, "md")).collect()]
    assert sorted(lines) == sorted(["| precision_macro | recall_macro |", "|---|---|", "| 0.5 | 0.25 |"])
    html = [r["value"] for r in SK.render_table(spark.createDataFrame([("a<b", None)], "x string, y int"), html=True).collect()]
    assert html == ["<tr><th>x</th><th>y</th></tr>", "<tr><td>a&lt;b</td><td></td></tr>"]
    SK.write_metric_report(df, os.path.join(scratch, "rep"))
    back = {(r["metric"], r["average"]): r["value_x100"] for r in FI.read_metric_report(spark, os.path.join(scratch, "rep")).collect()}
    assert back == {("precision", "macro"): 50, ("recall", "macro"): 25}


def test_log_file_listing_and_scans(spark, scratch):
    d = os.path.join(scratch, "logs")
    _write_log_days(spark, d)
    files = FI.list_log_files(spark, d, pattern="*.json", max_files=3)
    assert 1 <= len(files) <= 3
    votes = FI.scan_votes(spark, d)
    assert set(r["type"] for r in votes.select("type").distinct().collect()) <= set(A.VOTE_TYPES)


def test_stream_activity_matches_batch(spark, scratch):
    d = os.path.join(scratch, "logs")
    log = _write_log_days(spark, d)
    ev = SM.stream_log_source(spark, d, max_files_per_trigger=2)
    agg = SM.stream_activity(ev, watermark="1 hour", window="1 day")
    q = (agg.writeStream.format("memory").queryName("act_test").outputMode("update")
         .option("checkpointLocation", os.path.join(scratch, "ck_act")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT window.start AS w, type, max(n) AS n FROM act_test GROUP BY 1, 2")
    exp = log.groupBy(F.window(F.timestamp_seconds("tstamp"), "1 day").start.alias("w"), "type").count()
    a = sorted((str(r["w"]), r["type"], r["n"]) for r in got.collect())
    b = sorted((str(r["w"]), r["type"], r["count"]) for r in exp.collect())
    assert a == b


def test_stream_refresh_replaces_its_table(spark, scratch):
    d, path = os.path.join(scratch, "logs"), os.path.join(scratch, "report")
    log = _write_log_days(spark, d)
    ev = SM.stream_log_source(spark, d)
    q = SM.start_refresh(ev.groupBy("type").agg(F.count(F.lit(1)).alias("n")), path, period="1 second")
    q.processAllAvailable()
    q.stop()
    got = {r["type"]: r["n"] for r in SM.latest_version(spark, path, "type string, n bigint").collect()}
    assert got == {r["type"]: r["count"] for r in log.groupBy("type").count().collect()}


def test_stream_dedup_matches_batch(spark, scratch):
    d = os.path.join(scratch, "logs")
    log = _write_log_days(spark, d)
    ev2 = SM.stream_log_source(spark, d, max_files_per_trigger=3)
    rows = ev2.filter(F.col("type") == "chat").select(F.col("states")[0]["conv_id"].alias("conversation_id"),
                                                      "tstamp", F.col("states")[0]["model_name"].alias("model"))
    q2, table = SM.stream_dedup_chats(rows, table_dir=os.path.join(scratch, "dedup"),
                                      checkpoint=os.path.join(scratch, "ck_dd"))
    q2.awaitTermination()
    got2 = {r["conversation_id"]: r["tstamp"] for r in SM.latest_version(spark, table, "conversation_id string, tstamp double").collect()}
    b2 = log.filter(F.col("type") == "chat").groupBy(F.col("states")[0]["conv_id"].alias("c")).agg(F.max("tstamp").alias("t"))
    assert got2 == {r["c"]: r["t"] for r in b2.collect()}


def test_stream_clean_battles_matches_batch(spark, scratch):
    d = os.path.join(scratch, "logs")
    log = _write_log_days(spark, d)
    ev = SM.stream_log_source(spark, d, max_files_per_trigger=3)
    cleaned = SM.stream_clean_battles(ev, ban_ips=["3"]).select("model_a", "model_b", "winner", "tstamp")
    q = (cleaned.writeStream.format("memory").queryName("clean_test").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ck_clean")).trigger(availableNow=True).start())
    q.awaitTermination()
    batch = A.clean_battles(log, ban_ips=["3"]).filter(F.col("reason").isNull()).select("model_a", "model_b", "winner", "tstamp")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM clean_test").collect())
    assert got and got == sorted(tuple(r) for r in batch.collect())
