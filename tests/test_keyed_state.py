"""The log-structured latest-record table (R4): writes follow the batch, results equal D3 after replays, failures and late rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from coheral.operators.arena import dedup_latest_by_conv
from coheral.streaming import monitor as SM
from coheral.streaming.keyed_state import KeyedState

SCHEMA = "conversation_id string, tstamp double, ord long, text string"


def _batch(spark, rng, n, keys, start):
    rows = [(f"c{rng.randrange(keys)}", float(rng.randrange(50)), start + i, f"t{start + i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def _latest(rows):
    out = {}
    for k, t, o, x in rows:
        if k not in out or (t, o) >= out[k][:2]:
            out[k] = (t, o, x)
    return sorted((k, *v) for k, v in out.items())


def _state(spark, path, **more):
    return KeyedState(spark, path, "conversation_id", ("tstamp", "ord"), **({"buckets": 4, "ratio": 3} | more))


def _read(state):
    return sorted(tuple(r) for r in state.read().select("conversation_id", "tstamp", "ord", "text").collect())


def test_equals_the_batch_operator_with_late_rows_and_replays(spark, scratch):
    rng, everything, path = random.Random(1), [], os.path.join(scratch, "s")
    for b in range(8):
        rows, df = _batch(spark, rng, 40, 25, b * 100)
        everything += rows
        assert _state(spark, path).upsert(df, b)
        assert not _state(spark, path).upsert(df, b)          # a replay of the same batch
        assert not _state(spark, path).upsert(df, 0)          # and of an older one
        assert _read(_state(spark, path)) == _latest(everything)
    batch = dedup_latest_by_conv(spark.createDataFrame(everything, SCHEMA), "conversation_id", ("tstamp", "ord"))
    assert sorted(tuple(r) for r in batch.select("conversation_id", "tstamp", "ord", "text").collect()) == _latest(everything)
    assert max(r["rows"] for r in _state(spark, path).manifest()["runs"]) >= 20  # levels were merged


def test_bytes_written_follow_the_batch_over_a_large_base(spark, scratch):
    path = os.path.join(scratch, "s")
    state = _state(spark, path, ratio=4)
    base = spark.range(60_000).select(F.concat(F.lit("c"), "id").alias("conversation_id"), F.lit(0.0).alias("tstamp"),
                                      F.col("id").alias("ord"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    state.upsert(base, 0)
    base_run = state.manifest()["runs"][0]
    seen, written = {base_run["name"]}, 0
    for b in range(1, 21):
        state.upsert(spark.range(b * 7, b * 7 + 60).select(F.concat(F.lit("c"), "id").alias("conversation_id"), F.lit(float(b)).alias("tstamp"),
                                                           F.col("id").alias("ord"), F.lit(f"batch {b}").alias("text")), b)
        runs = state.manifest()["runs"]
        assert base_run["name"] in {r["name"] for r in runs}  # the base is never rewritten
        written += sum(r["bytes"] for r in runs if r["name"] not in seen)
        seen |= {r["name"] for r in runs}
    assert written < base_run["bytes"] / 4 and len(state.manifest()["runs"]) <= 8
    now = {r.conversation_id: r for r in state.read().collect()}
    assert len(now) == 60_000 and now["c150"].tstamp == 20.0 and now["c20"].tstamp == 2.0 and now["c59999"].tstamp == 0.0


def test_failed_writes_stay_invisible_and_are_repeated(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "s")
    first, df = _batch(spark, random.Random(2), 20, 10, 0)
    second, df2 = _batch(spark, random.Random(3), 20, 10, 100)
    _state(spark, path).upsert(df, 0)
    broken = _state(spark, path)
    monkeypatch.setattr(broken, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        broken.upsert(df2, 1)
    assert _read(_state(spark, path)) == _latest(first)
    assert _state(spark, path).upsert(df2, 1)
    assert _read(_state(spark, path)) == _latest(first + second)
    listed = {r["name"] for v in _state(spark, path)._versions() for r in _state(spark, path).manifest(v)["runs"]}
    assert {n for n in os.listdir(path) if n.startswith("run-")} == listed  # what the failed one left is gone


def test_ties_nulls_and_empty_batches(spark, scratch):
    state = KeyedState(spark, os.path.join(scratch, "s"), "conversation_id", ("tstamp",), buckets=2)
    with pytest.raises(ValueError):
        state.read()
    assert not state.upsert(spark.createDataFrame([], SCHEMA), 0)
    state.upsert(spark.createDataFrame([("a", 1.0, 1, "old"), (None, 1.0, 2, "no key"), ("a", 1.0, 1, "old"), ("b", None, 3, "no time")], SCHEMA), 1)
    state.upsert(spark.createDataFrame([("a", 1.0, 0, "later batch"), ("b", 0.5, 4, "timed"), ("c", 2.0, 5, None)], SCHEMA), 2)
    state.upsert(spark.createDataFrame([("c", 1.0, 6, "late"), (None, 3.0, 7, "no key again")], SCHEMA), 3)
    got = {r.conversation_id: r.text for r in state.read().collect()}
    assert got == {"a": "later batch", "b": "timed", "c": None, None: "no key again"}


def test_lookup_reads_only_the_keys_buckets(spark, scratch):
    state = KeyedState(spark, os.path.join(scratch, "s"), "conversation_id", ("tstamp", "ord"), buckets=16)
    rows, df = _batch(spark, random.Random(5), 400, 300, 0)
    state.upsert(df, 0)
    more, df2 = _batch(spark, random.Random(6), 50, 300, 1000)
    state.upsert(df2, 1)
    keys = [rows[0][0], more[0][0], "absent"]
    found = state.lookup(spark.createDataFrame([(k,) for k in keys], "conversation_id string"))
    assert sorted(r.conversation_id for r in found.collect()) == sorted(set(keys[:2]))
    assert sorted((r.conversation_id, r.tstamp, r.ord, r.text) for r in found.collect()) == [
        x for x in _latest(rows + more) if x[0] in keys]
    assert "PartitionFilters: [_bucket" in found._jdf.queryExecution().executedPlan().toString()


def test_stream_restarts_where_it_stopped(spark, scratch):
    source, table, ck = (os.path.join(scratch, x) for x in ("in", "table", "ck"))
    rng, everything = random.Random(7), []
    for b in range(3):
        rows, df = _batch(spark, rng, 30, 12, b * 100)
        everything += rows
        df.coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
        query, _ = SM.stream_dedup_chats(stream, order=("tstamp", "ord"), table_dir=table, checkpoint=ck)
        query.awaitTermination()
        got = SM.latest_version(spark, table, SCHEMA).select("conversation_id", "tstamp", "ord", "text").collect()
        assert sorted(tuple(r) for r in got) == _latest(everything)
