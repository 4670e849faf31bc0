"""The resumable sink (K6): no key lost or doubled, failures leave nothing, only batches that may hold a key are read."""

import os

import pytest
from pyspark.sql import functions as F

from coheral.sources import sinks as SK


def _rows(spark, lo, hi, batch):
    return spark.range(lo, hi).select(F.col("id"), F.concat(F.lit("v"), "id").alias("v"), F.lit(batch).alias("batch"))


def _ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).select("id").collect())


def test_overlapping_calls_write_each_key_once(spark, scratch):
    path = os.path.join(scratch, "out")
    for lo, hi, batch in ((0, 10, 0), (5, 15, 1), (0, 15, 1), (14, 30, 2), (0, 30, 0)):
        SK.checkpointed_sink(_rows(spark, lo, hi, batch), path, "id")
    assert _ids(spark, path) == list(range(30))
    new = SK.checkpointed_sink(_rows(spark, 28, 33, 2), path, "id")
    assert sorted(r.id for r in new.collect()) == [30, 31, 32]


def test_a_failed_call_leaves_nothing_and_is_repeated(spark, scratch):
    path = os.path.join(scratch, "out")
    SK.checkpointed_sink(_rows(spark, 0, 5, 0), path, "id")
    bad = _rows(spark, 0, 12, 1).withColumn("v", F.when(F.col("id") == 11, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        SK.checkpointed_sink(bad, path, "id")
    assert _ids(spark, path) == list(range(5))
    SK.checkpointed_sink(_rows(spark, 0, 12, 1), path, "id")
    assert _ids(spark, path) == list(range(12))


def test_bitmaps_without_rows_lose_no_key(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "out")
    SK.checkpointed_sink(_rows(spark, 0, 5, 0), path, "id")
    todo = _rows(spark, 3, 9, 1)
    from pyspark.sql.readwriter import DataFrameWriter

    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, p, *a, **k: (_ for _ in ()).throw(RuntimeError("lost")) if p == path else real(self, p, *a, **k))
    with pytest.raises(RuntimeError, match="lost"):
        SK.checkpointed_sink(todo, path, "id")  # its bitmap is there, its rows are not
    monkeypatch.undo()
    SK.checkpointed_sink(todo, path, "id")
    assert _ids(spark, path) == list(range(9))


def test_only_batches_that_may_hold_a_key_are_asked_for(spark, scratch):
    path = os.path.join(scratch, "out")
    for b in range(6):
        SK.checkpointed_sink(_rows(spark, b * 20, b * 20 + 20, b), path, "id")
    bits = SK._key_bits(_rows(spark, 45, 47, 9), "id").collect()
    assert "2" in SK._may_hold(spark, path, bits) and len(SK._may_hold(spark, path, bits)) <= 2
    fresh = SK._key_bits(_rows(spark, 10_000, 10_003, 9), "id").collect()
    assert len(SK._may_hold(spark, path, fresh)) <= 1
    assert SK._may_hold(spark, path, SK._key_bits(_rows(spark, 0, 120, 9), "id").collect()) == [str(b) for b in range(6)]


def test_outputs_without_bitmaps_are_read_whole(spark, scratch):
    path = os.path.join(scratch, "out")
    _rows(spark, 0, 4, 0).write.partitionBy("batch").parquet(path)
    SK.checkpointed_sink(_rows(spark, 2, 7, 1), path, "id")
    SK.checkpointed_sink(_rows(spark, 0, 8, 2), path, "id")
    assert _ids(spark, path) == list(range(8))


def test_null_batches_and_empty_calls(spark, scratch):
    path = os.path.join(scratch, "out")
    SK.checkpointed_sink(_rows(spark, 0, 3, 0).withColumn("batch", F.lit(None).cast("int")), path, "id")
    SK.checkpointed_sink(_rows(spark, 0, 0, 1), path, "id")
    SK.checkpointed_sink(_rows(spark, 0, 5, 1), path, "id")
    assert _ids(spark, path) == list(range(5))
