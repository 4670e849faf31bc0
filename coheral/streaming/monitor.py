"""Structured Streaming variants of the live arena monitor.

The reference recomputes every report from all log files every 300 seconds.
Here the append-only JSONL log directory is a streaming source; activity counts
are windowed aggregations with a watermark, cleaning is the same stateless
column logic as the batch operator, and the latest-record dedup keeps its state in a
log-structured table (``keyed_state``) that each micro-batch adds its own rows to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coheral.operators import arena as A
from coheral.session import checkpoint_dir, fs_delete, fs_exists, fs_list_names
from coheral.sources import schemas as SC
from coheral.streaming.keyed_state import KeyedState


def stream_log_source(spark: SparkSession, log_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New arena log lines from a directory tree (explicit schema, event time column ``ts``)."""
    r = spark.readStream.schema(SC.ARENA_LOG).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(log_dir).withColumn("ts", F.timestamp_seconds("tstamp"))


def stream_activity(events: DataFrame, watermark: str = "1 hour", window: str = "1 hour",
                    slide: str | None = None) -> DataFrame:
    """R2: event counts per (window, type); late rows within the watermark are still counted.

    ``window='24 hours', slide='1 hour'`` gives the rolling last-day view.
    """
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (events.withWatermark("ts", watermark).groupBy(w.alias("window"), "type")
            .agg(F.count(F.lit(1)).alias("n")))


def stream_clean_battles(events: DataFrame, exclude_models=None, ban_ips=None) -> DataFrame:
    """The batch cleaning expressions on a stream (stateless; user id = ip)."""
    c = A.clean_battles(events, exclude_models=exclude_models, ban_ips=ban_ips)
    return c.filter(F.col("reason").isNull()).drop("reason")


def _state_path(spark: SparkSession, name: str) -> str:
    return checkpoint_dir(spark).rstrip("/") + "/state/" + name


def _versions(spark: SparkSession, table_dir: str, before: int | None = None) -> list[int]:
    """Committed versions ``v=<batch id>`` of a state table (any Hadoop filesystem)."""
    vs = sorted(int(n.split("=")[1]) for n in fs_list_names(spark, table_dir) if n.startswith("v="))
    return [v for v in vs if before is None or v < before]


def _prune(spark: SparkSession, table_dir: str, keep_from: int) -> None:
    """Drop versions older than the previous one (the state tables are replaced, not appended)."""
    for v in _versions(spark, table_dir, keep_from):
        fs_delete(spark, f"{table_dir}/v={v}")


def latest_version(spark: SparkSession, table_dir: str, schema: str) -> DataFrame:
    """The newest committed version of a streaming state table, replaced or log-structured."""
    if fs_exists(spark, f"{table_dir}/_manifests"):
        return KeyedState(spark, table_dir).read()
    versions = _versions(spark, table_dir)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{table_dir}/v={versions[-1]}")


def dedup_batch_writer(table_dir: str, key: str = "conversation_id", order=("tstamp",), buckets: int = 64, ratio: int = 4):
    """``foreachBatch`` upsert keeping the latest record per key; a batch writes its own rows only."""
    def write(batch: DataFrame, batch_id: int) -> None:
        KeyedState(batch.sparkSession, table_dir, key, tuple(order), buckets, ratio).upsert(batch, batch_id)
    return write


def stream_dedup_chats(rows: DataFrame, key: str = "conversation_id", order=("tstamp",), table_dir: str | None = None,
                       trigger: dict | None = None, checkpoint: str | None = None):
    """R4 + R6: latest record per conversation maintained by a streaming upsert."""
    spark = rows.sparkSession
    table_dir = table_dir or _state_path(spark, "dedup_chats")
    ck = checkpoint or _state_path(spark, "dedup_chats_ck")
    q = (rows.writeStream.foreachBatch(dedup_batch_writer(table_dir, key, order))
         .option("checkpointLocation", ck).trigger(**(trigger or {"availableNow": True})).start())
    return q, table_dir


def start_refresh(df: DataFrame, path: str, period: str = "300 seconds", checkpoint: str | None = None):
    """Periodic refresh of a report: every trigger writes the aggregate's new state as table ``path/v=<batch id>``."""
    spark = df.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        done = _versions(spark, path, batch_id)
        if done:
            _prune(spark, path, done[-1])

    ck = checkpoint or path.rstrip("/") + "_ck"
    return (df.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", ck)
            .trigger(processingTime=period).start())
