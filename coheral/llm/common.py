"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coheral.session import checkpoint_dir

SPACE_WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_remainder(key: str, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(mod))


BATCH_BYTES = 4 << 20


def modest_batches(spark: SparkSession) -> None:
    """Lower this session's Arrow batch limit: rows here are texts, which are held several times over while in work."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "2147483646b").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_slices(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of ``texts`` holding about ``limit`` characters each (one text at least)."""
    a, size = 0, 0
    for b, t in enumerate(texts):
        if b > a and size + len(t) > limit:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """SplitMix64 finaliser over a uint64 array (wraps around on purpose)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64, copy=True)
        z += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z
