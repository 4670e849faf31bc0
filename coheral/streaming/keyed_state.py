"""Latest record per key as a log-structured Parquet table.

A batch is reduced to one row per key, hashed into ``buckets`` folders, and written as a
run of its own; nothing that is there already is read or rewritten.  A manifest (one small
JSON file per version, published by a rename) lists the runs; what it doesn't list isn't visible, so a
failed batch leaves no trace and a replayed one is skipped by its number.  Runs are kept in levels by
their number of rows (powers of ``ratio``); when a level has ``ratio`` runs they are merged into
one, so a row is rewritten once per level at most and a large base stays where it is.
Readers merge the runs by key.

Which record is the latest: the greatest ``order`` values; late rows (smaller ones) never
replace anything; with equal values the later batch wins, and inside a batch the row
whose JSON text hashes highest.  Rows without a key are one record.

One writer at a time, as with any streaming query.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coheral.operators.joins import first_per_key
from coheral.session import fs_bytes, fs_delete, fs_list_names, fs_publish, fs_read_text

BATCH, BUCKET = "_batch", "_bucket"


class KeyedState:
    def __init__(self, spark: SparkSession, path: str, key: str | None = None, order: tuple[str, ...] = (),
                 buckets: int = 64, ratio: int = 4):
        """Open the table at ``path``; ``key``, ``order``, ``buckets`` and ``ratio`` are those of its first version, if it has one."""
        self.spark, self.path = spark, path.rstrip("/")
        now = self.manifest()
        self.key, self.order = (now["key"], tuple(now["order"])) if now else (key, tuple(order))
        self.buckets, self.ratio = (now["buckets"], now["ratio"]) if now else (buckets, ratio)

    # ---------------------------------------------------------------- manifests
    def _versions(self) -> list[int]:
        names = fs_list_names(self.spark, f"{self.path}/_manifests")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The given or the newest version's manifest; None before the first batch."""
        versions = self._versions() if version is None else [version]
        return json.loads(fs_read_text(self.spark, f"{self.path}/_manifests/{versions[-1]:012d}.json")) if versions else None

    def _publish(self, runs: list[dict], batch: int, version: int) -> None:
        text = json.dumps({"version": version, "batch": batch, "key": self.key, "order": self.order,
                           "buckets": self.buckets, "ratio": self.ratio, "runs": runs})
        if not fs_publish(self.spark, f"{self.path}/_manifests/{version:012d}.json", text):
            raise RuntimeError(f"{self.path}: version {version} was written by someone else")

    # --------------------------------------------------------------------- runs
    def _write_run(self, rows: DataFrame) -> dict:
        name = f"run-{uuid.uuid4().hex}"
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        written = [x for x in fs_list_names(self.spark, f"{self.path}/{name}") if x.startswith(f"{BUCKET}=")]
        n = self.spark.read.parquet(f"{self.path}/{name}").count() if written else 0  # from the footers
        level = 0
        while self.ratio ** (level + 1) <= n:
            level += 1
        return {"name": name, "rows": n, "bytes": fs_bytes(self.spark, f"{self.path}/{name}"), "level": level}

    def _rows(self, runs: list[dict]) -> DataFrame:
        """All runs' rows; a run's bucket is a partition column, so filters on it skip files."""
        frames = [self.spark.read.parquet(f"{self.path}/{r['name']}") for r in runs]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def _merged(self, runs: list[dict]) -> DataFrame:
        rows = self._rows(runs)
        return rows if len(runs) == 1 else first_per_key(rows, [self.key], [*self.order, BATCH], last=True, unique_order=True)

    # ---------------------------------------------------------------- interface
    def upsert(self, batch: DataFrame, batch_id: int) -> bool:
        """Add a batch; False if it is there already (a replay) or has no rows."""
        now = self.manifest()
        if now and batch_id <= now["batch"]:
            return False
        columns = batch.columns
        tie = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
        latest = batch.groupBy(F.col(self.key).alias("_k")).agg(F.max_by(F.struct(*columns), F.struct(*self.order, tie)).alias("r")).select("r.*")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        run = self._write_run(latest.withColumns({BATCH: F.lit(batch_id).cast("long"), BUCKET: bucket}))
        if not run["rows"]:
            fs_delete(self.spark, f"{self.path}/{run['name']}")
            return False
        self._publish((now["runs"] if now else []) + [run], batch_id, now["version"] + 1 if now else 0)
        self.compact()
        return True

    def compact(self) -> int:
        """Merge levels that have ``ratio`` runs, lowest first; returns the bytes written."""
        written = 0
        while True:
            now = self.manifest()
            full = [x for x in sorted({r["level"] for r in now["runs"]}) if sum(r["level"] == x for r in now["runs"]) >= self.ratio]
            if not full:
                break
            merge = [r for r in now["runs"] if r["level"] == full[0]]
            run = self._write_run(self._merged(merge))
            written += run["bytes"]
            self._publish([r for r in now["runs"] if r not in merge] + [run], now["batch"], now["version"] + 1)
        self.vacuum()
        return written

    def vacuum(self, keep: int = 3) -> None:
        """Drop manifests but the newest ``keep``, and runs that none of those lists (readers of older ones must be done)."""
        versions = self._versions()
        kept = {r["name"] for v in versions[-keep:] for r in self.manifest(v)["runs"]}
        for name in fs_list_names(self.spark, self.path):
            if name.startswith("run-") and name not in kept:
                fs_delete(self.spark, f"{self.path}/{name}")
        for v in versions[:-keep]:
            fs_delete(self.spark, f"{self.path}/_manifests/{v:012d}.json")

    def read(self) -> DataFrame:
        """The latest record of every key."""
        now = self.manifest()
        if not now:
            raise ValueError(f"{self.path} has no version yet")
        return self._merged(now["runs"]).drop(BATCH, BUCKET)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The latest records of the keys in ``keys`` (a column named like the table's key); reads only their buckets."""
        wanted = keys.select(self.key).distinct()
        buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).distinct().collect()]
        now = self.manifest()
        runs = self._rows(now["runs"]).filter(F.col(BUCKET).isin(buckets)).join(wanted, self.key, "left_semi")
        return first_per_key(runs, [self.key], [*self.order, BATCH], last=True, unique_order=True).drop(BATCH, BUCKET)
