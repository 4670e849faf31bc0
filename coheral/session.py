"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # broadcast only what is provably small; everything else shuffles
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def _local_heap() -> str:
    """Local-mode heap: 60% of the container / machine memory limit, at most 16 GiB."""
    limit = None
    for f in ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes"):
        try:
            v = open(f).read().strip()
            if v.isdigit():
                limit = int(v)
                break
        except OSError:
            pass
    try:
        phys = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        limit = min(limit, phys) if limit else phys
    except (ValueError, OSError, AttributeError):
        pass
    if not limit:
        return "4g"
    mb = int(limit * 0.6 / 2**20)
    return f"{max(1024, min(mb, 16 * 1024))}m"


def get_spark(master: str | None = None, cpus: int | None = None,
              shuffle_partitions: int | None = None, app: str = "coheral",
              extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the library defaults.

    On a cluster ``master`` stays None and the launcher's settings win; locally
    ``local[cpus]`` is used with as many shuffle partitions as cores.
    """
    builder = SparkSession.builder.appName(app)
    if master is None and cpus is not None:
        master = f"local[{cpus}]"
    if master is not None:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("COHERAL_DRIVER_MEM", _local_heap()))
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is None and cpus is not None:
        shuffle_partitions = max(2 * cpus, 8)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the launcher (a shared filesystem or object
    store).  Only when it is unset -- local runs and tests -- a fresh scratch
    folder is created here.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="coheral-ckpt-", dir=os.environ.get("COHERAL_SCRATCH", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 -- core confs may be read-only at runtime
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once, so that its functions import there
    whatever folder the job was started in (same as ``--py-files`` at submit time)."""
    sc = spark.sparkContext
    if getattr(sc, "_coheral_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="coheral-pkg-"), "coheral.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    f = os.path.join(folder, n)
                    z.write(f, os.path.relpath(f, os.path.dirname(root)))
    sc.addPyFile(out)
    sc._coheral_shipped = True


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fs_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on any Hadoop-compatible filesystem (local, HDFS, object stores)."""
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def fs_list_names(spark: SparkSession, path: str) -> list[str]:
    """Child names of a directory on any Hadoop-compatible filesystem ([] when missing)."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def fs_delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def fs_publish(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place in one step (written beside, then renamed); False if ``path`` exists already."""
    p, fs = _fs(spark, path)
    if fs.exists(p):
        return False
    beside, _ = _fs(spark, f"{path}.{os.urandom(6).hex()}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return bool(fs.rename(beside, p))


def fs_read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def fs_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``."""
    p, fs = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())
