"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package assumes.  AQE re-plans joins at run
# time (size-checked broadcast, skew-split, partition coalescing); the
# session clock is UTC so date literals and `as_of` mean the same thing on
# every executor.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    # PySpark 4 records the Python call site of every Column it builds (for
    # error messages); that costs several JVM round trips per expression and
    # dominates plan construction of wide reports.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "shoplens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is used as is.
    Only when it is unset (unit tests, a laptop) do we set a private one.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # core config, not settable at run time: give the context a folder
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shoplens-ckpt-"))
        path = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written inside go when the write is done, not when
    the driver next collects garbage: until then they would fill the executors' disks.
    For writes that nothing else reads the shuffles of."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works for
    local, HDFS and object stores alike)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory())


def rename_folder(spark: SparkSession, private: str, public: str) -> None:
    """Publish a folder by one rename.  If another writer was first, its folder
    stays and ours is deleted."""
    jvm = spark._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(private), jvm.org.apache.hadoop.fs.Path(public)
    fs = src.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(dst) and fs.rename(src, dst):
        return
    if not fs.exists(dst):
        raise RuntimeError(f"could not publish {public}")
    fs.delete(src, True)


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match ``pattern``, in order (none: an empty list)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(str(s.getPath().toString()) for s in found)


def touch(spark: SparkSession, path: str) -> None:
    """An empty marker file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared checkpoint folder, read again, and its
    path (:func:`delete_folder` when it is no longer needed)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/shoplens-stored/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
