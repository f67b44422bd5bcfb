"""Session helpers: a local session for tests/bench and the shared folder."""

from __future__ import annotations

import atexit
import hashlib
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "quarry") -> SparkSession:
    """A local session configured the way tests and the bench expect."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A runtime setting of the session for the queries inside only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder for materialised tables (indexes, cut lineage).

    Uses ``spark.checkpoint.dir`` as named by the cluster.  Where it is unset,
    a local master gets a folder below the warehouse directory, registered as
    the checkpoint directory; on a cluster that folder could be on each
    machine's own disk, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wh = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        d = wh.rstrip("/") + "/quarry-checkpoints"
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_temporary: list[tuple[SparkSession, str]] = []


def temporary_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the process ends."""
    path = scratch_path(spark, name)
    _temporary.append((spark, path))
    return path


@atexit.register
def _remove_temporary() -> None:
    for spark, path in _temporary:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended
            pass


def _matches(spark: SparkSession, path: str):
    """Files and folders that a path or glob names, by Hadoop's FileSystem, so
    on any store and with the default file system for a bare path."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, list(fs.globStatus(jpath) or [])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist, or the glob match anything?"""
    return bool(_matches(spark, path)[1])


def file_heads(spark: SparkSession, path: str, size: int = 256):
    """``(file, its first bytes)`` of the files at a path, a folder or a glob,
    by name; marker files (``_`` or ``.``) are left out."""
    fs, found = _matches(spark, path)
    names = []
    for status in found:
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            p = files.next().getPath()
            if not p.getName().startswith(("_", ".")):
                names.append(p.toString())
    for name in sorted(names):
        stream = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name))
        try:
            yield name, bytes(stream.readNBytes(size))
        finally:
            stream.close()


def source_key(spark: SparkSession, path: str) -> str:
    """Hash of names, lengths and times of all files below ``path``: changed
    data under one path has another key.  File metadata only."""
    fs, found = _matches(spark, path)
    rows = []
    for status in found:
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            f = files.next()
            rows.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(rows)).encode()).hexdigest()[:16]
