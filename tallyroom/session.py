"""Session settings the operators assume, and the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # Call sites of column expressions; costly for plans built by a library.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tallyroom")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions), **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="tallyroom-")
    return _LOCAL_FOLDERS[context.applicationId]


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder. Results are read from it lazily, so it stays
    until ``release_scratch``."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete what this application has written to scratch paths, once its results are
    stored elsewhere or no longer needed. Gives the number of paths that were there."""
    context, gone = spark.sparkContext, 0
    for path in _SCRATCH.pop(context.applicationId, []):
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True))
    return gone
