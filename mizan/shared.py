"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch, so that a run of very long texts stays within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
_OWN: dict[str, str] = {}


def arrow_limits(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; only where neither is set and all runs in one process, as in
    tests, one of our own. A cluster must name one: RuntimeError."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="mizan-")
    return _OWN[sc.applicationId]


def allow_checkpoints(spark: SparkSession) -> None:
    """Let DataFrame.checkpoint() write to the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


_FOLDERS: list[str] = []


def own_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared folder, for what one query writes; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def _remove() -> None:
    if (sc := SparkContext._active_spark_context) is None:
        return
    for f in _FOLDERS:
        path = sc._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


atexit.register(_remove)
