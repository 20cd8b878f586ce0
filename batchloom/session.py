"""Session helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Bytes of a batch that crosses to Python, and the default that they replace.
ARROW_BYTES, ARROW_KEY, ARROW_DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def package_on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    On hosts where that folder is missing the package must be installed or passed by --py-files.
    Batches to Python get a smaller bound in bytes, unless the session has set its own: whole texts
    stand several times in an executor's and a worker's memory.
    """
    if spark.conf.get(ARROW_KEY, None) == ARROW_DEFAULT:
        spark.conf.set(ARROW_KEY, ARROW_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, path]))
    return spark


_local: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which the driver and the executors share; deleted when the driver ends.

    Only a single local JVM may do without that setting and gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        root = _local.get(app) or _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="batchloom-"))
    path = f"{root.rstrip('/')}/batchloom/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return f"{path}/{name}"


def _release() -> None:
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # what cannot be deleted now goes with its folder
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_release)
