"""Session helpers for local runs, and the shared scratch folder of a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, app: str = "tidemark") -> SparkSession:
    """Single-process session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # small local inputs: keep one partition per core after a shuffle
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )


#: Scratch folders of local sessions whose settings name none, by application.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, purpose: str, root: str | None = None) -> str:
    """A fresh folder below ``root``, or below the one the cluster names in ``spark.checkpoint.dir``.

    Only a session inside this process may fall back to a temporary folder: on a cluster a
    machine-local path would be invisible to the other executors.
    """
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _local[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a written intermediate that nothing reads any more, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
