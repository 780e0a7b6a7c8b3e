"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and never a recomputation of an
iteration.  The setting is read from the session; only where it is unset (local
tests) a temporary folder is created and set.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; sets a local one only where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: a shared folder is needed on a cluster")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(path)
    return path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)


BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session does: 10,000 long texts in one would fill a worker's memory."""
    if spark.conf.get(_BATCHES, None) is None:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """A folder of named tables of one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table (lineage ends here)."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files of plans that nothing refers to."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the JVM may be gone when the process ends
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
