"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where it is unset, a local session (whose executors are this process) gets
    a folder of its own; a cluster must name one that its executors share.
    """
    have = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if have is None and not jsc.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(have or tempfile.mkdtemp(prefix="stratum-"))
    return have or jsc.getCheckpointDir().get()


#: Bytes of an Arrow batch, unless the session sets its own bound: a worker holds one at a time, and the executor's JVM one for each task.
BATCH_BYTES = 4 << 20
_BOUND, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow over batches that are bounded by bytes, however long their rows are."""
    conf = df.sparkSession.conf
    if conf.get(_BOUND, _DEFAULT).rstrip("b") == _DEFAULT:
        conf.set(_BOUND, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed now and kept in the shared folder: it is computed once and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def sampled(h: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the lowest share of its range: a sample whose size follows from the share alone."""
    return h <= F.lit(min(int((2 * share - 1) * 2.0**63), 2**63 - 1))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that was written for a while."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
