"""Cutting lineage: to the folder that all executors share, never to executors alone."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a local session gets a folder of its own."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if have is None and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(have or tempfile.mkdtemp(prefix="stratum-core-"))
    return have or sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Computes a frame once, into the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def append(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Adds rows to a store, in a folder of their own: writers side by side that append to one folder would clear each other's temporary files."""
    df.write.format(format).save(f"{path}/add-{uuid.uuid4().hex}")


def read_appended(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet") -> DataFrame:
    """All that was appended; lines that can't be read are left out, no store is an empty one."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    try:
        return (reader.option("mode", "DROPMALFORMED") if format == "json" else reader).format(format).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def with_seq(df: DataFrame, *order: str, name: str = "_seq") -> DataFrame:
    """Adds a contiguous number from 0 in a global order.

    Rows are dealt by range and sorted there; partition sizes (one number per
    partition reaches the driver) give each partition its offset.  No row is
    moved to a single task.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    spread = materialize(spread)
    part = F.shiftright("__id", 33)
    sizes = sorted((r[0], r[1]) for r in spread.groupBy(part.alias("p")).count().collect())
    offsets, total = {}, 0
    for p, n in sizes:
        offsets[p], total = total, total + n
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    table = F.create_map(*[F.lit(x).cast("bigint") for kv in offsets.items() for x in kv])
    return spread.withColumn(name, table[part.cast("bigint")] + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")


def with_key_seq(df: DataFrame, key: str, *order: str, name: str = "_seq") -> DataFrame:
    """Adds a contiguous number from 0 within each key, in an order.

    Rows are numbered by (key, order) over all ranges, so a key of many rows
    is many tasks' work; a key's first number is then taken off.
    """
    spread = with_seq(df, key, *order, name="__at")
    first = spread.groupBy(F.col(key).alias("__key")).agg(F.min("__at").alias("__first"))
    return spread.join(first, F.col(key).eqNullSafe(F.col("__key"))).withColumn(name, F.col("__at") - F.col("__first")).drop("__at", "__first", "__key")
