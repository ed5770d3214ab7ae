"""Sinks: written files of rendered records, one path per pane, append-only lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.templates import compile_template


def write_records(df: DataFrame, path: str, file: str, body: str, *, dry: bool = False) -> DataFrame:
    """Renders a file name (its last part counts) and a body per record, writes text files under a folder, and adds the path.

    Files go through Spark's writer, one folder per name, so a task that runs
    again replaces its own files; dry writes nothing.
    """
    name = F.element_at(F.split(compile_template(file, df.schema, strict=False), "/"), -1)
    d = df.withColumns({"__name": name, "__body": compile_template(body, df.schema, strict=False)})
    if not dry:
        d.select(F.col("__name").alias("name"), F.col("__body").alias("value")).write.mode("overwrite").partitionBy("name").text(path)
    return d.withColumn("path", F.concat(F.lit(path.rstrip("/") + "/"), "__name")).drop("__name", "__body")


def safe(pane: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", pane)


def pane_meta(df: DataFrame, *, stage: str) -> DataFrame:
    """Adds _pane: stage, window, number, whether it is final (a pane without word of that is)."""
    final = F.col("final") if "final" in df.columns else F.lit(True)
    return df.withColumn("_pane", F.struct(F.lit(stage).alias("stage"), "window_start", "window_end", F.col("pane_seq").alias("seq"), final.alias("final")))


def pane_sink(path: str):
    """A foreachBatch function: rows with a `pane` column go to one folder per pane; writing a pane again replaces it."""

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            own = df.withColumn("pane", F.regexp_replace("pane", r"[^A-Za-z0-9._-]+", "_"))
            own.write.mode("overwrite").partitionBy("pane").json(path)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    return write


def append_sink(path: str):
    """A foreachBatch function: one folder per epoch, so that an epoch that is written again replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").json(f"{path}/epoch={batch_id}")

    return write
