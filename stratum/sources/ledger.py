"""Ledgers of findings as stores: appended to, read back as revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..storage import append, read_appended


def append_entries(entries: DataFrame, path: str, format: str = "json") -> None:
    """Adds revisions to a store of JSON lines or Parquet; several writers may append."""
    append(entries, path, format)


def read_entries(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "json") -> DataFrame:
    """The revisions of a store; one that was appended twice (by its hash) counts once."""
    return read_appended(spark, path, schema, format).where("hash is not null").dropDuplicates(["hash"])
