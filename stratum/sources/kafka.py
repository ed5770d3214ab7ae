"""Kafka: options, decoding columns, sink columns.  The connector is Spark's own package and has to be on the class path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def options(servers: str, topic: str, *, start: str = "earliest", group: str = "", max_per_trigger: int = 0) -> dict[str, str]:
    if start not in ("earliest", "latest"):
        raise ValueError("start is earliest or latest")
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start, "failOnDataLoss": "true"}
    if group:
        out["kafka.group.id"] = group
    if max_per_trigger:
        out["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return out


def read(spark: SparkSession, opts: dict[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**opts).load()


def record_id() -> Column:
    """The message's key, else topic/partition/offset."""
    return F.coalesce(F.nullif(F.col("key").cast("string"), F.lit("")), F.concat_ws("/", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")))


def decode_json(rows: DataFrame, schema: T.StructType, *, bad: str = "skip") -> DataFrame:
    parsed = F.from_json(F.col("value").cast("string"), schema, {"mode": "FAILFAST" if bad == "fail" else "PERMISSIVE"})
    d = rows.select(record_id().alias("id"), parsed.alias("x"), F.col("timestamp").alias("ingested"))
    if bad == "skip":
        d = d.where(F.col("x").isNotNull())
    return d.select("id", "ingested", *[F.col(f"x.{f}") for f in schema.names if f != "id"])


def decode_value(rows: DataFrame, field: str = "text") -> DataFrame:
    return rows.select(record_id().alias("id"), F.col("timestamp").alias("ingested"), F.col("value").cast("string").alias(field))


def encode(df: DataFrame, *, id_col: str = "id", headers: dict[str, Column] | None = None) -> DataFrame:
    """key, value and headers of a sink's messages."""
    body = F.to_json(F.struct(*[c for c in df.columns]))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value")) for k, v in (headers or {}).items()]) if headers else F.array().cast("array<struct<key:string,value:binary>>")
    return df.select(F.col(id_col).cast("string").alias("key"), body.alias("value"), pairs.alias("headers"))
