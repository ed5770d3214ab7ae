"""Result cache by content, lineage, broadcast values."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import append, materialize, read_appended

LINEAGE = "artifact string, run_id string, stage string, op string, model string, inputs array<string>, broadcasts map<string,string>"


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def content_hash(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def fingerprint(op: dict, broadcasts: dict[str, str] | None = None, continuation: str = "", tools: list | None = None) -> str:
    """Of an operator's spec, the hashes of the broadcasts that it declares, its continuation and its tools; not of its round."""
    return content_hash({"op": op, "broadcasts": sorted((broadcasts or {}).items()), "continuation": continuation, "tools": tools or []})


def cache_key(fp: str, *cols: str) -> Column:
    """Key of a record's input under a fingerprint."""
    return F.sha2(F.concat(F.lit(fp), F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))).cast("binary"), 256)


class ResultCache:
    """An append-only Parquet table (key, stage, value columns as JSON) in a folder of a shared store.

    Hits cost nothing; misses are computed once per distinct key and appended;
    failures (null results) are not kept.  The table is read again each run.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        return read_appended(self.spark, self.path, "key string, stage string, value string")

    def apply(self, df: DataFrame, stage: str, fp: str, inputs: list[str], compute: Callable[[DataFrame], DataFrame], output: str) -> tuple[DataFrame, int, int]:
        """(records with their output, hits, misses)."""
        keyed = materialize(df.withColumn("__key", cache_key(fp, *inputs)))
        known = self.table().where(F.col("stage") == stage).dropDuplicates(["key"]).select(F.col("key").alias("__key"), "value")
        misses = materialize(keyed.join(known, "__key", "left_anti").dropDuplicates(["__key"]))
        n_miss = misses.count()
        hits = keyed.join(known, "__key", "left_semi").count()
        if n_miss:
            made = materialize(compute(misses).select("__key", F.col(output).cast("string").alias("value")).where("value is not null"))
            append(made.select(F.col("__key").alias("key"), F.lit(stage).alias("stage"), "value"), self.path)
            known = known.unionByName(made)
        return keyed.join(known, "__key", "left").withColumnRenamed("value", output).drop("__key"), hits, n_miss


class Broadcasts:
    """Named values by content hash; a stage reads only those that it declares."""

    def __init__(self):
        self.values: dict[str, object] = {}

    def register(self, name: str, value) -> str:
        self.values[name] = json.loads(canonical_json(value))
        return content_hash(value)

    def hashes(self, names: tuple[str, ...]) -> dict[str, str]:
        return {n: content_hash(self.values[n]) for n in names}

    def read(self, name: str, declared: tuple[str, ...]):
        if name not in declared:
            raise PermissionError(f"broadcast {name!r} is not declared")
        return self.values[name]


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str, *, max_bytes: int = 10_000_000) -> DataFrame:
    """Enriches by a dictionary, with a default; sent to all tasks only when its bytes are checked to be few.

    Of values that share a key the least one counts.
    """
    own = table.groupBy(key).agg(F.min(value).alias(value))
    size = F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col(value).cast("string")), F.lit(0)) + 32
    if (own.agg(F.sum(size)).first()[0] or 0) <= max_bytes:
        own = F.broadcast(own)
    return df.join(own, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def trace(lineage: DataFrame, artifact: str, max_depth: int = 50) -> DataFrame:
    """Everything that an artifact was made from, with its depth."""
    return lineage.sparkSession.sql(
        f"""WITH RECURSIVE up(artifact, depth) MAX RECURSION LEVEL {int(max_depth)} AS (
              SELECT :artifact, 0
              UNION ALL
              SELECT i.input, up.depth + 1 FROM up JOIN (SELECT artifact, explode(inputs) AS input FROM {{lineage}}) i ON i.artifact = up.artifact)
            SELECT artifact, min(depth) AS depth FROM up GROUP BY artifact""",
        args={"artifact": artifact},
        lineage=lineage,
    )
