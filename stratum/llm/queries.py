"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprints, jaccard_join, licenses, packing, pii, secrets, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("places")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find_pii(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"bigint(size(filter(base, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in pii.KINDS]
    rank = F.create_map(*[F.lit(x) for k, name in enumerate(pii.KINDS) for x in (name, k)])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    ranked = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"], s["end"], s["kind"])))
    return d.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(ranked).alias("spans"), F.size(ranked).cast("bigint").alias("n_spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(_table(spark, sf_dir, "documents")).drop("class_id", "first")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["word_end"] - s["word_start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # records of three layouts in one table
    deal = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    named = [(0, "role", "role"), (0, "text", "text"), (1, "role", "role"), (1, "text", "content"), (2, "role", "from"), (2, "text", "value")]
    columns = {new: F.when(functools.reduce(Column.__or__, [deal == k for k, _, n in named if n == new]), F.col(old)) for _, old, new in named}
    return chat.read_back(chat.format_turns(chat.canonical_turns(rows.select("conv_id", "turn", *[c.alias(n) for n, c in columns.items()]))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", F.size("spans").cast("bigint").alias("n_spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_licenses, op3_pii, op4_packing, op5_jaccard_join,
        op6_token_counts, op7_decontamination, op8_chat, op9_toxicity, op10_secrets,
    )
}

ORACLE = {"op1_fingerprints": fingerprints.ORACLE}
