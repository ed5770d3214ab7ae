"""Growing contexts: immutable chains of segments, rendering with spans, what a revision retains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_id(name: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", name, body).cast("binary"), 256)


def rendered(name: Column, body: Column, style: str = "tags") -> Column:
    if style == "tags":
        return F.concat(F.lit("<"), name, F.lit(">\n"), body, F.lit("\n</"), name, F.lit(">\n"))
    return F.concat(body, F.lit("\n"))


def spans(segments: DataFrame, *, key: str = "key", seq: str = "seq", name: str = "name", body: str = "body", style: str = "tags") -> DataFrame:
    """Each segment's bytes [start, end) in its context's text, and how many bytes the text has up to there; spans tile the text."""
    size = F.octet_length(rendered(F.col(name), F.col(body), style)).cast("bigint")
    upto = F.sum("size").over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumn("size", size).withColumn("end", upto).withColumn("start", F.col("end") - F.col("size"))


def texts(segments: DataFrame, *, key: str = "key", seq: str = "seq", name: str = "name", body: str = "body", style: str = "tags") -> DataFrame:
    """The whole text of each context, in order."""
    piece = rendered(F.col(name), F.col(body), style)
    own = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), piece.alias("t"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(own, lambda r: r["t"]), "").alias("text"), F.count("*").alias("n_segments"))


def chain_hash(segments: DataFrame, *, key: str = "key", seq: str = "seq", name: str = "name", body: str = "body") -> DataFrame:
    """Per context the hash of its chain: each segment hashed onto what came before."""
    own = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), segment_id(F.col(name), F.col(body)).alias("h"))))
    step = lambda a, r: F.sha2(F.concat(a, r["h"]).cast("binary"), 256)
    return segments.groupBy(key).agg(F.aggregate(own, F.lit(""), step).alias("chain"))


def common_prefix(old: DataFrame, new: DataFrame, *, key: str = "key", seq: str = "seq", name: str = "name", body: str = "body") -> DataFrame:
    """Per key of the new context: leading segments that are as in the old one, and the bytes kept and written anew."""
    a = old.select(F.col(key).alias("k"), F.col(seq).alias("s"), segment_id(F.col(name), F.col(body)).alias("old_id"))
    b = new.select(F.col(key).alias("k"), F.col(seq).alias("s"), segment_id(F.col(name), F.col(body)).alias("new_id"), F.octet_length(rendered(F.col(name), F.col(body))).cast("bigint").alias("size"))
    j = b.join(a, ["k", "s"], "left").withColumn("differs", ~F.coalesce(F.col("old_id") == F.col("new_id"), F.lit(False)))
    first = F.min(F.when(F.col("differs"), F.col("s"))).over(Window.partitionBy("k"))
    j = j.withColumn("kept", F.col("s") < F.coalesce(first, F.lit(1 << 62)))
    return j.groupBy(F.col("k").alias(key)).agg(F.count_if("kept").alias("prefix_segments"), F.sum(F.when(F.col("kept"), F.col("size")).otherwise(0)).alias("retained_bytes"), F.sum(F.when(F.col("kept"), 0).otherwise(F.col("size"))).alias("repaired_bytes"))


def verified(certificate: Column, base_bytes: Column, retained: Column, repaired: Column) -> Column:
    """A certificate holds where its parts add up to its whole."""
    return (retained >= 0) & (repaired >= 0) & (retained <= base_bytes) & (certificate == retained + repaired)


def delta_route(base: Column, change: Column, resident: Column, max_bytes: int = 32 * 1024, max_share: float = 0.5) -> Column:
    """splice a small change onto a resident base, else rebuild."""
    return (
        F.when(~resident, "rebuild:absent")
        .when(change > max_bytes, "rebuild:large")
        .when(change > base * max_share, "rebuild:share")
        .otherwise("splice")
    )
