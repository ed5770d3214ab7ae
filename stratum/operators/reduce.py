"""Tree reduction by model calls, ordered folds, keyed groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import strip
from ..plans.models import Model, usage_columns
from ..storage import materialize


def levels(n: int, fan_in: int = 8) -> list[int]:
    """Calls of each level until one record is left; fan-in of 1 or less means 8, one record costs one call, none costs none."""
    k, out = fan_in if fan_in > 1 else 8, []
    while n > 0 and (not out or n > 1):
        n = -(-n // k)
        out.append(n)
    return out


def numbered_prompt(title: str, words: int = 0) -> Callable[[Column], Column]:
    """A prompt with its items as a numbered list, and a cap on words."""
    cap = f" Use at most {words} words." if words else ""

    def build(items: Column) -> Column:
        lines = F.transform(items, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x))
        return F.concat(F.lit(f"{title}{cap}\n"), F.array_join(lines, "\n"))

    return build


def reduce_ai(df: DataFrame, model: Model, prompt: Callable[[Column], Column], *, item: str, output: str, fan_in: int = 8, seq: str = "_seq", key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one record per key, calls): groups of consecutive records become one record each, level by level.

    `seq` is contiguous from 0 (within each key).  An empty item that is not the
    output field falls back on the output field, so upper levels read lower
    summaries.  Levels are known beforehand from one count; each group has at
    most `fan_in` items.  A record that is alone still costs one call.

    With keys each record tells how many its key has left, so that a level is a
    filter over the one before, and the plan grows by one part a level.
    """
    k = fan_in if fan_in > 1 else 8
    has_output = output in df.columns and output != item
    text = F.coalesce(F.nullif(F.col(item).cast("string"), F.lit("")), F.col(output).cast("string") if has_output else F.lit(None), F.lit(""))
    cols = [F.col(key).alias("__key")] if key else [F.lit("").alias("__key")]
    cur = df.select(*cols, F.col(seq).alias("__seq"), text.alias("__item"), F.lit(1).cast("bigint").alias("__size"))
    counts = cur.groupBy("__key").count()
    top = counts.agg(F.max("count")).first()[0] or 0
    calls, done = None, []
    depth = levels(top, k)
    # without keys the levels end when one record is left
    keyed = key is not None and len(depth) > 1
    for level, _ in enumerate(depth, 1):
        grouped = cur.groupBy("__key", F.floor(F.col("__seq") / k).alias("__group"), *(["__left"] if keyed and level > 1 else [])).agg(F.array_sort(F.collect_list(F.struct("__seq", "__item"))).alias("__rows"), F.count("*").alias("__size"))
        if keyed and level == 1:
            per_key = counts.select(F.col("__key").alias("__of"), F.col("count").alias("__left"))
            grouped = grouped.join(per_key, F.col("__key").eqNullSafe(F.col("__of"))).drop("__of")
        left = [F.ceil(F.col("__left") / k).alias("__left")] if keyed else []
        called = model.respond(grouped.withColumn("__prompt", prompt(F.transform("__rows", lambda r: r["__item"]))), "__prompt", "__answer")
        usage = usage_columns(F.col("__prompt"), F.col("__answer"), model.pricing)
        called = called.select("__key", "__group", "__size", strip(F.col("__answer")).alias("__item"), *left, *[c.alias(n) for n, c in usage.items()])
        if len(depth) > 1 or model.answer is None:
            called = materialize(called)
        made = called.select(F.col("__key").alias("key"), F.lit(level).alias("level"), F.col("__group").alias("group"), F.col("__size").alias("n_items"), *usage)
        calls = made if calls is None else calls.unionByName(made)
        cur = called.select("__key", F.col("__group").alias("__seq"), "__item", "__size", *(["__left"] if keyed else []))
        if keyed:
            done.append(cur.where("__left = 1").drop("__left"))
            cur = cur.where("__left > 1")
    cur = reduce(DataFrame.unionByName, done) if done else cur
    out = cur.select(*([F.col("__key").alias(key)] if key else []), F.concat(F.lit("agg_"), F.substring(F.sha2(F.concat_ws("|", "__key", "__item").cast("binary"), 256), 1, 16)).alias("id"), F.col("__item").alias(output), F.col("__size").alias("aggregated"))
    if calls is None:
        calls = df.sparkSession.createDataFrame([], "key string, level int, group bigint, n_items bigint, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, requests bigint, cost_usd double")
    return out, calls


def fold(df: DataFrame, value: Column, merge: Callable[[Column, Column], Column], *, seq: str = "_seq", key: str | None = None, chunk: int = 1024) -> DataFrame:
    """Ordered left fold of an associative merge: the first record seeds, nothing in gives nothing out.

    Consecutive chunks are folded in parallel, then their results in order, so
    no task holds more than a chunk.
    """
    keys = [key] if key else []
    cur = df.select(*keys, F.col(seq).alias("__seq"), value.alias("value"))
    n = df.agg(F.max(seq) + 1).first()[0] or 0
    while True:
        grouped = cur.groupBy(*keys, F.floor(F.col("__seq") / chunk).alias("__group")).agg(F.array_sort(F.collect_list(F.struct("__seq", "value"))).alias("__rows"))
        rest = F.slice("__rows", F.lit(2), F.size("__rows"))
        cur = grouped.select(*keys, F.col("__group").alias("__seq"), F.aggregate(rest, F.element_at("__rows", 1)["value"], lambda a, r: merge(a, r["value"])).alias("value"))
        n = -(-n // chunk)
        if n <= 1:
            return cur.drop("__seq")


def nearest_ranks(df: DataFrame, group: list[str], value: Column, ranks: dict[str, float]) -> DataFrame:
    """Per group the elements at int(p * (n - 1)) of its sorted values; without interpolation.  Nulls don't count.

    Equal values are counted first.  The counts are dealt by ranges of (group,
    value) and summed up range by range, so that no task sees a whole group.
    """
    counts = df.select(*group, value.alias("__v")).where("__v is not null").groupBy(*group, "__v").agg(F.count("*").alias("__n"))
    spread = materialize(counts.repartitionByRange(*group, "__v").withColumn("__part", F.spark_partition_id()))
    sums = spread.groupBy(*group, "__part").agg(F.sum("__n").alias("__sum"))
    parts = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"__before": F.coalesce(F.sum("__sum").over(parts), F.lit(0)), "__all": F.sum("__sum").over(Window.partitionBy(*group))})
    places = F.array(*[F.floor(F.lit(p) * (F.col("__all") - 1)) for p in ranks.values()])
    # only the ranges that hold a wanted place are looked into
    wanted = sums.withColumn("__places", F.filter(places, lambda k: (F.col("__before") <= k) & (k < F.col("__before") + F.col("__sum")))).where("size(__places) > 0")
    own = spread.join(wanted.drop("__places"), [*group, "__part"])
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy(*group, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("__upto", upto)
    at = lambda p: F.floor(F.lit(p) * (F.col("__all") - 1))
    hit = lambda p: (F.col("__upto") - F.col("__n") <= at(p)) & (at(p) < F.col("__upto"))
    return own.groupBy(*group).agg(*[F.max(F.when(hit(p), F.col("__v"))).alias(k) for k, p in ranks.items()])


def normalized_entropy(counts: DataFrame, group: list[str], n: str) -> DataFrame:
    """Entropy of the shares within each group over the log of how many there are; 0 for one."""
    total = counts.groupBy(*group).agg(F.sum(n).alias("__total"), F.count("*").alias("n_values"))
    p = F.col(n) / F.col("__total")
    joined = counts.join(total, group)
    return joined.groupBy(*group, "n_values").agg((-F.sum(p * F.log(p))).alias("__h")).select(*group, "n_values", F.when(F.col("n_values") > 1, F.col("__h") / F.log(F.col("n_values"))).otherwise(F.lit(0.0)).alias("entropy"))
