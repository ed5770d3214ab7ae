"""Adaptive choice of the rung a ladder starts at: features, verdict counts, expected cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import append, read_appended

MIN_SAMPLES = 25
PROBE_RATE = 0.05
OUTPUT_SHARE = 0.25


def size_bucket(tokens: Column) -> Column:
    return F.when(tokens > 0, F.concat(F.lit("~2^"), F.floor(F.log2(tokens)).cast("string"))).otherwise("n/a")


def field_bucket(name: str, value: Column) -> Column:
    return F.when(value.isNull(), f"{name}=unset").when(value.cast("string") == "", f"{name}=empty").otherwise(F.concat(F.lit(f"{name}="), value.cast("string")))


def split_tokens(total: int, share: float = OUTPUT_SHARE) -> tuple[int, int]:
    out = int(total * share)
    return total - out, out


def price_ladder(models: list, inp: int, out: int) -> list[float]:
    return [m.pricing.cost_of(inp, out) for m in models]


def profile(attempts: DataFrame, *, stage: str = "stage", bucket: str = "bucket") -> DataFrame:
    """Accepted, rejected and started counts per stage, bucket and rung; only accepted and semantic outcomes teach.

    A task counts once as started, at the rung of its first attempt.
    """
    first = F.col("attempt") == 1
    taught = attempts.where("valid or error_class = 'semantic'")
    return taught.groupBy(stage, bucket, "rung").agg(F.count_if(F.col("valid")).alias("accepted"), F.count_if(~F.col("valid")).alias("rejected"), F.count_if(first).alias("starts"))


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """Counters add up."""
    out = profiles[0]
    for p in profiles[1:]:
        out = out.unionByName(p)
    return out.groupBy("stage", "bucket", "rung").agg(*[F.sum(c).alias(c) for c in ("accepted", "rejected", "starts")])


#: Version of a stored profile; rows of others are not read.
PROFILE_VERSION = 1
PROFILE = "stage string, bucket string, rung int, accepted bigint, rejected bigint, starts bigint"


def save_profile(counts: DataFrame, path: str) -> None:
    """Appends what a run has learned, one row per stage, bucket and rung; nothing learned adds no rows."""
    own = merge_profiles(counts).withColumn("version", F.lit(PROFILE_VERSION))
    append(own.where("accepted + rejected + starts > 0"), path, "json")


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    """The sum of all that was appended, in whatever order; torn rows and other versions are left out, no file is an empty profile."""
    rows = read_appended(spark, path, PROFILE + ", version int", "json")
    return merge_profiles(rows.where(F.col("version") == PROFILE_VERSION).drop("version"))


def decide(counts: DataFrame, prices: list[float], *, min_samples: int = MIN_SAMPLES, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Per stage and bucket: the expected cost from each rung, and the cheapest rung to start at.

    The chance that a rung's answer is accepted is the mean of its Beta posterior.
    From the top down, cost(r) = price(r) + (1 - chance(r)) * cost(r + 1); the top
    rung costs its price, there is nothing above it.  Under min_samples verdicts
    at rung 0 it stays at 0; of equal costs the lower rung is taken.
    """
    n = len(prices)
    by_rung = counts.groupBy("stage", "bucket").agg(
        *[F.coalesce(F.sum(F.when(F.col("rung") == r, F.col("accepted"))), F.lit(0)).alias(f"a{r}") for r in range(n)],
        *[F.coalesce(F.sum(F.when(F.col("rung") == r, F.col("rejected"))), F.lit(0)).alias(f"b{r}") for r in range(n)],
    )
    chance = [(F.col(f"a{r}") + alpha) / (F.col(f"a{r}") + F.col(f"b{r}") + alpha + beta) for r in range(n)]
    cost: list[Column] = [F.lit(0.0)] * n
    cost[n - 1] = F.lit(float(prices[-1]))
    for r in range(n - 2, -1, -1):
        cost[r] = F.lit(prices[r]) + (1 - chance[r]) * cost[r + 1]
    out = by_rung.select("stage", "bucket", (F.col("a0") + F.col("b0")).alias("verdicts"), F.array(*cost).alias("costs"), F.array(*chance).alias("chances"))
    best = F.array_position("costs", F.array_min("costs")).cast("int") - 1
    return out.select("stage", "bucket", "verdicts", "costs", "chances", F.when(F.col("verdicts") < min_samples, 0).otherwise(best).alias("rung"), F.when(F.col("verdicts") < min_samples, "cold").otherwise("learned").alias("why"))


def probe(key: Column, rate: float = PROBE_RATE) -> Column:
    """Whether a task is held out to start at the bottom all the same; by a hash of its key (xxhash64)."""
    return F.pmod(F.xxhash64(F.concat(F.lit("probe:"), key)), F.lit(1 << 20)) < int(rate * (1 << 20))


def start_rungs(tasks: DataFrame, decisions: DataFrame, *, key: str = "id", rate: float = PROBE_RATE) -> DataFrame:
    """Adds start_rung to tasks that have a stage and bucket."""
    d = tasks.join(decisions.select("stage", "bucket", "rung"), ["stage", "bucket"], "left")
    return d.withColumn("start_rung", F.when(probe(F.col(key).cast("string"), rate), 0).otherwise(F.coalesce("rung", F.lit(0)))).drop("rung")


def forecast(counts: DataFrame, decisions: DataFrame, prices: list[float]) -> DataFrame:
    """Per stage what a record is expected to cost and to call: with every record from rung 0 (flat), and with the chosen starts (routed).

    Buckets weigh by the records that started in them; where a stage has no
    starts at all, by their verdicts at rung 0.  Calls are a record's expected
    calls at each rung: it comes to a rung by failing all under it.  A stage
    without any weight, or a ladder of one rung, is one call at the bottom.
    """
    n = len(prices)
    weight = counts.groupBy("stage", "bucket").agg(F.sum("starts").alias("s"), F.sum(F.when(F.col("rung") == 0, F.col("accepted") + F.col("rejected")).otherwise(0)).alias("v"))
    stage = weight.groupBy("stage").agg(F.sum("s").alias("all_s"), F.sum("v").alias("samples"), F.count("*").alias("buckets"))
    d = decisions.join(weight, ["stage", "bucket"]).join(stage, "stage")
    total = F.when(F.col("all_s") > 0, F.col("all_s")).otherwise(F.col("samples"))
    d = d.withColumn("w", F.when(F.col("all_s") > 0, F.col("s")).otherwise(F.col("v")) / F.when(total > 0, total))

    def calls(start: Column) -> Column:
        """The chance to reach each rung from one."""
        reach, out = F.lit(0.0), []
        for r in range(n):
            reach = F.when(start == r, F.lit(1.0)).when(start < r, reach * (1 - F.element_at("chances", r))).otherwise(0.0) if r else F.when(start == 0, F.lit(1.0)).otherwise(0.0)
            out.append(reach)
        return F.array(*out)

    d = d.withColumns({"flat": calls(F.lit(0)), "routed": calls(F.col("rung"))})
    mean = lambda c: [F.sum(F.col("w") * F.element_at(c, r + 1)) for r in range(n)]
    d = d.groupBy("stage").agg(F.first("samples").alias("samples"), F.first("buckets").alias("buckets"), F.array(*mean("flat")).alias("flat_calls"), F.array(*mean("routed")).alias("routed_calls"))
    price = F.array(*[F.lit(float(x)) for x in prices])
    bottom = F.array(*[F.lit(1.0 if r == 0 else 0.0) for r in range(n)])
    unknown = F.element_at("flat_calls", 1).isNull() if n > 1 else F.lit(True)
    d = d.withColumns({c: F.when(unknown, bottom).otherwise(F.col(c)) for c in ("flat_calls", "routed_calls")})
    usd = lambda c: F.aggregate(F.zip_with(c, price, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return d.select("stage", "samples", "buckets", "flat_calls", "routed_calls", usd("flat_calls").alias("flat_usd"), usd("routed_calls").alias("routed_usd"))


def skip_savings(skips: DataFrame, attempts: DataFrame) -> DataFrame:
    """What routing saved: calls skipped at a model times that model's mean cost in that stage."""
    mean = attempts.groupBy("stage", "model").agg(F.avg("cost_usd").alias("mean_usd"))
    return skips.join(mean, ["stage", "model"], "left").withColumn("saved_usd", F.col("skipped") * F.coalesce("mean_usd", F.lit(0.0)))


def fair_service(arrivals: DataFrame, slots: int, aging: float = 1.0, *, most: int = 10_000) -> list[dict]:
    """Least attained service with aging, simulated over a small table (program, arrives, tasks, seconds): when each program ends.

    A driver-side simulation of the policy for a table of up to `most` programs; a
    larger one is refused.  Spark itself schedules with FAIR pools.
    """
    rows = arrivals.orderBy("arrives", "program").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} programs")
    todo = [dict(r.asDict(), left=r["tasks"], served=0.0, waited=r["arrives"], ends=None) for r in rows]
    running: list[tuple[float, int]] = []
    now = 0.0
    while any(p["left"] for p in todo) or running:
        while len(running) < slots:
            ready = [k for k, p in enumerate(todo) if p["left"] and p["arrives"] <= now]
            if not ready:
                break
            k = min(ready, key=lambda k: (todo[k]["served"] - aging * (now - todo[k]["waited"]), todo[k]["program"]))
            todo[k]["left"] -= 1
            todo[k]["served"] += todo[k]["seconds"]
            todo[k]["waited"] = now
            running.append((now + todo[k]["seconds"], k))
        later = [p["arrives"] for p in todo if p["left"] and p["arrives"] > now]
        now = min([t for t, _ in running] + later)
        for t, k in [x for x in running if x[0] <= now]:
            running.remove((t, k))
            todo[k]["ends"] = t
    return [{"program": p["program"], "seconds": p["ends"] - p["arrives"]} for p in todo]


