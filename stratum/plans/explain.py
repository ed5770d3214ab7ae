"""What a pipeline would cost, before a call is made.

Sources are read and pure stages run as they are, so the first model stage sees
its real records.  A model's answers are not known, so what comes after it is
projected over placeholders: as many records, with texts as long as an expected
answer.  Such outputs are tainted; so is every stage that reads them, and a
filter on them keeps all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import estimate_tokens
from ..operators import cost
from ..operators.infer import InferSpec, shared_prefix
from .models import Registry
from .pipeline import PURE, Pipeline, PipelineError, Result, Stage, _apply


@dataclass
class Explained:
    projection: cost.Projection = field(default_factory=cost.Projection)
    tainted: set[str] = field(default_factory=set)
    samples: dict[str, list[dict]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row per stage."""
        rows = [(s.stage, s.records, s.tasks, s.calls, s.prompt_tokens, s.cached_tokens, s.expected_output, s.ceiling_output, s.expected_usd, s.ceiling_usd, s.floor_seconds, s.exact) for s in self.projection.stages]
        return spark.createDataFrame(rows, "stage string, records bigint, tasks bigint, calls bigint, prompt_tokens bigint, cached_tokens bigint, expected_output bigint, ceiling_output bigint, expected_usd double, ceiling_usd double, floor_seconds double, exact boolean")


def _placeholder(spec: InferSpec, up: DataFrame) -> DataFrame:
    """What an inference stage would give, as far as it is known: its records, with stand-ins for what is answered."""
    text = F.lit("x" * (4 * cost.expected_output(spec.max_tokens)))
    if spec.schema is None:
        return up.withColumn(spec.output, text)
    stand_in = {T.StringType: F.lit("x"), T.BooleanType: F.lit(True)}
    return up.withColumns({f.name: stand_in.get(type(f.dataType), F.lit(None)).cast(f.dataType) for f in spec.schema.fields})


def explain(pipeline: Pipeline, spark: SparkSession, registry: Registry | None = None, *, broadcasts: dict | None = None, id_col: str = "id", sample: int = 3, ratio: float = cost.EXPECTED, bounds: dict[str, tuple[int, int]] | None = None) -> Explained:
    """Calls, tokens, prices and rate-limit floors of every stage in order, with a few records of each.

    bounds: for an iterating stage its rounds and the largest frontier.
    """
    plan, out, got = pipeline.compile(registry, broadcasts), Explained(), Result({}, {}, {}, {})
    for s in plan.order:
        if s.spec.get("stream"):
            raise PipelineError(f"{s.name!r} is a stream, which has no number of records to price")
        up = got.outputs[s.upstream.name] if s.upstream is not None else None
        if s.upstream is not None and s.upstream.name in out.tainted:
            out.tainted.add(s.name)
        got.outputs[s.name] = _stage(s, up, spark, registry, got, out, id_col, ratio, bounds or {})
        out.projection.stages[-1].exact = s.name not in out.tainted or s.kind == "infer" and s.upstream is not None and s.upstream.name not in out.tainted
        out.samples[s.name] = [r.asDict(recursive=True) for r in got.outputs[s.name].limit(sample).collect()]
    return out


def _stage(s: Stage, up: DataFrame | None, spark: SparkSession, registry: Registry | None, got: Result, out: Explained, id_col: str, ratio: float, bounds: dict) -> DataFrame:
    add = out.projection.stages.append
    if s.kind == "infer":
        spec: InferSpec = s.spec["spec"]
        ladder = spec.binding.candidates(registry)
        p = cost.project_infer(up, s.name, ladder[0], spec.prompt, prefix=shared_prefix(spec.prefix, spec.context), system=spec.system, max_tokens=spec.max_tokens, batch=s.options.batch, ratio=ratio, cache=s.options.cache)
        add(p)
        if p.calls > 1 and p.tasks == 1 and (spec.prefix or spec.context):
            out.warnings.append(f"{s.name}: {p.calls} calls in one task send the shared prefix uncached; a smaller batch would cache it")
        out.tainted.add(s.name)
        return _placeholder(spec, up)
    if s.kind == "reduce_ai":
        model = s.spec["binding"].candidates(registry)[0]
        key, item = s.spec["key"], F.coalesce(F.col(s.spec["item"]).cast("string"), F.lit(""))
        groups = up.groupBy(*([key] if key else [])).agg(F.count("*").alias("n"), F.avg(estimate_tokens(item)).alias("tokens"))
        # groups of one size cost the same: they are priced once, times how many there are
        sizes = groups.where("n > 0").groupBy("n").agg(F.count("*").alias("many"), F.avg("tokens").alias("tokens")).orderBy("n").collect()
        whole = cost.StageProjection(s.name, exact=False)
        for r in sizes:
            one = cost.project_reduce(r["n"], s.name, model, item_tokens=r["tokens"], fan_in=s.spec["fan_in"], ratio=ratio)
            for k in ("records", "tasks", "calls", "prompt_tokens", "expected_output", "ceiling_output", "expected_usd", "ceiling_usd", "floor_seconds"):
                setattr(whole, k, getattr(whole, k) + r["many"] * getattr(one, k))
        add(whole)
        out.tainted.add(s.name)
        text = F.lit("x" * (4 * cost.expected_output(1024, ratio)))
        keys = [F.col(key)] if key else []
        return groups.where("n > 0").select(*keys, F.concat(F.lit("agg_"), F.xxhash64(*(keys or [F.lit(0)])).cast("string")).alias("id"), text.alias(s.spec["output"]), F.col("n").alias("aggregated"))
    if s.kind == "iterate":
        rounds, bound = bounds.get(s.name, (1, 0))
        if s.name not in bounds:
            out.warnings.append(f"{s.name}: without bounds on rounds and frontiers only the first round is counted")
        n = up.count()
        p = cost.StageProjection(s.name, records=n, tasks=n + (rounds - 1) * bound, calls=n + (rounds - 1) * bound, exact=False)
        add(p)
        out.tainted.add(s.name)
        return up
    if s.kind == "filter" and s.name in out.tainted:
        df = up  # what it would keep depends on answers
    elif s.kind in (*PURE, "source", "combine", "window"):
        df = _apply(s, up, spark, registry, got, id_col)
    else:
        raise PipelineError(f"unknown kind {s.kind!r}")
    add(cost.StageProjection(s.name, records=df.count()))
    return df
