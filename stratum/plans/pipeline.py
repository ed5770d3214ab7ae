"""Pipelines: named stages over records, compiled to DataFrames.

A stage has at most one upstream stage; deriving twice from a stage branches.
`compile` checks names, templates, bindings and options and gives each stage its
fingerprint; `run` turns the plan to DataFrames.  Pure stages are Column
expressions, so chains of them are one stage for Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cache import content_hash
from ..operators.cache import fingerprint as make_fingerprint
from ..operators.graph import Iterated
from ..operators.infer import InferSpec, infer
from ..operators.reduce import fold, reduce_ai
from ..operators.windows import WindowSpec, panes
from ..storage import with_key_seq, with_seq
from .models import Binding, Registry

PURE = ("map", "filter", "flatmap")


class PipelineError(ValueError):
    """A pipeline that can't be compiled or run."""


@dataclass(frozen=True)
class Options:
    parallelism: int = 0
    batch: int = 1
    version: str = ""
    cache: bool = True
    broadcasts: tuple[str, ...] = ()
    grants: tuple[str, ...] = ()
    sandbox: str = "inline"


@dataclass
class Stage:
    name: str
    kind: str
    upstream: Stage | None
    spec: dict = field(default_factory=dict)
    options: Options = field(default_factory=Options)


@dataclass
class Plan:
    order: list[Stage]
    children: dict[str, list[str]]
    fingerprints: dict[str, str]
    fused: list[list[str]]

    def terminals(self) -> list[str]:
        return [s.name for s in self.order if not self.children[s.name]]


@dataclass
class Result:
    outputs: dict[str, DataFrame]
    attempts: dict[str, DataFrame]
    failures: dict[str, DataFrame]
    iterations: dict[str, Iterated]

    def output(self, plan: Plan) -> DataFrame:
        """Of the only terminal stage."""
        ends = plan.terminals()
        if len(ends) != 1:
            raise PipelineError(f"terminal stages: {ends}")
        return self.outputs[ends[0]]


class Dataset:
    """A handle to a stage's output."""

    def __init__(self, pipeline: Pipeline, stage: Stage):
        self.pipeline, self.stage = pipeline, stage

    def _then(self, name: str, kind: str, options: Options | None = None, **spec) -> Dataset:
        return self.pipeline._add(Stage(name, kind, self.stage, spec, options or Options()))

    def map(self, name: str, columns: Callable[[DataFrame], dict[str, Column]] | dict[str, Column], options: Options | None = None) -> Dataset:
        return self._then(name, "map", options, columns=columns)

    def map_batches(self, name: str, func: Callable, schema: T.StructType | str, options: Options | None = None) -> Dataset:
        """An Arrow function over batches, for what Columns can't say."""
        return self._then(name, "map", options, func=func, schema=schema)

    def filter(self, name: str, cond: Column | Callable[[DataFrame], Column], strict: bool = False, options: Options | None = None) -> Dataset:
        """Rows where the condition is true; strict makes a null condition an error."""
        return self._then(name, "filter", options, cond=cond, strict=strict)

    def flat_map(self, name: str, items: Column | Callable[[DataFrame], Column], output: str = "item", options: Options | None = None) -> Dataset:
        """A row per item of a list, in order; no item gives no row."""
        return self._then(name, "flatmap", options, items=items, output=output)

    def infer(self, name: str, spec: InferSpec, options: Options | None = None, max_attempts: int = 3) -> Dataset:
        return self._then(name, "infer", options, spec=spec, max_attempts=max_attempts)

    def reduce_ai(self, name: str, binding: Binding, prompt: Callable[[Column], Column], *, item: str, output: str, fan_in: int = 8, key: str | None = None, options: Options | None = None) -> Dataset:
        return self._then(name, "reduce_ai", options, binding=binding, prompt=prompt, item=item, output=output, fan_in=fan_in, key=key)

    def combine(self, name: str, value: Column, merge: Callable[[Column, Column], Column], options: Options | None = None) -> Dataset:
        return self._then(name, "combine", options, value=value, merge=merge)

    def iterate(self, name: str, func: Callable[[DataFrame], Iterated], options: Options | None = None) -> Dataset:
        return self._then(name, "iterate", options, func=func)

    def window(self, name: str, ts: str, spec: WindowSpec, aggregates: dict[str, Column] | None = None, options: Options | None = None) -> Dataset:
        return self._then(name, "window", options, ts=ts, window=spec, aggregates=aggregates)


class Pipeline:
    def __init__(self, name: str):
        self.name, self.stages = name, []

    def _add(self, stage: Stage) -> Dataset:
        self.stages.append(stage)
        return Dataset(self, stage)

    def from_records(self, name: str, rows: list, schema: T.StructType | str) -> Dataset:
        return self._add(Stage(name, "source", None, {"rows": rows, "schema": schema}))

    def from_func(self, name: str, load: Callable[[SparkSession], DataFrame]) -> Dataset:
        """Loaded when the pipeline runs; an error ends the run."""
        return self._add(Stage(name, "source", None, {"load": load}))

    def from_stream(self, name: str) -> Dataset:
        return self._add(Stage(name, "source", None, {"stream": True}))

    def compile(self, registry: Registry | None = None, broadcasts: dict | None = None) -> Plan:
        names: set[str] = set()
        children: dict[str, list[str]] = {s.name: [] for s in self.stages}
        prints: dict[str, str] = {}
        for s in self.stages:
            if not s.name or s.name in names:
                raise PipelineError(f"stage names must be there and differ: {s.name!r}")
            names.add(s.name)
            if s.options.sandbox != "inline":
                raise PipelineError(f"stage {s.name!r}: sandbox {s.options.sandbox!r} is not there")
            missing = [b for b in s.options.broadcasts if b not in (broadcasts or {})]
            if missing:
                raise PipelineError(f"stage {s.name!r}: broadcasts {missing} are not registered")
            if s.kind in ("infer", "reduce_ai"):
                binding = s.spec["spec"].binding if s.kind == "infer" else s.spec["binding"]
                try:
                    binding.candidates(registry or Registry())
                except KeyError as e:
                    raise PipelineError(f"stage {s.name!r}: {e}") from e
            if s.kind == "infer":
                from ..functions.templates import parse

                parse(s.spec["spec"].prompt)
            if s.kind == "window":
                s.spec["window"].validate()
            if s.upstream is not None:
                children[s.upstream.name].append(s.name)
            own = {"kind": s.kind, "name": s.name, "version": s.options.version, "spec": {k: v for k, v in s.spec.items() if isinstance(v, (str, int, float, bool, type(None)))}}
            if s.kind == "infer":
                spec = s.spec["spec"]
                own["spec"] |= {"prompt": spec.prompt, "system": spec.system, "prefix": spec.prefix, "max_tokens": spec.max_tokens, "output": spec.output, "models": [m.name for m in spec.binding.candidates(registry)]}
            prints[s.name] = make_fingerprint(own, {b: content_hash((broadcasts or {})[b]) for b in s.options.broadcasts})
        return Plan(list(self.stages), children, prints, fused_runs(self.stages, children))

    def run(self, spark: SparkSession, registry: Registry | None = None, *, broadcasts: dict | None = None, id_col: str = "id") -> tuple[Plan, Result]:
        plan = self.compile(registry, broadcasts)
        for s in plan.order:
            if s.spec.get("stream") or s.kind == "window" and not s.spec.get("batch", True):
                raise PipelineError(f"{s.name!r} is a stream: use streaming.run_stream")
        out = Result({}, {}, {}, {})
        for s in plan.order:
            up = out.outputs[s.upstream.name] if s.upstream is not None else None
            df = _apply(s, up, spark, registry, out, id_col)
            if s.options.parallelism:
                df = df.repartition(s.options.parallelism)
            out.outputs[s.name] = df
        return plan, out


def fused_runs(stages: list[Stage], children: dict[str, list[str]]) -> list[list[str]]:
    """Chains of pure stages with one consumer each; Spark runs each as one stage, reported under its last name."""
    runs: list[list[str]] = []
    for s in stages:
        if s.kind not in PURE:
            continue
        up = s.upstream
        if up is not None and runs and up.kind in PURE and len(children[up.name]) == 1 and runs[-1][-1] == up.name:
            runs[-1].append(s.name)
        else:
            runs.append([s.name])
    return runs


def cacheable(stages: list[Stage]) -> bool:
    """A fused run is cacheable only if every stage in it has a version and allows it."""
    return all(s.options.version and s.options.cache for s in stages)


def _value(x, df: DataFrame):
    return x(df) if callable(x) and not isinstance(x, Column) else x


def _numbered(df: DataFrame, id_col: str) -> DataFrame:
    return df if "_seq" in df.columns else with_seq(df, id_col)


def _apply(s: Stage, up: DataFrame | None, spark: SparkSession, registry: Registry | None, out: Result, id_col: str) -> DataFrame:
    if s.kind == "source":
        if "load" in s.spec:
            return s.spec["load"](spark)
        return spark.createDataFrame(s.spec["rows"], s.spec["schema"])
    if s.kind == "map":
        if "func" in s.spec:
            return up.mapInArrow(s.spec["func"], s.spec["schema"])
        return up.withColumns(_value(s.spec["columns"], up))
    if s.kind == "filter":
        cond = _value(s.spec["cond"], up)
        if s.spec["strict"]:
            cond = F.when(cond.isNull(), F.raise_error(F.lit(f"{s.name}: condition is null")).cast("boolean")).otherwise(cond)
        return up.where(cond)
    if s.kind == "flatmap":
        kept = [c for c in up.columns if c not in (s.spec["output"], "_seq")]
        return up.select(*kept, F.posexplode(_value(s.spec["items"], up)).alias("pos", s.spec["output"]))
    if s.kind == "infer":
        got = infer(up, s.spec["spec"], registry, id_col=id_col, max_attempts=s.spec["max_attempts"])
        out.attempts[s.name], out.failures[s.name] = got.attempts, got.failures
        return got.records
    if s.kind == "reduce_ai":
        key = s.spec["key"]
        # numbered rows are written, so only what is reduced goes along; a name may be quoted or reach into a struct
        names = [x.lower() for x in (key, s.spec["item"], s.spec["output"]) if x]
        used = [c for c in up.columns if c != "_seq" and any(x in (c.lower(), f"`{c.lower()}`") or x.startswith(f"{c.lower()}.") for x in names)]
        up = up.select(*[f"`{c}`" for c in used], F.col("_seq" if "_seq" in up.columns else id_col).alias("__o"))
        up = (with_key_seq(up, key, "__o") if key else with_seq(up, "__o")).drop("__o")
        model = s.spec["binding"].candidates(registry)[0]
        got, calls = reduce_ai(up, model, s.spec["prompt"], item=s.spec["item"], output=s.spec["output"], fan_in=s.spec["fan_in"], key=key)
        out.attempts[s.name] = calls
        return got
    if s.kind == "combine":
        return fold(_numbered(up, id_col), s.spec["value"], s.spec["merge"])
    if s.kind == "iterate":
        got = s.spec["func"](up)
        out.iterations[s.name] = got
        return got.vertices
    if s.kind == "window":
        return panes(up, s.spec["ts"], id_col, s.spec["window"], stage=s.name, aggregates=s.spec["aggregates"])
    raise PipelineError(f"unknown kind {s.kind!r}")
