"""A pipeline run as a stream.

Stages up to the first window run on the stream itself where they are Columns.
What needs a call, an order or a whole pane runs per micro-batch: an unwindowed
inference on the batch's new records, a windowed one on the panes that the
watermark has closed, where reductions and folds are keyed by the pane.  A sink
gets each batch's rows with their `pane` (none without a window); it is called
again with the same batch after a failure, so it replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reduce import fold, reduce_ai
from ..plans.models import Registry
from ..plans.pipeline import PURE, Pipeline, PipelineError, Plan, Result, Stage, _apply
from ..storage import materialize, with_key_seq, with_seq
from .jobs import Limit, backfill_panes, run_stream, stop_after, stream_panes, validate_stream

Sink = Callable[[DataFrame, int], None]


@dataclass
class Report:
    """What a run did: rows that reached each sink, model calls by stage, panes, whether open windows were drained."""

    rows: dict[str, int] = field(default_factory=dict)
    calls: dict[str, int] = field(default_factory=dict)
    panes: int = 0
    drained: int = 0
    batches: int = 0


def _chain(plan: Plan, end: str) -> list[Stage]:
    """The stages from the source to one end."""
    by_name = {s.name: s for s in plan.order}
    if end not in by_name:
        raise PipelineError(f"no stage {end!r} to bind a sink to")
    out, s = [], by_name[end]
    while s is not None:
        out.append(s)
        s = s.upstream
    return out[::-1]


def _keyed(s: Stage, up: DataFrame, spark: SparkSession, registry: Registry | None, got: Result, id_col: str) -> DataFrame:
    """A stage over the rows of closed panes: what gathers records gathers those of one pane (and key)."""
    if s.kind not in ("reduce_ai", "combine"):
        return _apply(s, up, spark, registry, got, id_col)
    key = s.spec.get("key")
    group = F.to_json(F.struct("pane", *([key] if key else [])))
    d = with_key_seq(up.drop("_seq").withColumn("__group", group), "__group", "event_time" if "event_time" in up.columns else id_col, id_col)
    if s.kind == "combine":
        out = fold(d, s.spec["value"], s.spec["merge"], key="__group")
    else:
        model = s.spec["binding"].candidates(registry)[0]
        out, got.attempts[s.name] = reduce_ai(d, model, s.spec["prompt"], item=s.spec["item"], output=s.spec["output"], fan_in=s.spec["fan_in"], key="__group")
    names = d.select("__group", "pane", *([key] if key else [])).distinct()
    return out.join(names, "__group").drop("__group")


def run_pipeline(pipeline: Pipeline, spark: SparkSession, source: DataFrame, sinks: dict[str, Sink], checkpoint: str, *, registry: Registry | None = None, broadcasts: dict | None = None, id_col: str = "id", ts: str = "event_time", lateness: int = 0, limit: Limit | None = None, drain: Callable[[], DataFrame] | None = None) -> Report:
    """Runs a compiled pipeline on a stream until its source is read up (or the limit), and reports.

    sinks: a function per stage whose output is wanted; each is a query with a
    checkpoint of its own.  drain: the source as finished data; at the end every
    window that the watermark left open is fired from it as a last batch (number -1).
    """
    plan = pipeline.compile(registry, broadcasts)
    validate_stream(plan)
    report = Report()
    for end, sink in sinks.items():
        chain = _chain(plan, end)
        if not chain[0].spec.get("stream"):
            raise PipelineError(f"{end!r} does not come from the stream")
        _run_one(chain, spark, source, sink, f"{checkpoint}/{end}", registry, id_col, ts, lateness, limit, drain, report)
    return report


def _run_one(chain: list[Stage], spark: SparkSession, source: DataFrame, sink: Sink, checkpoint: str, registry: Registry | None, id_col: str, ts: str, lateness: int, limit: Limit | None, drain: Callable[[], DataFrame] | None, report: Report) -> None:
    end, got = chain[-1].name, Result({}, {}, {}, {})
    at = next((k for k, s in enumerate(chain) if s.kind == "window"), None)
    # Column stages run on the stream; from the first other one on, batches do
    head = 1
    while head < len(chain) and chain[head].kind in PURE and "func" not in chain[head].spec and (at is None or head < at):
        head += 1
    if at is not None and head < at:
        raise PipelineError(f"{chain[head].name!r}: a stage that calls or orders comes after the window")

    def before(df: DataFrame) -> DataFrame:
        for s in chain[1:head]:
            df = _apply(s, df, spark, registry, got, id_col)
        return df

    def after(df: DataFrame, number: int) -> None:
        rest = chain[at + 1 :] if at is not None else chain[head:]
        for s in rest:
            df = _keyed(s, df, spark, registry, got, id_col) if at is not None else _apply(s, df, spark, registry, got, id_col)
        df = materialize(df)
        for s in rest:
            if s.name in got.attempts:
                report.calls[s.name] = report.calls.get(s.name, 0) + got.attempts[s.name].count()
        report.rows[end] = report.rows.get(end, 0) + df.count()
        report.batches += 1
        sink(df, number)

    if at is None:

        def each(df: DataFrame, number: int) -> None:
            df = materialize(with_seq(df, id_col))
            if not df.isEmpty():
                after(df, number)

        query = run_stream(before(source), each, checkpoint, limit=limit, once=limit is None or not limit.records)
        if limit and limit.records:
            stop_after(query, limit)
        return
    window = chain[at]
    spec, columns = window.spec["window"], window.spec["ts"]
    live = before(source)
    own = tuple(c for c in live.columns if c not in (columns, id_col, spec.key))
    fired: list[str] = []

    def rows_of(panes: DataFrame) -> DataFrame:
        keep = ["pane", "window_start", "window_end", "pane_seq", *([spec.key] if spec.key else [])]
        return panes.select(*keep, F.inline("rows")).withColumnRenamed(columns, "event_time") if columns != "event_time" else panes.select(*keep, F.inline("rows"))

    def closed(df: DataFrame, number: int) -> None:
        df = materialize(df)
        names = [r[0] for r in df.select("pane").collect()]  # one short name for each pane of a batch
        if names:
            fired.extend(names)
            report.panes += len(names)
            after(rows_of(df), number)

    panes = stream_panes(live, columns, id_col, spec, stage=window.name, source_lateness=lateness, columns=own)
    run_stream(panes, closed, checkpoint, limit=limit)
    if drain is not None:
        left = backfill_panes(before(drain()), columns, id_col, spec, stage=window.name, columns=own)
        done = spark.createDataFrame([(p,) for p in fired], "pane string")
        left = materialize(left.join(done, "pane", "left_anti"))
        n = left.count()
        if n:
            report.panes += n
            report.drained = n
            after(rows_of(left), -1)
