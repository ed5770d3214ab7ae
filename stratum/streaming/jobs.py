"""Running streams: panes in append mode, per-pane work in batches, limits, reports; and the same panes over finished data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import event_time
from ..operators.windows import WindowSpec, assign, pane_id, panes
from ..plans.pipeline import PipelineError, Plan


@dataclass(frozen=True)
class Limit:
    """Zero means no limit; a job stops cleanly after so many records or seconds."""

    records: int = 0
    seconds: float = 0.0


def with_event_time(df: DataFrame, col: str, out: str = "event_time") -> DataFrame:
    return df.withColumn(out, event_time(F.col(col), df.schema[col].dataType))


def stream_panes(df: DataFrame, ts: str, record_id: str, spec: WindowSpec, *, stage: str = "window", source_lateness: int = 0, columns: tuple[str, ...] = ()) -> DataFrame:
    """Panes of a stream: each window fires once, when the watermark passes its end plus lateness."""
    spec.validate()
    if not spec.size:
        raise PipelineError("a global window fires by triggers: use windower.stateful")
    marked = df.withWatermark(ts, f"{source_lateness + spec.lateness} seconds")
    keys = [F.col(spec.key)] if spec.key else []
    rows = F.array_sort(F.collect_list(F.struct(ts, record_id, *columns)))
    out = marked.groupBy(spec.column(F.col(ts)).alias("w"), *keys).agg(F.count("*").alias("n"), rows.alias("rows"))
    key = F.col(spec.key).cast("string") if spec.key else F.lit("")
    d = out.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end"), "pane_seq": F.lit(1)}).drop("w")
    return d.withColumn("pane", pane_id(stage, F.col("window_start"), F.col("window_end"), key, F.col("pane_seq")))


def backfill_panes(df: DataFrame, ts: str, record_id: str, spec: WindowSpec, *, stage: str = "window", columns: tuple[str, ...] = ()) -> DataFrame:
    """The same panes over finished data, the last windows too."""
    rows = F.array_sort(F.collect_list(F.struct(ts, record_id, *columns)))
    return panes(df, ts, record_id, spec, stage=stage, aggregates={"rows": rows})


def union_splits(splits: list[DataFrame], ts: str, lateness: int) -> DataFrame:
    """Several splits with a watermark each; the least of them is the stream's (Spark's default policy)."""
    marked = [s.withWatermark(ts, f"{lateness} seconds") for s in splits]
    out = marked[0]
    for m in marked[1:]:
        out = out.unionByName(m)
    return out


def run_stream(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, limit: Limit | None = None, once: bool = True, name: str | None = None):
    """Starts a query whose micro-batches go to a function; with `once` what is there is read and the query ends."""
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
    if name:
        writer = writer.queryName(name)
    if once:
        writer = writer.trigger(availableNow=True)
    query = writer.start()
    if limit and limit.seconds:
        query.awaitTermination(limit.seconds)
        query.stop()
    elif once:
        query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def stop_after(query, limit: Limit, poll: float = 0.5) -> int:
    """Waits until so many records came, then stops; how many came."""
    import time

    end = time.monotonic() + limit.seconds if limit.seconds else None
    while query.isActive:
        seen = sum(int(p["numInputRows"]) for p in query.recentProgress)
        if limit.records and seen >= limit.records or end and time.monotonic() >= end:
            query.stop()
        time.sleep(poll)
    return sum(int(p["numInputRows"]) for p in query.recentProgress)


def progress_report(spark: SparkSession, query) -> DataFrame:
    """A row per micro-batch: rows in, watermark, rows that came too late."""
    rows = [
        (int(p["batchId"]), int(p["numInputRows"]), (p.get("eventTime") or {}).get("watermark"), sum(int(s.get("numRowsDroppedByWatermark", 0)) for s in p.get("stateOperators", [])))
        for p in query.recentProgress
    ]
    return spark.createDataFrame(rows, "batch bigint, rows bigint, watermark string, dropped bigint")


def fail_on_late(query) -> None:
    """Raises where rows were dropped as late."""
    late = sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p.get("stateOperators", []))
    if late:
        raise RuntimeError(f"{late} rows were late")


def validate_stream(plan: Plan) -> None:
    """A stream needs a stream source; aggregates on it need a window before them."""
    if not any(s.spec.get("stream") for s in plan.order):
        raise PipelineError("no stage is a stream source")
    windowed: dict[str, bool] = {}
    live: dict[str, bool] = {}
    for s in plan.order:
        up = s.upstream.name if s.upstream else ""
        live[s.name] = bool(s.spec.get("stream")) or live.get(up, False)
        windowed[s.name] = s.kind == "window" or windowed.get(up, False)
        if live[s.name] and s.kind in ("reduce_ai", "combine", "iterate") and not windowed[s.name]:
            raise PipelineError(f"{s.name!r} aggregates a stream without a window")


def pane_counts(df: DataFrame, ts: str, spec: WindowSpec) -> DataFrame:
    """How many records each window has, as an aggregate alone."""
    keys = ["window_start", "window_end", *([spec.key] if spec.key else [])]
    return assign(df, ts, spec).groupBy(*keys).agg(F.count("*").alias("n"))


def ordered_ids(rows: Column, record_id: str) -> Column:
    return F.transform(rows, lambda r: r[record_id])
